"""All jobs of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cluster_jobs, sample_jobs, similarity_jobs

_MODULES = (similarity_jobs, cluster_jobs, sample_jobs)


def jobs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: job for m in _MODULES for name, job in m.JOBS.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}

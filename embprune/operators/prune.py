"""Remove from a pool what lies too close to evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prune(pool: DataFrame, violating: DataFrame) -> DataFrame:
    """The pool without the violating ids of one evaluation set, or of all sets when they are given together."""
    return pool.join(violating.select("id").distinct(), "id", "left_anti")


def size_report(pool: DataFrame, violating: DataFrame, set_names: DataFrame) -> DataFrame:
    """(eval_set, n_pool, n_removed, n_kept, consistent) for each of `set_names` (eval_set), which are few.

    The ids of the pool meet the sets that remove them once; n_kept is counted from the rows that stay, not from the difference.
    """
    names = sorted(r[0] for r in set_names.select("eval_set").distinct().collect())
    if not names:
        return pool.sparkSession.createDataFrame([], "eval_set string, n_pool long, n_removed long, n_kept long, consistent boolean")
    hits = violating.groupBy("id").agg(F.collect_set("eval_set").alias("sets"))
    rows = pool.select("id").join(hits, "id", "left").select(F.coalesce("sets", F.array().cast("array<string>")).alias("sets"))
    counts = [F.count_if(test).alias(f"{kind}{i}") for i, n in enumerate(names) for kind, test in (("r", F.array_contains("sets", n)), ("k", ~F.array_contains("sets", n)))]
    total = rows.agg(F.count("*").alias("n_pool"), *counts)
    each = [F.struct(F.lit(n).alias("eval_set"), "n_pool", F.col(f"r{i}").alias("n_removed"), F.col(f"k{i}").alias("n_kept"), (F.col(f"r{i}") + F.col(f"k{i}") == F.col("n_pool")).alias("consistent")) for i, n in enumerate(names)]
    return total.select(F.inline(F.array(*each)))

"""Sums of vectors by cluster, in blocks of numbers: what a task adds up leaves as one row for each range of clusters.

Tasks are combined before anything is shuffled: at most `most_tasks` tasks go over all rows, so that a pass shuffles at most
that many times clusters x dimension numbers, whatever the number of input partitions. A cluster of which a task has a single
row leaves as that row's 32-bit vector, where it is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of sums in one row; fewest tasks that rows are combined to, and tasks for each slot of the cluster.
BLOCK_BYTES, LEAST_TASKS, TASKS_A_SLOT = 1 << 18, 256, 2
_BLOCKS = "range int, clusters binary, counts binary, n_single int, singles binary, sums binary"


def most_tasks(df: DataFrame) -> int:
    return max(LEAST_TASKS, TASKS_A_SLOT * df.sparkSession.sparkContext.defaultParallelism)


class Sums:
    """Sums of vectors and of two counts by cluster, held as matrices."""

    def __init__(self):
        self.slots: dict[int, int] = {}
        self.sums = np.zeros((0, 0))
        self.counts = np.zeros((0, 2), np.int64)

    def add(self, x: np.ndarray, clusters: np.ndarray, counts: np.ndarray) -> None:
        if not len(x):
            return
        order = np.argsort(clusters, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(clusters[order]) != 0])
        at = np.array([self.slots.setdefault(c, len(self.slots)) for c in clusters[order][first].tolist()])
        if len(self.slots) > len(self.sums):
            more = max(len(self.slots), 2 * len(self.sums)) - len(self.sums)
            old = self.sums if len(self.sums) else np.zeros((0, x.shape[1]))
            self.sums = np.concatenate((old, np.zeros((more, x.shape[1]))))
            self.counts = np.concatenate((self.counts, np.zeros((more, 2), np.int64)))
        self.sums[at] += np.add.reduceat(x[order], first, 0)
        self.counts[at] += np.add.reduceat(counts[order], first, 0)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(clusters, counts, sums) by cluster."""
        clusters = np.fromiter(self.slots, np.int64, len(self.slots))
        order = np.argsort(clusters)
        return clusters[order], self.counts[order], self.sums[order]

    def blocks(self) -> Iterator[pa.RecordBatch]:
        clusters, counts, sums = self.table()
        if not len(clusters):
            return
        of = clusters // max(1, BLOCK_BYTES // (8 * max(sums.shape[1], 1)))
        for rows in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
            small = sums[rows].astype(np.float32)
            single = (np.abs(counts[rows, 0]) == 1) & (small == sums[rows]).all(1)
            order = np.r_[rows[single], rows[~single]]
            cells = [clusters[order].astype("<i4"), counts[order].astype("<i8"), small[single], sums[rows[~single]]]
            cells = [pa.array([c.tobytes()], pa.binary()) for c in cells]
            yield pa.RecordBatch.from_arrays([pa.array([of[rows[0]]], pa.int32()), *cells[:2], pa.array([int(single.sum())], pa.int32()), *cells[2:]], [c.split()[0] for c in _BLOCKS.split(", ")])

    def take(self, batch: pa.RecordBatch) -> None:
        """Add the blocks of other tasks."""
        for _, clusters, counts, n, singles, sums in zip(*(column.to_pylist() for column in batch.columns)):
            clusters, counts = np.frombuffer(clusters, "<i4").astype(np.int64), np.frombuffer(counts, "<i8").reshape(-1, 2)
            small, large = np.frombuffer(singles, "<f4"), np.frombuffer(sums, "<f8")
            width = (len(small) + len(large)) // len(clusters)
            self.add(np.concatenate((small.reshape(n, width).astype(float), large.reshape(-1, width))), clusters, counts)


def combined(parts: DataFrame) -> DataFrame:
    """(cluster, n, n_changed, sums array<double>) of blocks that tasks have made."""

    def run(batches):
        total = Sums()
        for batch in batches:
            total.take(batch)
        clusters, counts, sums = total.table()
        width = sums.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(clusters) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(clusters.astype(np.int32)), pa.array(counts[:, 0]), pa.array(counts[:, 1]), lists], ["cluster", "n", "n_changed", "sums"])

    return parts.repartition("range").mapInArrow(run, "cluster int, n long, n_changed long, sums array<double>")


def blocks_schema() -> str:
    return _BLOCKS

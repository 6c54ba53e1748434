"""Certified lower bounds of the k-th similarity of each query, from counts over the whole base.

A sketch is a histogram of a query's similarities over a grid of its own: counts add up, whatever the tasks. A small sample of the
base places the grid around the k-th similarity; the counts are of all rows, so that the bound that they give holds whatever the
sample was. Where a grid was misplaced, or one of its bins holds too many rows, the next pass counts with a finer grid inside
that bin, for these queries alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import matrix

#: Bins of a grid; rows of the sample that places the grids; queries of one row of counts in the shuffle.
BINS, SAMPLE_ROWS, PART = 1024, 8192, 64
#: Share of rows above k that a bound may let through, and rows beside it.
EXTRA, FEW = 0.15, 4
#: Bytes of counts that a task holds before it hands them on.
HELD_BYTES = 256 << 20
#: Rounding of a similarity, as a share of the largest: bounds are lowered by it.
ROUNDING = 1e-12


def _least(values: np.ndarray) -> np.ndarray:
    """What a similarity may differ by from one product to another."""
    return ROUNDING * np.maximum(np.abs(values), 1e-3)


class Bounds:
    """Grid, bound and what is known so far for each chunk and query of a block; arrays are chunks x queries."""

    def __init__(self, q: np.ndarray, sample: np.ndarray, chunks: np.ndarray, sizes: np.ndarray, k: int):
        shape = (len(chunks), len(q))
        self.k, self.chunks = k, chunks
        self.bound = np.full(shape, -np.inf)
        self.pending = np.ones(shape, bool)
        low, high = self._placed(q, sample, k * len(chunks), int(sizes.sum()))
        self.low, self.high = np.tile(low, (len(chunks), 1)), np.tile(high, (len(chunks), 1))
        # Chunks of k rows and fewer give all that they have.
        self.pending[sizes <= k] = False

    @staticmethod
    def _placed(q: np.ndarray, sample: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(sample)
        if not m:
            return np.zeros(len(q)), np.zeros(len(q))
        rank = k * m / max(n, m)
        at = min(m, int(np.ceil(2 * rank + 3 * rank**0.5 + 4)))
        low, top = np.empty(len(q)), np.empty(len(q))
        step = max(1, (1 << 22) // m)
        for i in range(0, len(q), step):
            sims = q[i : i + step] @ sample.T
            low[i : i + step] = np.partition(sims, m - at, 1)[:, m - at] if at < m else sims.min(1)
            top[i : i + step] = sims.max(1)
        # As far up as less than one row of the base is to be expected, were the tail exponential.
        fold = (top - low) / np.log(max(at, 2))
        return low, low + fold * (np.log(max(at, 2) * max(n / m, 1)) + 3)

    def take(self, chunk: int, which: np.ndarray, found: np.ndarray) -> None:
        """Rows (bound, low, high, done) of some queries of a chunk."""
        bound, low, high, done = found.T
        asked = self.pending[chunk, which]
        self.bound[chunk, which] = np.where(asked & (done > 0), bound, self.bound[chunk, which])
        self.pending[chunk, which] = asked & (done == 0)
        self.low[chunk, which], self.high[chunk, which] = low, high


def settled(counts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """(bound, low, high, done) for each query from its counts of all rows (below the grid, in its bins, above) and its least and
    largest similarity: done with a bound, or the finer grid of the next pass."""
    above = np.cumsum(counts[:, ::-1], 1)[:, ::-1]
    # The last place from which upwards there are k rows; the first place where there are fewer in all.
    at = np.maximum((above >= k).sum(1) - 1, 0)
    held = above[np.arange(len(at)), at]
    width = (high - low) / BINS
    edges = np.where(at == 0, ends[:, 0], np.where(at == BINS + 1, high, low + (at - 1) * width))
    tops = np.where(at == 0, low, np.where(at == BINS + 1, ends[:, 1], low + at * width))
    done = (held <= (1 + EXTRA) * k + FEW) | (tops - edges <= 4 * _least(edges))
    return np.stack((edges - 2 * _least(edges), np.where(done, low, edges), np.where(done, high, tops), done), 1)


def _refine(base: DataFrame, q: np.ndarray, bounds: Bounds, parts: Callable) -> None:
    """A pass over all rows of `base` (id, embedding, chunk) for the chunks and queries whose bounds are pending."""
    asked = np.flatnonzero(bounds.pending.any(0))
    low, high, k, n = np.where(bounds.pending, bounds.low, np.inf)[:, asked], bounds.high[:, asked], bounds.k, len(asked)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(high > low, BINS / (high - low), 0.0)
    held = base.sparkSession.sparkContext.broadcast((q[asked], low, high, scale, bounds.chunks))

    def handed_on(state: dict):
        for c, (counts, seen, ends) in state.items():
            counts[:, 0] = seen - counts[:, 1:].sum(1)
            for i in range(0, n, PART):
                cells = [pa.array([x]) for x in (c, i)] + [pa.array([a[i : i + PART].tobytes()]) for a in (counts, ends)]
                yield pa.RecordBatch.from_arrays(cells, ["chunk", "part", "counts", "ends"])
        state.clear()

    def run(batches):
        q, low, high, scale, chunks = held.value
        state: dict = {}
        wanted = np.isfinite(low).any(1)
        for batch in batches:
            for part in parts(batch, n):
                x, of = matrix(part.column(1)), np.searchsorted(chunks, part.column(2).to_numpy())
                for c in np.unique(of).tolist():
                    if not wanted[c]:
                        continue
                    sims = q @ x[of == c].T
                    if c not in state:
                        if len(state) * n * (BINS + 2) * 4 > HELD_BYTES:
                            yield from handed_on(state)
                        state[c] = [np.zeros((n, BINS + 2), np.int32), 0, np.stack((np.full(n, np.inf), np.full(n, -np.inf)), 1)]
                    counts, _, ends = state[c]
                    state[c][1] += sims.shape[1]
                    ends[:, 0], ends[:, 1] = np.fmin(ends[:, 0], sims.min(1)), np.fmax(ends[:, 1], sims.max(1))
                    i, j = np.nonzero(sims >= low[c][:, None])
                    v = sims[i, j]
                    place = np.minimum((v - low[c, i]) * scale[c, i], BINS - 1).astype(np.int64) + 1
                    np.add.at(counts.reshape(-1), i * (BINS + 2) + np.where(v >= high[c, i], BINS + 1, place), 1)
        yield from handed_on(state)

    def add_up(batches):
        """Rows of one key follow each other."""
        _, low, high, _, _ = held.value
        key, counts, ends = None, None, None

        def told():
            own = slice(key[1], key[1] + len(counts))
            found = settled(counts, ends, low[key[0], own], high[key[0], own], k)
            return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in key), pa.array([found.tobytes()])], ["chunk", "part", "found"])

        for batch in batches:
            for c, i, some, two in zip(*(column.to_pylist() for column in batch.columns)):
                some, two = np.frombuffer(some, np.int32).reshape(-1, BINS + 2), np.frombuffer(two).reshape(-1, 2)
                if key == (c, i):
                    counts += some
                    ends[:, 0], ends[:, 1] = np.minimum(ends[:, 0], two[:, 0]), np.maximum(ends[:, 1], two[:, 1])
                    continue
                if key is not None:
                    yield told()
                key, counts, ends = (c, i), some.astype(np.int64), two.copy()
        if key is not None:
            yield told()

    counted = base.mapInArrow(run, "chunk long, part long, counts binary, ends binary")
    dealt = counted.repartition("chunk", "part").sortWithinPartitions("chunk", "part")
    seen = np.zeros_like(bounds.pending)
    for r in dealt.mapInArrow(add_up, "chunk long, part long, found binary").toArrow().to_pylist():
        found = np.frombuffer(r["found"]).reshape(-1, 4)
        which = asked[r["part"] : r["part"] + len(found)]
        bounds.take(r["chunk"], which, found)
        seen[r["chunk"], which] = True
    # A chunk without a single vector is not seen and has no rows to bound.
    bounds.pending &= seen


def kth_bounds(base: DataFrame, q: np.ndarray, sample: np.ndarray, chunks: np.ndarray, sizes: np.ndarray, k: int, parts: Callable) -> np.ndarray:
    """chunks x queries: a similarity that at least k rows of the chunk (id, embedding, chunk) have or pass, and few more; -inf for all rows.

    As many passes over the base as grids must be refined: one as a rule. Equal similarities are never told apart, so rows that
    tie with the k-th one pass too.
    """
    bounds = Bounds(q, sample, chunks, sizes, k)
    while bounds.pending.any():
        _refine(base, q, bounds, parts)
    return bounds.bound


def sampled(base: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE_ROWS vectors of `base`, or all of a small one."""
    rows = base.select("embedding").where(F.col("embedding").isNotNull())
    share = 1.0 if n <= SAMPLE_ROWS else SAMPLE_ROWS / n
    return matrix((rows if share == 1.0 else rows.sample(share, seed=7)).toArrow()["embedding"])

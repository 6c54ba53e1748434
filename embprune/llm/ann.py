"""Approximate nearest neighbours by inner product with learned partitions.

The nearest-neighbour graph of a sample is cut into partitions of equal size that few edges cross. A small classifier
learns from the vectors which partition they are in. Every row is indexed in its most probable partition; a query goes to
its most probable ones, until these have a share of its probability, where the candidates are ranked by the exact measure.
The share is the least that gives `TARGET` recall on queries held out of the sample; and the partitions must hold more than
k rows. The number of partitions grows with the table, up to one for `PART_SAMPLE` rows of the largest sample.

Partitions are cut into blocks of rows, queries into blocks of theirs, so that a group of either size stays bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stage_table

#: Rows on which the partitions and the classifier are fitted: about so many at least and at most, as the partitions ask for,
#: chosen by a hash of id and vector; never more than twice as many.
SAMPLE, LARGEST_SAMPLE = 1 << 13, 1 << 15
#: Rows of the sample, and of the table, for one partition at least.
PART_SAMPLE, PART_ROWS = 1 << 7, 1 << 11
GRAPH_NEIGHBOURS = 10
TARGET = 0.94
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 14, 1 << 12


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as 64-bit floats) of the rows that take part: no null, no zero vector, all components finite."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(good, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vector"))


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        sims = x[i : i + 1024] @ x.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -np.inf
        out[i : i + 1024] = np.argpartition(-sims, k - 1, 1)[:, :k] if k else out[i : i + 1024]
    return out


def bisect(rows: np.ndarray, x: np.ndarray, graph: np.ndarray, passes: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Two equal halves of `rows`: cut at the median along the main direction, then swap pairs while fewer edges cross."""
    direction = np.linalg.svd(x[rows] - x[rows].mean(0), full_matrices=False)[2][0]
    side = np.zeros(len(x), np.int8)  # 0: not here, 1 and -1: the halves
    order = rows[np.argsort(x[rows] @ direction, kind="stable")]
    half = len(rows) // 2
    side[order[:half]], side[order[half:]] = 1, -1
    a = np.repeat(rows, graph.shape[1])
    b = graph[rows].ravel()
    inside = side[b] != 0
    a, b = a[inside], b[inside]
    best, cut = side.copy(), int((side[a] != side[b]).sum())
    for _ in range(passes):
        crossing = np.where(side[a] != side[b], 1.0, -1.0)
        gain = np.bincount(a, crossing, len(x)) + np.bincount(b, crossing, len(x))
        left, right = rows[side[rows] == 1], rows[side[rows] == -1]
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        swap = int((gain[left[:n]] + gain[right[:n]] > 0).sum()) // 2
        if not swap:
            break
        side[left[:swap]], side[right[:swap]] = -1, 1
        now = int((side[a] != side[b]).sum())
        if now >= cut:
            break
        best, cut = side.copy(), now
    return rows[best[rows] == 1], rows[best[rows] == -1]


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each row: halves of halves, so `parts` is taken up to a power of two."""
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [h for g in groups for h in (bisect(g, x, graph) if len(g) > 1 else (g, g[:0]))]
    label = np.zeros(len(x), np.int64)
    for i, g in enumerate(groups):
        label[g] = i
    return label


class Router:
    """A classifier with one hidden layer: the probability of each partition."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 96, epochs: int = 30, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = max(np.sqrt((x * x).sum(1).mean()), 1e-12) / np.sqrt(x.shape[1])
        z = x / self.size
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
        m, v, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), 256):
                at = order[i : i + 256]
                step += 1
                for p, g in enumerate(self._gradient(z[at], label[at])):
                    m[p], v[p] = 0.9 * m[p] + 0.1 * g, 0.999 * v[p] + 0.001 * g * g
                    self.w[p] -= 0.003 * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, z: np.ndarray, label: np.ndarray):
        hidden = np.maximum(z @ self.w[0] + self.w[1], 0)
        error = self._softmax(hidden @ self.w[2] + self.w[3])
        error[np.arange(len(z)), label] -= 1
        error /= len(z)
        back = (error @ self.w[2].T) * (hidden > 0)
        return z.T @ back, back.sum(0), hidden.T @ error, error.sum(0)

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        a = np.exp(a - a.max(1, keepdims=True))
        return a / a.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(x / self.size @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def partitions_for(rows: int) -> int:
    """The largest power of two that leaves each partition PART_ROWS rows of the table and PART_SAMPLE of the largest sample."""
    return 1 << max(0, min(rows // PART_ROWS, LARGEST_SAMPLE // PART_SAMPLE).bit_length() - 1)


def before_each(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partitions by falling probability, and how much probability comes before each."""
    order = np.argsort(-p, 1, kind="stable")
    ranked = np.take_along_axis(p, order, 1)
    return order, np.cumsum(ranked, 1) - ranked


def fit(x: np.ndarray, parts: int, k: int, target: float) -> tuple[Router, float, float]:
    """The router, the share of a query's probability that its partitions have for `target` recall on every eighth row, left
    out of the fit, and the share of all rows that these queries then meet."""
    probe = np.arange(len(x)) % 8 == 0
    if parts == 1 or len(x) < 16:
        return Router(x, np.zeros(len(x), np.int64), parts), 1.0, 1.0
    kept = x[~probe]
    router = Router(kept, balanced_partitions(kept, neighbour_graph(kept, GRAPH_NEIGHBOURS), parts), parts)
    home = router.probabilities(kept).argmax(1)
    near = np.argpartition(-(x[probe] @ kept.T), min(k, len(kept) - 1) - 1, 1)[:, :k]
    order, before = before_each(router.probabilities(x[probe]))
    rank = np.take_along_axis(np.argsort(order, 1), home[near], 1)
    needed = np.sort(np.take_along_axis(before, rank, 1), None)
    share = float(np.nextafter(needed[int(np.ceil(target * len(needed))) - 1], 2))
    sizes = np.bincount(home, minlength=parts)
    return router, share, float((sizes[order] * (before < share)).sum(1).mean() / len(kept))


def best_in_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows for each query, by exact inner product, ties to the smaller id; never a row of the query's own id."""
    out_r, out_q, out_i, out_s = [], [], [], []
    if len(queries) and len(rows):
        q, x, ids = matrix(queries["vector"]), matrix(rows["vector"]), rows["id"].to_numpy()
        asked = queries["row"].tolist()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        for i in range(0, len(q), 256):
            sims = q[i : i + 256] @ x.T
            own_ids = queries["id"].to_numpy()[i : i + 256]
            for j, (a, b) in enumerate(zip(np.searchsorted(ids, own_ids), np.searchsorted(ids, own_ids, "right"))):
                sims[j, a:b] = -np.inf
            n = min(k, len(x))
            floor = -np.partition(-sims, n - 1, 1)[:, n - 1] if n else None
            for j, own in enumerate(own_ids.tolist()):
                # Rounding differs within a matrix product; those near the limit are computed again, one by one.
                near = np.flatnonzero(sims[j] >= floor[j] - 1e-9 * max(1.0, abs(floor[j])))
                near = near[ids[near] != own]
                exact = (x[near] * q[i + j]).sum(1)
                top = np.lexsort((ids[near], -exact))[:k]
                out_r += [asked[i + j]] * len(top)
                out_q += [own] * len(top)
                out_i += ids[near][top].tolist()
                out_s += exact[top].tolist()
    return pd.DataFrame({"row": np.array(out_r, np.int64), "query_id": np.array(out_q, np.int64), "vec_id": np.array(out_i, np.int64), "score": np.array(out_s, np.float64)})


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None, target: float = TARGET) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest found of `rows` for each query, all others where there are fewer.

    Rows that are null, zero or not finite, or have no id, take no part on either side. So do vectors of a length other than
    the table's commonest. A row is never a neighbour of the query with its id; repeated rows appear as often as they are
    there, repeated queries (id and vector) count once. An id asked with several vectors has the k nearest of each. Other
    columns of either table, of any name, play no part. An empty table gives no rows.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = valid_vectors(rows, id_col, vector_col)
    lengths = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    same = F.size("vector") == lengths[0]["n"]
    parts = parts or partitions_for(lengths[0]["count"])
    sample = min(LARGEST_SAMPLE, max(SAMPLE, 2 * PART_SAMPLE * parts))
    drawn = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / lengths[0]["count"]))
    chosen = good.where(same & drawn).select("vector").limit(2 * sample).toArrow()["vector"].combine_chunks()
    router, share, _ = fit(chosen.flatten().to_numpy().reshape(-1, lengths[0]["n"]), parts, k, target)
    held = spark.sparkContext.broadcast(router)

    def place(batches):
        for b in batches:
            home = held.value.probabilities(matrix(b.column(1).to_pylist())).argmax(1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home, pa.int32())], ["id", "vector", "part"])

    index = stage_table(good.where(same).mapInArrow(place, "id long, vector array<double>, part int"), "ann-index")
    sizes = np.zeros(parts, np.int64)
    for r in index.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order, before = before_each(held.value.probabilities(matrix(b.column(1).to_pylist())))
            reach = np.cumsum(sizes[order], 1)
            # As many partitions as needed, more where these hold too few rows for k neighbours.
            take = np.maximum((before < share).sum(1), 1 + (reach < k + b.column(3).to_numpy()[:, None]).sum(1).clip(max=parts - 1))
            owner = np.repeat(np.arange(b.num_rows), take)
            goes = np.concatenate([o[:t] for o, t in zip(order, take)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)), pa.array(goes, pa.int32()), b.column(2).take(pa.array(owner))], ["id", "vector", "part", "row"])

    asked = valid_vectors(queries, id_col, vector_col).where(same).distinct().withColumn("row", F.monotonically_increasing_id())
    # Rows of the query's own id, which are no neighbours.
    copies = index.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")
    asked = asked.join(copies, "id", "left").select("id", "vector", "row", F.coalesce("copies", F.lit(1)).alias("copies"))
    routed = stage_table(asked.mapInArrow(route, "id long, vector array<double>, part int, row long"), "ann-queries")
    asked_of = np.zeros(parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        asked_of[r["part"]] = r["count"]
    row_blocks = F.array(*(F.lit(max(1, -(-int(n) // BLOCK_ROWS))) for n in sizes))[F.col("part")]
    query_blocks = F.array(*(F.lit(max(1, -(-int(n) // BLOCK_QUERIES))) for n in asked_of))[F.col("part")]
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = routed.withColumn("qb", F.pmod(F.xxhash64("row"), query_blocks).cast("int")).withColumn("rb", each(row_blocks))
    right = index.withColumn("rb", F.pmod(F.xxhash64("id"), row_blocks).cast("int")).withColumn("qb", each(query_blocks))
    found = left.groupBy("part", "qb", "rb").cogroup(right.groupBy("part", "qb", "rb")).applyInPandas(lambda a, b: best_in_block(a, b, k), "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

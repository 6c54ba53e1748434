"""Similarity of a large base against a set of queries: top-k, maxima, thresholds, violations.

Similarity is the inner product in 64-bit floats. The base is never shuffled: queries are broadcast as matrices of at most
`QUERY_BYTES` and each task keeps its own best. Results for each base row (maxima, violations) come from one pass that goes
through all matrices for each batch, or through `PASS_BYTES` of them at a time, with what was found so far written with the
rows in between. The best of each query take one pass for each matrix, the k most similar rows two passes for each `PASS_BYTES` of
queries, whatever k is: one counts and certifies bounds, one hands on the rows that pass them. Vectors of different lengths
are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import best_first, matrix
from ..functions.work import Work, counting
from ..sources.tables import stage_table
from .bounds import BINS, kth_bounds, sampled
from .nearest import Groups, grouped
from .products import largest, over

#: Bytes of query vectors in one matrix.
QUERY_BYTES = 64 << 20
#: Bytes of query vectors that a worker holds in one pass.
PASS_BYTES = 512 << 20
#: Similarities that a task holds at once.
CELLS = 1 << 22
#: Queries x k up to which each task keeps its own best candidates of a chunk.
ONE_PASS = 1 << 18
_CANDIDATES = "chunk long, query_id long, id long, sim double"


def query_blocks(queries: DataFrame, id_col: str = "id", vector_col: str = "embedding", more: list[str] = (), most: int | None = None) -> Iterator[tuple]:
    """Yields (ids, matrix, *more) by ascending id, as many blocks as their size asks for; rows without a vector are left out.

    A block holds a range of ids. One after the other comes to the driver, as Arrow columns; the ids alone come at once.
    """
    most = most or QUERY_BYTES
    queries = queries.where(F.col(vector_col).isNotNull()).withColumn("__id", F.col(id_col).cast("long"))
    total = queries.agg(F.sum(F.size(vector_col).cast("long") * 8).alias("bytes"), F.count("*").alias("n")).first()
    if not total.n:
        return
    blocks = max(1, -(-(total.bytes or 0) // most))
    ids = np.zeros(0, np.int64) if blocks == 1 else np.unique(queries.select("__id").toArrow()["__id"].to_numpy())
    for own in [None] if blocks == 1 else np.array_split(ids, min(blocks, len(ids))):
        part = queries if own is None else queries.where(F.col("__id").between(int(own[0]), int(own[-1])))
        table = part.select("__id", F.col(vector_col).alias("__vector"), *more).toArrow().sort_by("__id")
        yield (table["__id"].to_numpy(), matrix(table["__vector"]), *(table[m].to_numpy() for m in more))


def slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that have at most CELLS similarities with `width` queries."""
    step = max(1, CELLS // max(width, 1))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def over_rows(rows: DataFrame, vector_col: str, blocks: Iterator[tuple], state: str, fold: Callable, keep_vector: bool = False, width: int | None = None) -> DataFrame | None:
    """`rows`, without their vector unless `keep_vector`, with the columns of `state` after a `fold` for every block; None without blocks.

    `fold(own, vectors, before, *block)` takes the first column of some rows and their vectors. `before` and its result are
    lists of Arrow arrays, one for each column of `state`; `before` is None for the first block. Rows without a vector get
    nulls. One pass holds PASS_BYTES of blocks; between passes the rows are written. `width` is the cells that a fold makes for a
    row, by default one for each query of a block.
    """
    context, names = rows.sparkSession.sparkContext, [c.split()[0] for c in state.split(", ")]
    n, vector = len(rows.columns), rows.columns.index(vector_col)

    def one_pass(df: DataFrame, held: list, first: bool, last: bool) -> DataFrame:
        keep = [i for i in range(n) if keep_vector or not (last and i == vector)]
        schema = ", ".join(f"`{df.schema[i].name}` {df.schema[i].dataType.simpleString()}" for i in keep) + f", {state}"

        def run(batches):
            cells = width or max(len(h.value[0]) for h in held)
            for batch in batches:
                for part in slices(batch, cells):
                    there = np.flatnonzero(part.column(vector).is_valid().to_numpy(zero_copy_only=False))
                    known = part.take(pa.array(there))
                    own, x = known.column(0).to_numpy(zero_copy_only=False), matrix(known.column(vector))
                    found = None if first else [known.column(n + i) for i in range(len(names))]
                    for h in held:
                        found = fold(own, x, found, *h.value)
                    if len(there) < part.num_rows:
                        place = np.full(part.num_rows, -1)
                        place[there] = np.arange(len(there))
                        found = [f.take(pa.array(place, mask=place < 0)) for f in found]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *found], [*(part.schema.names[i] for i in keep), *names])

        return df.mapInArrow(run, schema)

    done, held, size = rows, [], 0
    for block in blocks:
        if held and size + block[1].nbytes > PASS_BYTES:
            done = stage_table(one_pass(done, held, done is rows, False), "similarities")
            held, size = [], 0
        held.append(context.broadcast(block))
        size += block[1].nbytes
    return one_pass(done, held, done is rows, True) if held else None


def over_queries(base: DataFrame, blocks: Iterator[tuple], make: Callable, schema: str) -> DataFrame:
    """The union of a pass over `base` for each block; a query is in one block only."""
    spark = base.sparkSession
    found = [base.mapInArrow(make(spark.sparkContext.broadcast(b)), schema) for b in blocks]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def _best_of_tasks(rows: DataFrame, block: tuple, k: int) -> DataFrame:
    """(chunk, query_id, id, sim): each task's k best of each chunk for each query."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        ids, q = held.value
        best: dict = {}
        for batch in batches:
            for part in slices(batch, len(ids)):
                x = matrix(part.column(1))
                chunks, own = part.column(2).to_numpy(zero_copy_only=False), part.column(0).to_numpy()
                for c in np.unique(chunks).tolist():
                    at = chunks == c
                    sims, cand = q @ x[at].T, np.broadcast_to(own[at], (len(ids), int(at.sum())))
                    if c in best:
                        sims, cand = np.hstack((best[c][0], sims)), np.hstack((best[c][1], cand))
                    best[c] = best_first(sims, cand, k)
        for c, (sims, cand) in best.items():
            n = sims.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sims.size, c)), pa.array(np.repeat(ids, n)), pa.array(cand.ravel()), pa.array(sims.ravel())], ["chunk", "query_id", "id", "sim"])

    return rows.mapInArrow(run, _CANDIDATES)


def _rows_over_bounds(rows: DataFrame, block: tuple, chunks: np.ndarray, sizes: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """(chunk, query_id, id, sim): the rows of each chunk at or above a certified bound of the k-th similarity of each query."""
    ids, q = block
    bound = kth_bounds(rows, q, sample, chunks, sizes, k, slices)
    held = rows.sparkSession.sparkContext.broadcast((ids, q, chunks, bound))

    def run(batches):
        ids, q, chunks, bound = held.value
        for batch in batches:
            for part in slices(batch, len(ids)):
                x = matrix(part.column(1))
                own, of = part.column(0).to_numpy(), np.searchsorted(chunks, part.column(2).to_numpy())
                for c in np.unique(of).tolist():
                    at = np.flatnonzero(of == c)
                    sims = q @ x[at].T
                    i, j = np.nonzero(sims >= bound[c][:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), chunks[c])), pa.array(ids[i]), pa.array(own[at[j]]), pa.array(sims[i, j])], ["chunk", "query_id", "id", "sim"])

    return rows.mapInArrow(run, _CANDIDATES)


def candidates(queries: DataFrame, base: DataFrame, k: int, chunk_col: str) -> DataFrame:
    """(chunk, query_id, id, sim): rows of each chunk among which are the k most similar for each query.

    Where all queries have at most ONE_PASS candidates, each task hands on its k best, in one pass. Beyond it a first pass
    certifies a bound for each query and chunk, and a second hands on the rows at or above it: about k and at most 1.2 k for each
    query and chunk, but for rows that tie with the k-th. One block of queries is PASS_BYTES of vectors, counts and bounds.
    """
    rows = base.select("id", "embedding", F.col(chunk_col).cast("long").alias("chunk")).where("embedding IS NOT NULL AND chunk IS NOT NULL")
    size = queries.where(F.col("embedding").isNotNull()).agg(F.max(F.size("embedding")).alias("width"), F.count("*").alias("n")).first()
    if not size.n:
        return base.sparkSession.createDataFrame([], _CANDIDATES)
    if size.n * k <= ONE_PASS:
        return reduce(DataFrame.union, (_best_of_tasks(rows, block, k) for block in query_blocks(queries)))
    # Chunks are few, as files are; the vectors are not read for this.
    counts = base.select(F.col(chunk_col).cast("long").alias("chunk")).where("chunk IS NOT NULL").groupBy("chunk").count().toArrow().sort_by("chunk")
    chunks, sizes = counts["chunk"].to_numpy(), counts["count"].to_numpy()
    if not len(chunks):
        return base.sparkSession.createDataFrame([], _CANDIDATES)
    sample = sampled(rows, int(sizes.sum()))
    query_bytes = 8 * size.width + 4 * (BINS + 2) + 40 * len(chunks)
    most = max(8 * size.width, PASS_BYTES * 8 * size.width // query_bytes)
    return reduce(DataFrame.union, (_rows_over_bounds(rows, block, chunks, sizes, sample, k) for block in query_blocks(queries, most=most)))


def topk_by_chunk(queries: DataFrame, base: DataFrame, k: int, chunk_col: str) -> DataFrame:
    """(chunk, query_id, id, sim, rank): in each chunk of `base` (id, embedding, chunk) the k most similar rows for each query.

    Most similar first, ties to the smaller id. Fewer than k rows in a chunk give fewer rows, no queries none. Rows without a
    vector or a chunk take no part.
    """
    rank = F.row_number().over(Window.partitionBy("chunk", "query_id").orderBy(F.desc("sim"), "id"))
    return candidates(queries, base, k, chunk_col).withColumn("rank", rank).where(F.col("rank") <= k)


def merge_candidates(candidates: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """(query_id, id, sim, rank): the k best of all lists for each query, or with `ascending` the k worst among them."""
    order = F.asc("sim") if ascending else F.desc("sim")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return candidates.select("query_id", "id", "sim").withColumn("rank", rank).where(F.col("rank") <= k)


def union_chunks(parts: list[DataFrame]) -> DataFrame:
    """The results of chunks as one table, columns by name; at least one chunk."""
    return reduce(DataFrame.unionByName, parts)


def topk(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sim, rank): the k most similar rows of `base` for each query, however the base is dealt."""
    return merge_candidates(topk_by_chunk(queries, base.withColumn("__chunk", F.lit(0)), k, "__chunk"), k)


def balls(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks of queries in balls; further columns in the order of the balls."""
    for ids, q, *more in blocks:
        g = grouped(ids, q)
        order = np.lexsort((ids, g.member))
        yield (*g, *(m[order] for m in more))


def with_largest(rows: DataFrame, blocks: Iterator[tuple], state: str, work: Work | None = None) -> DataFrame | None:
    """`rows` (id, embedding) with their largest product with a query and its id as the columns `state`; None without queries."""
    count = counting(work)

    def fold(own, x, before, *block):
        g = Groups(*block)
        who, best, computed = largest(x, g, None if before is None else (before[1].to_numpy(), before[0].to_numpy()))
        count(computed, len(x) * len(g.ids))
        return [pa.array(best), pa.array(who)]

    return over_rows(rows, "embedding", balls(blocks), state, fold, width=1 << 10)


def max_sims(base: DataFrame, queries: DataFrame, work: Work | None = None) -> DataFrame:
    """(id, max_sim, nearest_query) for every row of `base` with a vector, repeated ids too; ties to the smaller query.

    A row meets only balls of queries that can hold its best; `work` counts the products. Without queries there are no rows.
    """
    rows = base.select("id", "embedding").where(F.col("embedding").isNotNull())
    found = with_largest(rows, query_blocks(queries), "max_sim double, nearest_query bigint", work)
    empty = base.sparkSession.createDataFrame([], "id long, max_sim double, nearest_query long")
    return empty if found is None else found


def per_query_best(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(query_id, threshold): the highest similarity of each query to any row of `base`; no row for a query without any."""

    def make(held):
        def run(batches):
            ids, q = held.value
            best = np.full(len(ids), -np.inf)
            for batch in batches:
                for part in slices(batch, len(ids)):
                    best = np.maximum(best, (q @ matrix(part.column(0)).T).max(1))
            seen = best > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(best[seen])], ["query_id", "sim"])

        return run

    found = over_queries(base.select("embedding").where(F.col("embedding").isNotNull()), query_blocks(queries), make, "query_id long, sim double")
    return found.groupBy("query_id").agg(F.max("sim").alias("threshold"))


def _needed(threshold: str, query: str) -> F.Column:
    """The threshold; a query without one is an error."""
    return F.coalesce(F.col(threshold), F.raise_error(F.concat(F.lit("no threshold for query "), F.col(query).cast("string"))).cast("double"))


def with_thresholds(queries: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Queries that have a vector with their `threshold`, a written table; a query without one is an error."""
    known = queries.where(F.col("embedding").isNotNull()).join(thresholds.select(F.col("query_id").alias("id"), "threshold"), "id", "left")
    return stage_table(known.withColumn("threshold", _needed("threshold", "id")), "thresholds")


def violations_of_sets(queries: DataFrame, pool: DataFrame, thresholds: DataFrame, set_col: str = "eval_set", work: Work | None = None) -> DataFrame:
    """(eval_set, id, query_id, sim): for each evaluation set in `queries`, each pool row that is more similar to one of its queries
    than the query's threshold, with the smallest such query.

    One pass over the pool for all sets, nothing shuffled but violators; a row meets only balls of queries of which it can pass a
    threshold, `work` counts the products. The sets are few and named by rows of the table. A
    query without threshold is an error, one without a set takes no part, no queries give no rows. A repeated id keeps one row
    for each set: the smallest query, then the highest similarity.
    """
    known = with_thresholds(queries.select("id", "embedding", F.col(set_col).alias("eval_set")).where("eval_set IS NOT NULL"), thresholds)
    names = sorted(r[0] for r in known.select("eval_set").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, names)), F.col("eval_set")).cast("int") - 1 if names else F.lit(0)
    none = np.iinfo(np.int64).max

    count = counting(work)

    def fold(own, x, before, *block):
        g, limit, of = Groups(*block[:-2]), *block[-2:]
        who = np.full((len(x), len(names)), none) if before is None else before[0].flatten().to_numpy().reshape(len(x), -1).copy()
        sim = np.zeros((len(x), len(names))) if before is None else before[1].flatten().to_numpy().reshape(len(x), -1).copy()
        computed = 0
        for rows, held, sims in over(x, g, limit):
            computed += sims.size
            above = sims > limit[held]
            for s in np.unique(of[held]).tolist():
                # Several balls, and in the one product for all of them ids are not in order.
                ids = np.where(above & (of[held] == s), g.ids[held], none)
                at = ids.argmin(1)
                least = ids[np.arange(len(rows)), at]
                better = least < who[rows, s]
                who[rows[better], s], sim[rows[better], s] = least[better], sims[better, at[better]]
        count(computed + len(x) * len(g.pivots), len(x) * len(g.ids))
        as_list = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), len(names)).cast(pa.list_(pa.from_numpy_dtype(a.dtype)))
        return [as_list(who), as_list(sim)]

    rows = pool.select("id", "embedding").where(F.col("embedding").isNotNull())
    blocks = query_blocks(known.withColumn("of", number), more=["threshold", "of"]) if names else iter(())
    found = over_rows(rows, "embedding", balls(blocks), "who array<bigint>, how array<double>", fold, width=1 << 10)
    if found is None:
        return pool.sparkSession.createDataFrame([], "eval_set string, id long, query_id long, sim double")
    sets = F.array(*map(F.lit, names))
    hits = found.select("id", F.explode(F.filter(F.arrays_zip(sets.alias("eval_set"), F.col("who"), F.col("how")), lambda h: h["who"] < none)).alias("h"))
    one = F.min_by(F.struct("h.who", "h.how"), F.struct("h.who", -F.col("h.how"))).alias("v")
    return hits.groupBy("h.eval_set", "id").agg(one).select("eval_set", "id", F.col("v.who").alias("query_id"), F.col("v.how").alias("sim"))


def violations(queries: DataFrame, pool: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(id, query_id, sim): as `violations_of_sets`, with all queries as one set."""
    return violations_of_sets(queries.withColumn("eval_set", F.lit("all")), pool, thresholds).drop("eval_set")


def threshold_candidates(candidates: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Candidates strictly above their own query's threshold; a candidate of a query without one is an error."""
    known = candidates.join(thresholds.select("query_id", "threshold"), "query_id", "left")
    return known.where(F.col("sim") > _needed("threshold", "query_id")).drop("threshold")


def violations_unique(candidates: DataFrame) -> DataFrame:
    """(id, query_id, sim): one row for each base id, that of the smallest query, then of the best rank."""
    first = F.min_by(F.struct("query_id", "sim"), F.struct("query_id", "rank"))
    return candidates.groupBy("id").agg(first.alias("v")).select("id", "v.query_id", "v.sim")

"""K-means over a large table: rows stay where they are and are never rewritten; centres are broadcast, sums come back.

A pass needs the centres before it and, for the rows that change, those of the pass before: both are matrices in one map pass, in
which bounds leave out most distances (`nearest`). From the second pass on only rows that change their cluster are added
up (`sums`). What a fit keeps is a small table of centres for each iteration, from which another session can go on.

Late passes change few rows, nearly all of them near a border, so a scan does more than one pass. The driver reckons the next
centres from the rows nearest to a border alone (`near_rows`, a bounded share). The scan then makes the sums of all rows for each
of these passes; a pass counts only if its numbers of arrivals and its centres are those that were reckoned, up to the first one
where they are not, of which the sums are right too. So a scan is one pass at least, and no row is ever taken on trust.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import matrix
from ..functions.work import Work, counting
from ..sources.tables import new_path, stage_table
from .nearest import ROUNDING, Found, Groups, grouped, moved, nearest
from .products import over
from .similarity import PASS_BYTES, QUERY_BYTES, balls, over_rows, query_blocks
from .sums import Sums, blocks_schema, combined, most_tasks

#: Passes of a fit after which sums are taken of all rows again.
REFRESH = 20
#: Passes with a scan each, in which much moves; passes that a later scan may do; share, bytes and distances to all centres of the rows from which they are reckoned on the driver, at
#: most, and the share below which too few passes would be right.
SINGLE, AHEAD, NEAR_SHARE, NEAR_BYTES, NEAR_CELLS, NEAR_LEAST = 8, 32, 0.25, 64 << 20, 1 << 22, 0.05
#: Difference of centres that are the same but for rounding.
SAME = 1e-9


def seed_centers(rows: DataFrame, k: int, seed: int, chunk_col: str | None = None, n_chunks: int = 1) -> DataFrame:
    """(cluster, id, center): k rows chosen by hashes of `seed`, as evenly as may be from `n_chunks` hash-ordered chunks.

    Without chunks: the k rows of the smallest hash. Chunks that are too small give what they have; the rest comes from
    the following rows in hash order.
    """
    by_hash = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string")))
    if chunk_col is None:
        top = rows.select("id", "embedding", by_hash.alias("h")).orderBy("h", "id").limit(k)
        place = Window.orderBy("h", "id")
    else:
        chunk_hash = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("chunk").cast("string")))
        chunks = rows.select(F.col(chunk_col).alias("chunk")).distinct().orderBy(chunk_hash, "chunk").limit(n_chunks)
        inside = F.row_number().over(Window.partitionBy("chunk").orderBy("h", "id"))
        chosen = rows.select("id", "embedding", F.col(chunk_col).alias("chunk"), by_hash.alias("h")).join(F.broadcast(chunks), "chunk")
        # Rank inside a chunk first, so that each chunk gives its first row before any gives its second.
        top = chosen.withColumn("at", inside).where(F.col("at") <= k).orderBy("at", "h", "id").limit(k)
        place = Window.orderBy("at", "h", "id")
    # k rows at most, so the single-partition rank is bounded.
    return top.withColumn("cluster", F.row_number().over(place) - 1).select("cluster", "id", F.col("embedding").cast("array<double>").alias("center"))


def close_centers(centers: DataFrame, limit: float = 0.9, fresh: DataFrame | None = None, work: Work | None = None) -> DataFrame:
    """(cluster,) of every centre of a pair whose similarity is above `limit`; with `fresh` (cluster, center), of pairs with one of these.

    Centres meet only balls of others that can hold such a pair (`products`); `work` counts the products.
    """
    rows, count = centers.select("cluster", "center"), counting(work)
    others = rows if fresh is None else fresh.select("cluster", "center")

    def fold(own, x, before, *block):
        g = Groups(*block)
        pairs, computed = [], len(x) * len(g.pivots)
        for at, held, sims in over(x, g, np.full(len(g.ids), limit)):
            computed += sims.size
            i, j = np.nonzero((sims > limit) & (g.ids[held] != own[at][:, None]))
            pairs.append((at[i], g.ids[held][j]))
        count(computed, len(x) * len(g.ids))
        i, j = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
        order = np.argsort(i, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(i, minlength=len(x)))))
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(j[order]))
        if before is not None:
            found = pa.array([a + b for a, b in zip(before[0].to_pylist(), found.to_pylist())], found.type)
        return [found]

    found = over_rows(rows, "center", balls(query_blocks(others, "cluster", "center")), "near array<bigint>", fold, width=1 << 10)
    if found is None:
        return rows.select("cluster").limit(0)
    close = found.where(F.size("near") > 0)
    return close.select(F.explode(F.concat(F.array(F.col("cluster").cast("long")), "near")).alias("cluster")).distinct().select(F.col("cluster").cast("int").alias("cluster"))


def dedup_centers(centers: DataFrame, spares: DataFrame, limit: float = 0.9, rounds: list[Work] | None = None) -> DataFrame:
    """Replace every centre of a too close pair by the next of `spares` (id, center by ascending `at` from 0), until none is left.

    Close centres take spares in the order of their clusters. After the first round only pairs with a replaced centre are
    looked for, as all others are apart; `rounds` gets the products of each round. Raises if the spares run out.
    """
    used, fresh = 0, None
    while True:
        work = Work(centers.sparkSession) if rounds is not None else None
        # Centres are a bounded table, so the single-partition rank is.
        found = close_centers(centers, limit, fresh, work)
        close = stage_table(found.selectExpr("cluster", f"row_number() OVER (ORDER BY cluster) - 1 + {used} AS at"), "close-centers")
        n = close.count()
        if rounds is not None:
            rounds.append(work)
        if not n:
            return centers
        fresh = stage_table(spares.join(close, "at").select("cluster", "id", "center"), "fresh-centers")
        new = stage_table(centers.join(close, "cluster", "left_anti").select("cluster", "id", "center").unionByName(fresh), "centers")
        if new.count() < centers.count():
            raise ValueError("centres stay too close: no spare rows left")
        centers, used = new, used + n


def _with_nearest(rows: DataFrame, blocks: Iterator[Groups], name: str, work: Work | None) -> DataFrame | None:
    """`rows` with the number of the nearest centre and its gap; None without centres."""
    count = counting(work)

    def fold(own, x, before, *block):
        g = Groups(*block)
        found = nearest(x, g, None if before is None else (before[0].to_numpy().astype(np.int64), before[1].to_numpy()))
        count(found.computed, len(x) * len(g.ids))
        return [pa.array(found.ids.astype(np.int32)), pa.array(found.gaps)]

    return over_rows(rows, "embedding", blocks, f"{name} int, __gap double", fold, keep_vector=True, width=1 << 10)


def assign(rows: DataFrame, centers: DataFrame, work: Work | None = None) -> DataFrame:
    """(id, embedding, cluster, prev_cluster): the nearest centre of each row, ties to the lowest cluster; null for a row without a vector.

    prev_cluster is the `cluster` that rows have already, if any. A row meets only groups of centres that can hold its nearest;
    `work` counts the distances. No centres are an error.
    """
    before = F.col("cluster") if "cluster" in rows.columns else F.lit(None)
    rows = rows.select("id", "embedding", before.cast("int").alias("prev_cluster"))
    found = _with_nearest(rows, (grouped(*b) for b in query_blocks(centers, "cluster", "center")), "cluster", work)
    if found is None:
        raise ValueError("there are no centres")
    return found.select("id", "embedding", "cluster", "prev_cluster")


def cluster_sums(assigned: DataFrame, changed: str = "false") -> DataFrame:
    """(cluster, n, n_changed, sums) of rows (embedding, cluster): counts, of rows where the expression `changed` holds too, and
    element-wise sums. Rows without a vector or a cluster take no part.

    At most `most_tasks` tasks add up their own rows first; their sums leave in blocks of clusters, which are added up.
    """
    known = assigned.where("embedding IS NOT NULL AND cluster IS NOT NULL")
    one = known.selectExpr("CAST(cluster AS INT) AS cluster", f"CAST(coalesce({changed}, true) AS LONG) AS n_changed", "embedding")

    def run(batches):
        total = Sums()
        for batch in batches:
            counts = np.stack((np.ones(batch.num_rows, np.int64), batch.column(1).to_numpy()), 1)
            total.add(matrix(batch.column(2)), batch.column(0).to_numpy(), counts)
        yield from total.blocks()

    return combined(one.coalesce(most_tasks(one)).mapInArrow(run, blocks_schema()))


Centers = tuple[np.ndarray, np.ndarray]


def center_matrix(centers: DataFrame) -> Centers:
    """(clusters, matrix) of all centres by cluster, on the driver: clusters x dimension numbers, as the caller chose. None are an error."""
    blocks = list(query_blocks(centers, "cluster", "center"))
    if not blocks:
        raise ValueError("there are no centres")
    return np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])


def _later(total: Sums, x: np.ndarray, now: Groups, found: Found, sets: list[Groups]) -> tuple[np.ndarray, int]:
    """Add the changes of later passes, with the centres `sets`, to `total`, and tell which rows have any, and the distances computed.

    A cluster's number there is its place in order of clusters + pass x number of clusters.
    """
    k, ever = len(now.ids), np.zeros(len(x), bool)
    if not sets:
        return ever, 0
    order, clusters = np.argsort(now.ids), np.sort(now.ids)
    first = now.centers[order]
    movement = max(np.sqrt(((s.centers[np.argsort(s.ids)] - first) ** 2).sum(1)).max() for s in sets)
    own = np.sqrt(np.maximum((x * x).sum(1) + found.gaps, 0))
    # A row that is nearer to its centre than the movement can change keeps it in all passes.
    open_ = np.flatnonzero(found.others - movement <= own + movement + ROUNDING * (1 + own))
    rows, held = x[open_], Found(found.ids[open_], found.gaps[open_], found.others[open_], 0)
    prev, computed = held.ids, 0
    for at, centers in enumerate(sets, 1):
        here, n = moved(rows, held, now, centers)
        computed += n
        other = np.flatnonzero(here != prev)
        to, since = (np.searchsorted(clusters, ids[other]) + at * k for ids in (here, prev))
        total.add(rows[other], to, np.ones((len(other), 2), np.int64))
        total.add(-rows[other], since, np.tile(np.array([[-1, 0]]), (len(other), 1)))
        ever[open_[other]] = True
        prev = here
    return ever, computed


def near_rows(points: DataFrame, now: Groups, share: float, passed: list[Groups] | None = None, work: Work | None = None) -> np.ndarray:
    """The vectors of about `share` of the rows (embedding), on the driver: those that change their cluster among the centres `passed`,
    then those whose second-nearest centre of `now` is the least farther than the nearest."""
    held = points.sparkSession.sparkContext.broadcast([tuple(g) for g in (now, *(passed or []))])
    count = counting(work)

    def run(batches):
        now, *passed = (Groups(*g) for g in held.value)
        for batch in batches:
            x = matrix(batch.column(0))
            n = int(share * len(x))
            found = nearest(x, now)
            margin = found.others - np.sqrt(np.maximum((x * x).sum(1) + found.gaps, 0))
            ever, computed = _later(Sums(), x, now, found, passed)
            count(found.computed + computed, 0)
            margin[ever] = -np.inf
            at = np.argpartition(margin, n)[:n] if n < len(x) else np.arange(len(x))
            yield batch.take(pa.array(np.sort(at)))

    return matrix(points.coalesce(most_tasks(points)).mapInArrow(run, points.schema).toArrow()["embedding"])


def _ahead(x: np.ndarray, clusters: np.ndarray, before: Groups, now: Groups, total: np.ndarray, n: np.ndarray, most: int, limit: float) -> tuple[list[Groups], list[np.ndarray]]:
    """Up to `most` sets of centres from `now` on, and the arrivals by cluster with each, if no rows but `x` change. The last set may
    be one with which fewer than `limit` of the rows change."""
    total, n = total.copy(), n.copy()
    place = lambda g: np.searchsorted(clusters, g.ids[(g.squares - 2 * x @ g.centers.T).argmin(1)])
    sets, arrivals, prev = [now], [], place(before)
    while True:
        here = place(sets[-1])
        other = np.flatnonzero(here != prev)
        np.add.at(total, here[other], x[other])
        np.subtract.at(total, prev[other], x[other])
        came, left = (np.bincount(p[other], minlength=len(n)) for p in (here, prev))
        n += came - left
        arrivals.append(came)
        if len(sets) >= most or len(other) < limit * n.sum():
            return sets, arrivals
        old = sets[-1].centers[np.argsort(sets[-1].ids)]
        sets.append(grouped(clusters, np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old), now.member))
        prev = here


def pass_sums(points: DataFrame, now: Groups, before: Groups | None, changes: bool, work: Work | None = None, then: list[Groups] | None = None) -> DataFrame:
    """`cluster_sums` of vectors (embedding) by their nearest centre `now`; changed are those whose nearest of `before` is another.
    With sets of centres `then`, the changes of their passes too; a cluster is then numbered by its place + pass x number of clusters.

    With `changes`, sums are those of rows that came to a cluster less those of rows that left it, so that a row that stays is
    not added up. One map pass in which vectors only go to the workers; at most `most_tasks` tasks, so it shuffles at most that
    many times clusters x dimension numbers. Where the centres are more than PASS_BYTES, vectors and numbers of centres
    are written in between, and sums are of all rows.
    """
    tables = [now] if before is None else [now, before]
    if sum(g.nbytes for g in tables) > PASS_BYTES:
        step = max(1, QUERY_BYTES // max(now.centers[0].nbytes, 1))
        for g, name in zip(tables, ("cluster", "prev_cluster")):
            parts = (grouped(g.ids[i : i + step], g.centers[i : i + step]) for i in range(0, len(g.ids), step))
            points = _with_nearest(points, parts, name, work).drop("__gap")
        return cluster_sums(points, "true" if before is None else "cluster <> prev_cluster")
    held = [points.sparkSession.sparkContext.broadcast(tuple(g)) for g in tables]
    later = points.sparkSession.sparkContext.broadcast([tuple(g) for g in then or []])
    clusters = np.sort(now.ids)
    count = counting(work)

    def run(batches):
        now, *old = (Groups(*h.value) for h in held)
        sets = [Groups(*g) for g in later.value]
        total = Sums()
        # Numbers are those of the clusters, or their places where passes follow.
        if sets:
            now, *old = (g._replace(ids=np.searchsorted(clusters, g.ids), names=np.searchsorted(clusters, g.names)) for g in (now, *old))
            sets = [g._replace(ids=np.searchsorted(clusters, g.ids), names=np.searchsorted(clusters, g.names)) for g in sets]
        for batch in batches:
            x = matrix(batch.column(0))
            found = nearest(x, now)
            _, more = _later(total, x, now, found, sets)
            count(more, len(sets) * len(x) * len(now.ids))
            ones = np.ones(len(x), np.int64)
            if not old:
                count(found.computed, len(x) * len(now.ids))
                total.add(x, found.ids, np.stack((ones, ones), 1))
                continue
            prev, computed = moved(x, found, now, old[0])
            count(found.computed + computed, 2 * len(x) * len(now.ids))
            other = prev != found.ids
            if changes:
                n = int(other.sum())
                total.add(x[other], found.ids[other], np.ones((n, 2), np.int64))
                total.add(-x[other], prev[other], np.tile(np.array([[-1, 0]]), (n, 1)))
            else:
                total.add(x, found.ids, np.stack((ones, other.astype(np.int64)), 1))
        yield from total.blocks()

    return combined(points.coalesce(most_tasks(points)).mapInArrow(run, blocks_schema()))


def update(assigned: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster, center): the mean of the rows (embedding, cluster) of each cluster; a cluster without rows keeps its centre."""
    means = cluster_sums(assigned).select("cluster", F.transform("sums", lambda s: s / F.col("n")).alias("mean"))
    return centers.select("cluster", "center").join(means, "cluster", "left").select("cluster", F.coalesce("mean", "center").alias("center"))


def change_ratio(assigned: DataFrame) -> DataFrame:
    """(ratio,): the share of rows whose cluster is not the one before."""
    return assigned.agg(F.avg((F.col("cluster") != F.col("prev_cluster")).cast("double")).alias("ratio"))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"))


def saved_centers(spark, state: str, iteration: int) -> DataFrame:
    """(cluster, center, before): the centres after iteration `iteration` of the fit that keeps its state in the folder `state`,
    and those that its assignment was made with."""
    return spark.read.parquet(f"{state}/iteration={iteration}")


def fit(rows: DataFrame, centers: DataFrame | None, limit: float = 1e-7, max_iterations: int | None = None, first: int = 0, state: str | None = None, work: Work | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(assigned, centers, iterations) after the passes until fewer than `limit` of the rows change, from the second on.

    `assigned` is that of the last pass, as `assign` gives it, made when it is read; the centres are its means. Each
    iteration's centres are written to `state`, a folder that all executors reach (by default a new one in the shared
    folder). With `first` the fit goes on after that iteration of `state`, from any session, and `centers` is not needed.
    `max_iterations` ends the fit earlier, with a warning where more rows than that still change; by default nothing does. Rows
    without a vector have no cluster; a table without vectors keeps the centres. No centres are an error. `work` counts the
    distances of all passes.
    """
    spark = rows.sparkSession
    state = state or new_path(spark, "kmeans")
    points = rows.select("embedding").where(F.col("embedding").isNotNull())
    if first:
        saved = saved_centers(spark, state, first)
        now, old = center_matrix(saved), center_matrix(saved.select("cluster", F.col("before").alias("center")))[1]
    else:
        now, old = center_matrix(centers), None
    clusters, new = now
    k, groups = len(clusters), grouped(clusters, new)
    before = None if old is None else grouped(clusters, old, groups.member)
    total, n = np.zeros(new.shape), np.zeros(k, np.int64)
    rows_of = lambda c: pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]).cast(pa.list_(pa.float64()))
    in_order = lambda g: g.centers[np.argsort(g.ids)]
    iteration, whole, near, most = first, first, None, AHEAD
    while True:
        sets, arrivals = [groups], []
        if near is not None and most > 1:
            sets, arrivals = _ahead(near, clusters, before, groups, total, n, most, limit)
        # Sums of changes alone, but for the first pass and now and then one that takes rounding out of the totals.
        changes = before is not None and 0 < iteration - whole < REFRESH and 2 * groups.nbytes <= PASS_BYTES
        whole = whole if changes else iteration
        found = pass_sums(points, groups, before, changes, work, sets[1:]).toArrow()
        at = found["cluster"].to_numpy() if len(sets) > 1 else np.searchsorted(clusters, found["cluster"].to_numpy())
        sums, counts = matrix(found["sums"]), np.stack((found["n"].to_numpy(), found["n_changed"].to_numpy()), 1)
        done, ratio = [], 1.0
        for i, used in enumerate(sets):
            if i == 0 and not changes:
                total[:], n[:] = 0, 0
            own = np.flatnonzero(at // k == i)
            came = np.zeros(k, np.int64)
            if len(own):
                total[at[own] - i * k] += sums[own]
                n[at[own] - i * k] += counts[own, 0]
                came[at[own] - i * k] = counts[own, 1]
            iteration += 1
            old = in_order(used)
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)
            ratio = came.sum() / max(n.sum(), 1)
            # The next set is that of the next pass only if no other row has changed.
            goes_on = i + 1 < len(sets) and (came == arrivals[i]).all() and np.abs(in_order(sets[i + 1]) - new).max() <= SAME * max(1.0, np.abs(new).max())
            new = in_order(sets[i + 1]) if goes_on else new
            done.append(pa.table({"cluster": pa.array(clusters.astype(np.int32)), "center": rows_of(new), "before": rows_of(old), "iteration": pa.array(np.full(k, iteration, np.int32))}))
            if not goes_on or (iteration > 1 and ratio < limit):
                break
        spark.createDataFrame(pa.concat_tables(done)).write.partitionBy("iteration").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(state)
        if iteration > 1 and ratio < limit:
            break
        if max_iterations is not None and iteration >= max_iterations:
            warnings.warn(f"k-means ended unconverged at pass {iteration}: a share of {ratio} of the rows still changed", stacklevel=2)
            break
        before, groups = sets[len(done) - 1], grouped(clusters, new, groups.member)
        # As far ahead as the last scan came, and further; no farther than the centres of all passes can be sent along.
        most = max(4, 2 * len(done))
        most = min(most, AHEAD, PASS_BYTES // max(groups.nbytes, 1) - 2, AHEAD if max_iterations is None else max_iterations - iteration)
        share = min(NEAR_SHARE, min(NEAR_BYTES // new[0].nbytes, NEAR_CELLS // k) / max(n.sum(), 1))
        near = near_rows(points, groups, share, sets, work) if iteration - first >= SINGLE and most > 1 and share >= NEAR_LEAST and n.sum() else None
        near = near if near is not None and len(near) else None
    saved = saved_centers(spark, state, iteration)
    return assign(rows, saved.select("cluster", F.col("before").alias("center")), work), saved.select("cluster", "center"), iteration


def join_assignments(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """Vectors (chunk, pos, id, embedding) with their cluster; of an id that a chunk has several times, the first row."""
    first = vectors.groupBy("chunk", "id").agg(F.min_by("embedding", "pos").alias("embedding"))
    return first.join(assigned.select("id", "cluster"), "id")

"""Similarity, pruning and subsets over the roles of `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prune, similarity, subsets
from ..sources.tables import new_path
from . import roles
from .roles import SQL_ROLES as R

CHUNKS, K_CHUNK, K, K_WORST, K_LONG = 7, 5, 20, 10, 50
SIZES = [50, 100, 200]
RANDOM_SIZES, SEED = [50, 100], 7


def _sim(df):
    return df.withColumn("sim", F.round("sim", 6))


def _chunked(spark, d):
    return similarity.topk_by_chunk(roles.queries(spark, d), roles.pool(spark, d).withColumn("chunk", F.col("id") % CHUNKS), K_CHUNK, "chunk")


def topk_candidates_chunk(spark, d):
    return _sim(_chunked(spark, d))


def topk_candidates(spark, d):
    return _sim(similarity.topk(roles.queries(spark, d), roles.pool(spark, d), K))


def bottomk_candidates(spark, d):
    return _sim(similarity.merge_candidates(_chunked(spark, d), K_WORST, ascending=True))


def union_chunks(spark, d):
    """Results of chunks, each in files of its own, as one table."""
    folder = new_path(spark, "chunk-results")
    _chunked(spark, d).write.partitionBy("chunk").parquet(folder)
    parts = [spark.read.parquet(f"{folder}/chunk={c}").withColumn("chunk", F.lit(c).cast("long")) for c in range(CHUNKS)]
    return similarity.union_chunks(parts).groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def max_sim_per_base(spark, d):
    return similarity.max_sims(roles.pool(spark, d), roles.queries(spark, d)).withColumn("max_sim", F.round("max_sim", 6))


def per_query_best(spark, d):
    return _thresholds(spark, d).withColumn("threshold", F.round("threshold", 6))


def _thresholds(spark, d):
    return similarity.per_query_best(roles.queries(spark, d), roles.train(spark, d))


def _candidates(spark, d):
    return similarity.threshold_candidates(similarity.topk(roles.queries(spark, d), roles.pool(spark, d), K_LONG), _thresholds(spark, d))


def threshold_candidates(spark, d):
    return _sim(_candidates(spark, d))


def violations_unique(spark, d):
    return _sim(similarity.violations_unique(_candidates(spark, d)))


def _all_sets(spark, d):
    return similarity.violations_of_sets(roles.queries_by_set(spark, d), roles.pool(spark, d), _thresholds(spark, d))


def violations_all_sets(spark, d):
    return _sim(_all_sets(spark, d))


def prune_per_eval(spark, d):
    return prune.prune(roles.pool(spark, d), _all_sets(spark, d).where("eval_set = 'a'")).select("id")


def prune_combined(spark, d):
    return prune.prune(roles.pool(spark, d), _all_sets(spark, d)).select("id")


def prune_size_check(spark, d):
    names = roles.queries_by_set(spark, d).select("eval_set").distinct()
    return prune.size_report(roles.pool(spark, d), _all_sets(spark, d), names)


def _max_sims(spark, d):
    return similarity.max_sims(roles.pool(spark, d), roles.queries(spark, d))


def global_rank(spark, d):
    return subsets.global_rank(_max_sims(spark, d), F.desc("max_sim"), F.asc("id")).select("id", "rank")


def random_subset(spark, d):
    pool = roles.pool(spark, d)
    one, two = (subsets.random_subset(pool, n, SEED).select(F.lit(n).alias("size"), "id") for n in RANDOM_SIZES)
    return one.union(two)


def prune_near(spark, d):
    return subsets.prune_near(_max_sims(spark, d), SIZES[1])


def prune_far(spark, d):
    return subsets.prune_far(_max_sims(spark, d), SIZES[1])


def subset_ladder(spark, d):
    return subsets.subset_ladder(_max_sims(spark, d), SIZES)


def chunk_outputs(spark, d):
    done = subsets.chunk_numbers(roles.vectors(spark, d).select("id"), 64, "id")
    return done.groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_CHUNKED = f"""ch AS (SELECT chunk, query_id, id, sim, rank FROM (SELECT p.id % {CHUNKS} AS chunk, q.id AS query_id, p.id AS id, list_dot_product(q.e, p.e) AS sim,
  row_number() OVER (PARTITION BY p.id % {CHUNKS}, q.id ORDER BY list_dot_product(q.e, p.e) DESC, p.id) AS rank FROM q, p) WHERE rank <= {K_CHUNK})"""


def _top(k):
    return f"""tk AS (SELECT * FROM (SELECT q.id AS query_id, p.id AS id, list_dot_product(q.e, p.e) AS sim,
  row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.e, p.e) DESC, p.id) AS rank FROM q, p) WHERE rank <= {k})"""


_OVER = f"""{_top(K_LONG)}, ov AS (SELECT tk.* FROM tk JOIN th USING (query_id) WHERE sim > threshold)"""
_VIOL = "vi AS (SELECT eval_set, p.id AS id, min(qs.id) AS query_id, arg_min(list_dot_product(qs.e, p.e), qs.id) AS sim FROM qs JOIN th ON th.query_id = qs.id, p WHERE list_dot_product(qs.e, p.e) > threshold GROUP BY eval_set, p.id)"
_MAX = "ms AS (SELECT p.id AS id, max(list_dot_product(q.e, p.e)) AS max_sim, arg_max(q.id, list_dot_product(q.e, p.e)) AS nearest_query FROM q, p GROUP BY p.id)"
_RANKS = f"WITH {R}, {_MAX}, near AS (SELECT id, row_number() OVER (ORDER BY max_sim, id) AS rank FROM ms), far AS (SELECT id, row_number() OVER (ORDER BY max_sim DESC, id) AS rank FROM ms)"

SQL = {
    "topk_candidates_chunk": f"WITH {R}, {_CHUNKED} SELECT chunk, query_id, id, round(sim, 6) AS sim, rank FROM ch",
    "topk_candidates": f"WITH {R}, {_top(K)} SELECT query_id, id, round(sim, 6) AS sim, rank FROM tk",
    "bottomk_candidates": f"WITH {R}, {_CHUNKED} SELECT query_id, id, round(sim, 6) AS sim, r AS rank FROM (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim, id) AS r FROM ch) WHERE r <= {K_WORST}",
    "union_chunks": f"WITH {R}, {_CHUNKED} SELECT chunk, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM ch GROUP BY chunk",
    "max_sim_per_base": f"WITH {R}, {_MAX} SELECT id, round(max_sim, 6) AS max_sim, nearest_query FROM ms",
    "per_query_best": f"WITH {R} SELECT query_id, round(threshold, 6) AS threshold FROM th",
    "threshold_candidates": f"WITH {R}, {_OVER} SELECT query_id, id, round(sim, 6) AS sim, rank FROM ov",
    "violations_unique": f"WITH {R}, {_OVER} SELECT id, min(query_id) AS query_id, round(arg_min(sim, query_id), 6) AS sim FROM ov GROUP BY id",
    "violations_all_sets": f"WITH {R}, {_VIOL} SELECT eval_set, id, query_id, round(sim, 6) AS sim FROM vi",
    "prune_per_eval": f"WITH {R}, {_VIOL} SELECT id FROM p WHERE id NOT IN (SELECT id FROM vi WHERE eval_set = 'a')",
    "prune_combined": f"WITH {R}, {_VIOL} SELECT id FROM p WHERE id NOT IN (SELECT id FROM vi)",
    "prune_size_check": f"""WITH {R}, {_VIOL}, s AS (SELECT DISTINCT eval_set FROM qs), x AS (SELECT s.eval_set, p.id, vi.id IS NOT NULL AS gone FROM s CROSS JOIN p LEFT JOIN vi ON vi.eval_set = s.eval_set AND vi.id = p.id),
c AS (SELECT eval_set, (SELECT count(*) FROM p) AS n_pool, count(*) FILTER (gone) AS n_removed, count(*) FILTER (NOT gone) AS n_kept FROM x GROUP BY eval_set) SELECT *, n_removed + n_kept = n_pool AS consistent FROM c""",
    "global_rank": f"{_RANKS} SELECT id, rank FROM far",
    "random_subset": f"WITH {R} " + " UNION ALL ".join(f"(SELECT {n} AS size, id FROM p ORDER BY md5('{SEED}-{n}-' || id), id LIMIT {n})" for n in RANDOM_SIZES),
    "prune_near": f"{_RANKS} SELECT id FROM near WHERE rank <= {SIZES[1]}",
    "prune_far": f"{_RANKS} SELECT id FROM far WHERE rank <= {SIZES[1]}",
    "subset_ladder": f"{_RANKS}, s(size) AS (VALUES ({'), ('.join(map(str, SIZES))})) SELECT 'near' AS kind, size, id FROM near, s WHERE rank <= size UNION ALL SELECT 'far', size, id FROM far, s WHERE rank <= size",
    "chunk_outputs": "SELECT chunk, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT vec_id AS id, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS chunk FROM embeddings) GROUP BY chunk",
}

JOBS = {f.__name__: f for f in (topk_candidates_chunk, topk_candidates, bottomk_candidates, union_chunks, max_sim_per_base, per_query_best, threshold_candidates, violations_unique, violations_all_sets, prune_per_eval, prune_combined, prune_size_check, global_rank, random_subset, prune_near, prune_far, subset_ladder, chunk_outputs)}

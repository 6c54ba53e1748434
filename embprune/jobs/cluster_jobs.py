"""Vector arithmetic, k-means and de-duplication over `embeddings` and hashed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import distance, dot, l2_normalize, norm
from ..operators import dedup, kmeans, samples
from ..sources.tables import new_path
from . import roles
from .roles import BUCKETS
from .roles import SQL_ROLES as R

K, SEED, SEED_CHUNKS = 8, 7, 3
#: Passes that the SQL unrolls, more than the given tables need; passes at the fixed point change nothing.
SQL_PASSES = 40
LIMIT = 0.65


def _pairs(spark, d):
    v = roles.vectors(spark, d)
    return v.select("id", "embedding").join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other")), "id")


def l2_normalized(spark, d):
    doubled = roles.vectors(spark, d).select("id", l2_normalize(F.transform("embedding", lambda x: x.cast("double") * (F.col("id") % 3))).alias("unit"))
    return doubled.select("id", F.round(F.get("unit", F.lit(0)), 6).alias("first"), F.round(norm(F.col("unit")), 6).alias("length"))


def pairwise_dot(spark, d):
    return _pairs(spark, d).select("id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("sim"))


def euclidean_distance(spark, d):
    return _pairs(spark, d).select("id", F.round(distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


def _first_centers(spark, d):
    low = roles.vectors(spark, d).orderBy("id").limit(K)
    return low.selectExpr("CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS cluster", "CAST(embedding AS ARRAY<DOUBLE>) AS center")


def seed_centers(spark, d):
    rows = roles.vectors(spark, d).withColumn("chunk", F.col("id") % 7)
    return kmeans.seed_centers(rows, K, SEED, "chunk", SEED_CHUNKS).select("cluster", "id")


def dedup_centers(spark, d):
    rows = roles.vectors(spark, d)
    every = kmeans.seed_centers(rows, 4 * K, SEED)
    spares = every.where(F.col("cluster") >= K).select((F.col("cluster") - K).alias("at"), "id", "center")
    return kmeans.dedup_centers(every.where(F.col("cluster") < K), spares, 0.35).select("cluster", "id")


def kmeans_assign(spark, d):
    return kmeans.assign(roles.vectors(spark, d), _first_centers(spark, d)).select("id", "cluster")


def kmeans_update(spark, d):
    centers, rows = _first_centers(spark, d), roles.vectors(spark, d)
    done = kmeans.update(kmeans.assign(rows, centers), centers)
    return done.select("cluster", F.posexplode("center")).select("cluster", "pos", F.round("col", 6).alias("value"))


def kmeans_fit(spark, d):
    """To the change bound, however many passes that takes."""
    return kmeans.fit(roles.vectors(spark, d), _first_centers(spark, d))[0].select("id", "cluster")


def kmeans_resume(spark, d):
    """The first iteration, then on from its saved state to the change bound."""
    state = new_path(spark, "kmeans-state")
    kmeans.fit(roles.vectors(spark, d), _first_centers(spark, d), max_iterations=1, state=state)
    return kmeans.fit(roles.vectors(spark, d), None, first=1, state=state)[0].select("id", "cluster")


def _by_label(spark, d):
    return roles.vectors(spark, d).withColumn("cluster", F.col("label").cast("int"))


def cluster_sums(spark, d):
    done = kmeans.cluster_sums(_by_label(spark, d))
    return done.select("cluster", "n", F.posexplode("sums")).select("cluster", "n", "pos", F.round("col", 6).alias("total"))


def cluster_sizes(spark, d):
    return kmeans.cluster_sizes(_by_label(spark, d))


def assignment_change_ratio(spark, d):
    return kmeans.change_ratio(_by_label(spark, d).withColumn("prev_cluster", (F.col("id") % 10).cast("int"))).select(F.round("ratio", 6).alias("ratio"))


def join_assignments(spark, d):
    v = roles.vectors(spark, d).withColumn("chunk", F.col("id") % 7)
    twice = v.withColumn("pos", F.col("id") * 2).union(v.where("id % 5 = 0").withColumn("pos", F.col("id") * 2 + 1))
    done = kmeans.join_assignments(twice, _by_label(spark, d).select("id", "cluster"))
    return done.select("chunk", "id", "cluster", F.round(norm(F.col("embedding")), 6).alias("length"))


def write_by_cluster(spark, d):
    path = new_path(spark, "by-cluster")
    samples.write_by_cluster(_by_label(spark, d).select("id", "embedding", "cluster"), path)
    back = spark.read.parquet(path)
    return back.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def write_id_list(spark, d):
    path = new_path(spark, "ids")
    samples.write_id_list(roles.pool(spark, d), path)
    return spark.read.parquet(path)


def cluster_pair_sims(spark, d):
    return dedup.pair_maxima(_by_label(spark, d)).select("id", "max_sim").withColumn("max_sim", F.round("max_sim", 6))


def cluster_pair_sims_blocked(spark, d):
    return dedup.pair_maxima(_by_label(spark, d), block_rows=16).select("id", "max_sim").withColumn("max_sim", F.round("max_sim", 6))


def dedup_keep(spark, d):
    rows = dedup.numbered(_by_label(spark, d))
    return dedup.dedup_keep(rows, dedup.pair_maxima(rows), LIMIT).select("id", "cluster")


def dedup_all(spark, d):
    return dedup.dedup_all(roles.hashed_documents(spark, d)).select("id", "cluster")


def _kmeans_sql(passes: int) -> str:
    parts = [R, f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, e AS center FROM (SELECT * FROM v ORDER BY id LIMIT {K}))"]
    for i in range(1, passes + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.id, any_value(v.e) AS e, CAST(arg_min(c.cluster, list_distance(v.e, c.center)) AS INTEGER) AS cluster FROM v, c{i - 1} c GROUP BY v.id)")
        parts.append(f"m{i} AS (SELECT cluster, list(s ORDER BY pos) AS mean FROM (SELECT cluster, pos, avg(x) AS s FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{i}) GROUP BY cluster, pos) GROUP BY cluster)")
        parts.append(f"c{i} AS MATERIALIZED (SELECT cluster, coalesce(mean, center) AS center FROM c{i - 1} LEFT JOIN m{i} USING (cluster))")
    return "WITH " + ", ".join(parts)


_PAIR_MAX = "SELECT a.id AS id, max(list_dot_product(a.e, b.e)) AS max_sim FROM v a JOIN v b ON a.label = b.label AND b.id < a.id GROUP BY a.id"
_FIT = f"{_kmeans_sql(SQL_PASSES)} SELECT id, cluster FROM a{SQL_PASSES}"
_HASHED = f"""w AS (SELECT doc_id AS id, lang AS cluster, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
b AS (SELECT id, cluster, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {BUCKETS} AS b, count(*) AS n FROM w GROUP BY ALL),
l AS (SELECT id, sqrt(sum(n * n)) AS len FROM b GROUP BY id),
s AS (SELECT x.id AS id, max(dot) AS max_sim FROM (SELECT x.id AS id, y.id AS other, sum(CAST(x.n AS DOUBLE) * y.n) / (any_value(lx.len) * any_value(ly.len)) AS dot
  FROM b x JOIN b y ON x.b = y.b AND x.cluster = y.cluster AND y.id < x.id JOIN l lx ON lx.id = x.id JOIN l ly ON ly.id = y.id GROUP BY x.id, y.id) x GROUP BY x.id)"""

SQL = {
    "l2_normalize": "SELECT id, round(x[1] * m / nullif(sqrt(list_dot_product(x, x)) * m, 0), 6) AS first, CASE WHEN m > 0 THEN 1.0::DOUBLE END AS length FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, vec_id % 3 AS m FROM embeddings)",
    "pairwise_dot": f"WITH {R} SELECT a.id, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON b.id = a.id + 1",
    "euclidean_distance": f"WITH {R} SELECT a.id, round(list_distance(a.e, b.e), 6) AS distance FROM v a JOIN v b ON b.id = a.id + 1",
    "seed_centers": f"""WITH {R}, ch AS (SELECT DISTINCT id % 7 AS chunk FROM v ORDER BY md5('{SEED}-' || chunk), chunk LIMIT {SEED_CHUNKS}),
x AS (SELECT id, md5('{SEED}-' || id) AS h, row_number() OVER (PARTITION BY id % 7 ORDER BY md5('{SEED}-' || id), id) AS nr FROM v WHERE id % 7 IN (SELECT chunk FROM ch))
SELECT CAST(row_number() OVER (ORDER BY nr, h, id) - 1 AS INTEGER) AS cluster, id FROM x QUALIFY row_number() OVER (ORDER BY nr, h, id) <= {K}""",
    "kmeans_assign": f"{_kmeans_sql(1)} SELECT id, cluster FROM a1",
    "kmeans_update": f"{_kmeans_sql(1)} SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(x, 6) AS value FROM (SELECT cluster, unnest(center) AS x, generate_subscripts(center, 1) AS pos FROM c1)",
    "kmeans_fit": _FIT,
    "kmeans_resume": _FIT,
    "cluster_sums": f"WITH {R} SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, CAST(pos - 1 AS INTEGER) AS pos, round(sum(x), 6) AS total FROM (SELECT label AS cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY cluster, pos",
    "cluster_sizes": "SELECT CAST(label AS INTEGER) AS cluster, count(*) AS n FROM embeddings GROUP BY label",
    "assignment_change_ratio": "SELECT round(avg(CASE WHEN label <> vec_id % 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS ratio FROM embeddings",
    "join_assignments": f"WITH {R} SELECT id % 7 AS chunk, id, CAST(label AS INTEGER) AS cluster, round(sqrt(list_dot_product(e, e)), 6) AS length FROM v",
    "write_by_cluster": "SELECT CAST(label AS INTEGER) AS cluster, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY label",
    "write_id_list": f"WITH {R} SELECT DISTINCT id FROM p",
    "cluster_pair_sims": f"WITH {R} SELECT id, round(max_sim, 6) AS max_sim FROM ({_PAIR_MAX})",
    "cluster_pair_sims_blocked": f"WITH {R} SELECT id, round(max_sim, 6) AS max_sim FROM ({_PAIR_MAX})",
    "dedup_keep": f"WITH {R}, m AS ({_PAIR_MAX}) SELECT id, CAST(label AS INTEGER) AS cluster FROM v LEFT JOIN m USING (id) WHERE coalesce(max_sim, 0) <= 1 - {LIMIT}::DOUBLE",
    "dedup_all": f"WITH {_HASHED} SELECT DISTINCT b.id, b.cluster FROM b LEFT JOIN s USING (id) WHERE coalesce(max_sim, 0) <= 1 - 0.124::DOUBLE",
}

JOBS = {f.__name__: f for f in (pairwise_dot, euclidean_distance, seed_centers, dedup_centers, kmeans_assign, kmeans_update, kmeans_fit, kmeans_resume, cluster_sums, cluster_sizes, assignment_change_ratio, join_assignments, write_by_cluster, write_id_list, cluster_pair_sims, cluster_pair_sims_blocked, dedup_keep, dedup_all)} | {"l2_normalize": l2_normalized}

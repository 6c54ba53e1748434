"""Balls of queries: equal to all products, and how many are computed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embprune.functions.work import Work
from embprune.operators import products, similarity
from embprune.operators.nearest import grouped


def clustered(rng, n, k, d):
    tops = rng.normal(size=(20, d))
    tops /= np.linalg.norm(tops, axis=1)[:, None]
    near = lambda m: tops[rng.integers(0, 20, m)] + 0.05 * rng.normal(size=(m, d))
    return near(n), near(k)


@pytest.mark.parametrize("kind", ["clustered", "gauss", "lengths", "equal", "zero"])
@pytest.mark.parametrize("k", [1, 7, 70, 500])
def test_largest_and_over_equal_all_products(kind, k):
    rng = np.random.default_rng(k)
    x, q = clustered(rng, 900, k, 10) if kind == "clustered" else (rng.normal(size=(900, 10)), rng.normal(size=(k, 10)))
    if kind == "lengths":
        q *= rng.choice([0.01, 1, 20], size=(k, 1))
    if kind == "equal":
        q = np.repeat(q[: max(1, k // 4)], 4, 0)[:k]
    if kind == "zero":
        q = np.zeros((k, 10))
    ids = rng.permutation(1000)[: len(q)]
    sims = x @ q.T
    top = sims.max(1)
    want = np.where(sims >= top[:, None] - 1e-12 * (1 + np.abs(top[:, None])), ids, 10**9).min(1)
    g = grouped(ids, q)
    who, best, computed = products.largest(x, g)
    assert (who == want).all() and np.allclose(best, top, atol=1e-12)
    if k > 7 and kind in ("clustered", "gauss"):
        half = k // 2
        one = products.largest(x, grouped(ids[:half], q[:half]))
        two = products.largest(x, grouped(ids[half:], q[half:]), one[:2])
        assert (two[0] == want).all()
    limit = rng.normal(size=len(q)) + np.quantile(sims, 0.95)
    order = np.lexsort((ids, g.member))
    got = {(int(r), int(g.ids[own][c])) for rows, own, s in products.over(x, g, limit[order]) for r, c in zip(*((rows[i], j) for i, j in [np.nonzero(s > limit[order][own])]).__next__())}
    assert got == {(int(i), int(ids[j])) for i, j in zip(*np.nonzero(sims > limit))}
    if kind == "clustered" and k == 500:
        assert computed < 0.25 * sims.size


def test_few_products_on_clustered_rows(spark):
    rng = np.random.default_rng(2)
    x, q = clustered(rng, 3000, 600, 16)
    frame = lambda v, first: spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(v)], "id long, embedding array<double>")
    base, queries = frame(x, 0).repartition(4), frame(q, 10_000)
    sims = x @ q.T
    work = Work(spark)
    got = {r.id: (r.nearest_query, r.max_sim) for r in similarity.max_sims(base, queries, work).collect()}
    assert all(got[i][0] == 10_000 + sims[i].argmax() and abs(got[i][1] - sims[i].max()) < 1e-12 for i in range(3000))
    assert work.share < 0.25
    limit = np.quantile(sims, 0.998, axis=0)
    th = spark.createDataFrame([(10_000 + i, float(t)) for i, t in enumerate(limit)], "query_id long, threshold double")
    sets = queries.withColumn("eval_set", (F.col("id") % 3).cast("string"))
    work = Work(spark)
    found = {(r.eval_set, r.id): (r.query_id, r.sim) for r in similarity.violations_of_sets(sets, base, th, work=work).collect()}
    want = {}
    for i, j in zip(*np.nonzero(sims > limit)):
        want.setdefault((str((10_000 + j) % 3), int(i)), (10_000 + int(j), sims[i, j]))
    assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-12 for k in want)
    assert work.share < 0.3

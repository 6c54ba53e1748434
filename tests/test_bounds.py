"""Top-k with certified bounds: equal to brute force, and how many rows and passes it takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embprune.operators import bounds, similarity

SCHEMA = "id long, embedding array<double>"


def brute(q, x, ids, k):
    sims = q @ x.T
    return {(i, j) for i in range(len(q)) for j in [int(ids[t]) for t in np.lexsort((ids, -sims[i]))[:k]]}


@pytest.fixture
def two_passes(monkeypatch):
    monkeypatch.setattr(similarity, "ONE_PASS", 0)
    passes = []
    refine = bounds._refine
    monkeypatch.setattr(bounds, "_refine", lambda *a: (passes.append(1), refine(*a)))
    return passes


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)], SCHEMA)


@pytest.mark.parametrize("kind", ["gauss", "clustered", "narrow"])
@pytest.mark.parametrize("k", [20, 700])
def test_two_passes_hand_on_at_most_1_2_k_rows(spark, two_passes, monkeypatch, kind, k):
    monkeypatch.setattr(bounds, "SAMPLE_ROWS", 600)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 16))
    if kind == "clustered":
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, 6000)] * 3 + 0.3 * x
    if kind == "narrow":
        x = 50 * np.ones(16) + 0.01 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[::400] + 0.1 * rng.normal(size=(15, 16))
    base, queries = frame(spark, x).repartition(7), frame(spark, q)
    found = similarity.candidates(queries, base.withColumn("chunk", F.lit(0)), k, "chunk").cache()
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 1.2 * k
    assert len(two_passes) == 1
    assert {(r.query_id, r.id) for r in similarity.topk(queries, base, k).collect()} == brute(q, x, np.arange(len(x)), k)


def test_chunks_of_very_different_rows(spark, two_passes):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(1500, 8)), 5 + rng.normal(size=(1500, 8)), rng.normal(size=(10, 8))])
    chunk = np.repeat([3, -1, 8], [1500, 1500, 10])
    q = rng.normal(size=(40, 8))
    base = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, chunk))] + [(9999, None, 3), (9998, [0.0] * 8, None), (9997, None, 77)], SCHEMA + ", part long").repartition(5)
    got = similarity.topk_by_chunk(frame(spark, q), base, 25, "part")
    want = {(int(c), *pair) for c in set(chunk.tolist()) for pair in brute(q, x[chunk == c], np.flatnonzero(chunk == c), 25)}
    assert {(r.chunk, r.query_id, r.id) for r in got.collect()} == want


def test_ties_repeated_ids_and_small_bases(spark, two_passes):
    x = np.array([[1.0, 0.0]] * 400 + [[0.0, 1.0]] * 400 + [[0.5, 0.5]] * 400)
    q = np.array([[1.0, 0.0], [1.0, 2.0], [0.0, 0.0]])
    queries = frame(spark, q)
    ids = np.random.default_rng(1).permutation(1200)
    for k in (1, 150, 401, 1199, 1200, 5000):
        got = {(r.query_id, r.id) for r in similarity.topk(queries, frame(spark, x, ids).repartition(3), k).collect()}
        assert got == brute(q, x, ids, k)
    assert similarity.topk(queries, frame(spark, x).limit(0), 5).count() == 0
    assert similarity.topk(queries.limit(0), frame(spark, x), 5).count() == 0
    assert similarity.topk(queries, frame(spark, x[:2], [7, 7]), 5).count() == 6


def test_a_misplaced_grid_only_takes_another_pass(spark, two_passes, monkeypatch):
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(3000, 8)), rng.normal(size=(10, 8))
    want = brute(q, x, np.arange(3000), 50)
    for sample in (np.zeros((0, 8)), x[:1], 100 + x[:500], -100 + x[:500], np.zeros((50, 8))):
        monkeypatch.setattr(similarity, "sampled", lambda *a, s=sample: s)
        two_passes.clear()
        assert {(r.query_id, r.id) for r in similarity.topk(frame(spark, q), frame(spark, x), 50).collect()} == want
        assert 1 <= len(two_passes) <= 4


def test_blocks_of_queries_and_counts_handed_on_early(spark, two_passes, monkeypatch):
    monkeypatch.setattr(similarity, "PASS_BYTES", 40_000)
    monkeypatch.setattr(bounds, "HELD_BYTES", 0)
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(900, 4)), rng.normal(size=(30, 4))
    base = frame(spark, x).withColumn("part", F.col("id") % 3)
    got = {(r.query_id, r.id) for r in similarity.merge_candidates(similarity.topk_by_chunk(frame(spark, q), base, 60, "part"), 60).collect()}
    assert got == brute(q, x, np.arange(900), 60) and len(two_passes) > 2

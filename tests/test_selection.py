"""Cuts by radix selection: exact sizes, ties, odd doubles, no sort and no exchange of rows."""

import numpy as np
import pytest

from embprune.operators import selection, subsets

SCHEMA = "id long, max_sim double"


def frame(spark, pairs):
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else float(v)) for i, v in pairs], SCHEMA).repartition(5)


def by_hand(pairs, n, far):
    known = [(-0.0 if v is None else v, i) for i, v in pairs if i is not None and v is not None]
    order = sorted(known, key=lambda p: ((not np.isnan(p[0])) if far else np.isnan(p[0]), 0 if np.isnan(p[0]) else (-p[0] if far else p[0]), p[1]))
    return sorted(i for _, i in order[:n])


@pytest.mark.parametrize("kind", ["gauss", "few values", "odd", "one value", "repeated rows"])
def test_sizes_and_ties(spark, kind):
    rng = np.random.default_rng(3)
    n = 700
    ids, values = rng.permutation(10**6)[:n] - 500_000, rng.normal(size=n)
    if kind == "few values":
        values = np.round(values)
    if kind == "one value":
        values = np.full(n, 0.25)
    if kind == "odd":
        values = rng.choice([0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324, -5e-324, 1.0, -1.0, np.nextafter(1.0, 2), 1e308], n)
    if kind == "repeated rows":
        ids, values = ids % 9, np.round(values)
    pairs = list(zip(ids.tolist(), values.tolist())) + [(None, 0.0), (7, None)]
    sizes = [0, 1, 2, 333, 699, 700, 5000]
    found = subsets.subset_ladder(frame(spark, pairs), sizes)
    got: dict = {}
    for r in found.collect():
        got.setdefault((r.kind, r.size), []).append(r.id)
    for size in sizes:
        for name in ("near", "far"):
            assert sorted(got.get((name, size), [])) == by_hand(pairs, size, name == "far"), (name, size)
    assert sorted(r.id for r in subsets.prune_far(frame(spark, pairs), 41).collect()) == by_hand(pairs, 41, True)


def test_random_subsets_follow_the_hash(spark):
    import hashlib

    pool = frame(spark, [(i % 90, 0.0) for i in range(200)] + [(None, 0.0)])
    for size in (1, 50, 89, 90, 500):
        want = sorted(range(90), key=lambda i: hashlib.md5(f"5-{size}-{i}".encode()).hexdigest())[:size]
        assert sorted(r.id for r in subsets.random_subset(pool, size, 5).collect()) == sorted(want)


def test_numbers_keep_the_order_and_come_back():
    doubles = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    assert (np.diff(selection.ordered(doubles).astype(object)) > 0).all() and (selection.ordered(np.array([-0.0])) == selection.ordered(np.array([0.0]))).all()
    back = [selection.value_of(int(n), "double") for n in selection.ordered(doubles)]
    assert np.array_equal(back, doubles, equal_nan=True)
    longs = np.array([-(2**63), -1, 0, 1, 2**63 - 1])
    assert [selection.value_of(int(n), "bigint") for n in selection.ordered(longs)] == longs.tolist()


def test_passes_are_shared_and_nothing_is_sorted(spark, monkeypatch):
    rng = np.random.default_rng(4)
    passes = []
    counted = selection._counted
    monkeypatch.setattr(selection, "_counted", lambda *a: (passes.append(1), counted(*a))[1])
    found = subsets.subset_ladder(frame(spark, enumerate(rng.normal(size=3000))), [100, 200, 1000, 2000])
    assert len(passes) <= 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert subsets.subset_ladder(frame(spark, []).limit(0), [5]).count() == 0

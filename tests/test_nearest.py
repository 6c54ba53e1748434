"""Pruned nearest centres and block sums: equal to all distances, how many are computed, what is shuffled."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from embprune.functions.work import Work
from embprune.operators import kmeans, nearest, sums
from embprune.operators.nearest import grouped


def plain(x, ids, c):
    gaps = (c * c).sum(1) - 2 * x @ c.T
    return np.array([ids[np.flatnonzero(g <= g.min() + 1e-12 * abs(g.min()))].min() for g in gaps])


def clusters_of(rng, n, k, d, spread=0.05):
    """Rows about k places that lie about k / 16 others."""
    tops = rng.normal(size=(max(k // 16, 1), d)) * 4
    places = tops[rng.integers(0, len(tops), k)] + rng.normal(size=(k, d))
    return places[rng.integers(0, k, n)] + spread * rng.normal(size=(n, d)), places


@pytest.mark.parametrize("kind", ["clustered", "gauss", "equal", "zero"])
@pytest.mark.parametrize("k", [1, 5, 65, 400])
def test_nearest_equals_all_distances(kind, k):
    rng = np.random.default_rng(k)
    x, c = clusters_of(rng, 700, k, 12) if kind == "clustered" else (rng.normal(size=(700, 12)), rng.normal(size=(k, 12)))
    if kind == "equal":
        c = np.repeat(c[: max(1, k // 3)], 3, 0)[:k]
        x[: len(c)] = c
    if kind == "zero":
        x, c = np.zeros((700, 12)), np.zeros((k, 12))
    ids = rng.permutation(1000)[: len(c)]
    found = nearest.nearest(x, grouped(ids, c))
    want = plain(x, ids, c)
    assert (found.ids == want).all()
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    others = np.where(ids == want[:, None], np.inf, d).min(1)
    assert (found.others <= others + 1e-9).all()
    if kind == "clustered" and k == 400:
        assert found.computed < 0.2 * len(x) * k
    # From one table of centres to another, and the centres before these.
    split = k // 2
    if split and kind in ("clustered", "gauss"):
        one = nearest.nearest(x, grouped(ids[:split], c[:split]))
        two = nearest.nearest(x, grouped(ids[split:], c[split:]), (one.ids, one.gaps))
        assert (two.ids == want).all()
    for step in (0.0, 1e-3, 0.5):
        before = c + step * rng.normal(size=c.shape)
        g = grouped(ids, c)
        old, _ = nearest.moved(x, found, g, grouped(ids, before, g.member))
        assert (old == plain(x, ids, before)).all()


def test_a_fit_computes_few_distances_and_equals_the_plain_fit(spark):
    rng = np.random.default_rng(4)
    x, places = clusters_of(rng, 6000, 300, 16, 0.3)
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    own = x[:300].astype(float)
    centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(own)], "cluster int, center array<double>")
    work = Work(spark)
    done, means, passes = kmeans.fit(rows, centers, work=work)
    assert work.share < 0.2
    before, n = None, 0
    while True:
        at = ((own * own).sum(1) - 2 * x.astype(float) @ own.T).argmin(1)
        own = np.array([x[at == c].astype(float).mean(0) if (at == c).any() else own[c] for c in range(300)])
        n += 1
        if before is not None and (at == before).all():
            break
        before = at
    assert n == passes > 3 and {r.id: r.cluster for r in done.collect()} == dict(enumerate(at.tolist()))
    assert all(np.allclose(r.center, own[r.cluster], atol=1e-9) for r in means.collect())
    one = Work(spark)
    kmeans.assign(rows, means, one).count()
    assert 0 < one.share < 0.2


def test_a_pass_shuffles_by_clusters_not_by_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 8))
    rows = spark.createDataFrame([(i % 50, v.tolist()) for i, v in enumerate(x)], "cluster int, embedding array<double>").repartition(40)
    monkeypatch.setattr(sums, "LEAST_TASKS", 4)
    monkeypatch.setattr(sums, "TASKS_A_SLOT", 1)
    assert sums.most_tasks(rows) == 4
    held = []
    monkeypatch.setattr(kmeans, "combined", lambda parts: held.append(parts) or sums.combined(parts))
    got = {r.cluster: (r.n, r.sums) for r in kmeans.cluster_sums(rows).collect()}
    size = sum(len(r.sums) + len(r.singles) + len(r.clusters) + len(r.counts) for r in held[0].collect())
    assert size <= 4 * 50 * (8 * 8 + 4 + 16) and held[0].rdd.getNumPartitions() == 4
    for c in range(50):
        assert got[c][0] == 80 and np.allclose(got[c][1], x[c::50].sum(0))


def test_sums_that_do_not_change_are_not_sent(spark):
    rng = np.random.default_rng(7)
    x, c = clusters_of(rng, 900, 80, 6)
    points = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")
    g = grouped(np.arange(80), c)
    same = kmeans.pass_sums(points, g, g, True).collect()
    assert same == []
    shifted = grouped(np.arange(80), np.roll(c, 1, 0), g.member)
    full = {r.cluster: r for r in kmeans.pass_sums(points, g, None, False).collect()}
    delta = {r.cluster: r for r in kmeans.pass_sums(points, g, shifted, True).collect()}
    before = {r.cluster: r for r in kmeans.pass_sums(points, shifted, None, False).collect()}
    for k in full.keys() | before.keys():
        old, new = (t[k].n if k in t else 0 for t in (before, full))
        assert delta[k].n == new - old if k in delta else new == old
    assert sum(r.n_changed for r in delta.values()) == 900


def test_single_rows_leave_as_32_bit_vectors_where_they_are_such():
    total = sums.Sums()
    total.add(np.array([[0.5, 1.0], [0.1, 0.2], [1.0, 1.0], [2.0, 2.0]]), np.array([5, 7, 900_000, 900_000]), np.ones((4, 2), np.int64))
    table = pa.Table.from_batches(total.blocks())
    assert table["range"].to_pylist() == [0, 900_000 // (sums.BLOCK_BYTES // 16)] and table["n_single"].to_pylist() == [1, 0]
    again = sums.Sums()
    for batch in table.to_batches():
        again.take(batch)
        again.take(batch)
    clusters, counts, added = again.table()
    assert clusters.tolist() == [5, 7, 900_000] and counts[:, 0].tolist() == [2, 2, 4] and added.tolist() == [[1.0, 2.0], [0.2, 0.4], [6.0, 6.0]]


def plain_passes(x: np.ndarray, c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(assignment, means) of each pass until no row changes."""
    done = []
    while len(done) < 2 or (done[-1][0] != done[-2][0]).any():
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.stack([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(len(c))])
        done.append((at, c))
    return done


@pytest.fixture(scope="module")
def even(spark):
    """Rows without clusters, which take many passes, with all of these."""
    x = np.random.default_rng(10).normal(size=(4000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:6])], "cluster int, center array<double>")
    return rows, centers, plain_passes(x.astype(float), x[:6].astype(float))


def scans(monkeypatch) -> list:
    done, one = [], kmeans.pass_sums
    monkeypatch.setattr(kmeans, "pass_sums", lambda *a: done.append(a) or one(*a))
    return done


def test_a_fit_of_many_passes_takes_few_scans_and_keeps_every_pass(even, monkeypatch, spark, tmp_path):
    rows, centers, want = even
    looked, state = scans(monkeypatch), f"file://{tmp_path}/state"
    done, _, passes = kmeans.fit(rows, centers, state=state)
    assert passes == len(want) > 40 and len(looked) < passes / 2
    assert [r.cluster for r in done.orderBy("id").collect()] == want[-1][0].tolist()
    for i in (1, 2, 15, 33, passes):
        saved = kmeans.saved_centers(spark, state, i).orderBy("cluster").collect()
        assert [r.cluster for r in saved] == list(range(6)) and np.allclose([r.center for r in saved], want[i - 1][1], atol=1e-9)
        assert i == 1 or np.allclose([r.before for r in saved], want[i - 2][1], atol=1e-9)


def test_passes_that_were_reckoned_wrongly_do_not_count(even, monkeypatch):
    rows, centers, want = even
    near = kmeans.near_rows
    # The rows from which passes are reckoned miss most that change.
    monkeypatch.setattr(kmeans, "near_rows", lambda *a: near(*a)[::7])
    done, _, passes = kmeans.fit(rows, centers)
    assert passes == len(want) and [r.cluster for r in done.orderBy("id").collect()] == want[-1][0].tolist()


def test_a_resumed_fit_takes_few_scans_too(even, monkeypatch, spark, tmp_path):
    rows, centers, want = even
    state = f"file://{tmp_path}/state"
    with pytest.warns(UserWarning, match="unconverged at pass 13"):
        kmeans.fit(rows, centers, max_iterations=13, state=state)
    looked = scans(monkeypatch)
    done, _, passes = kmeans.fit(rows, None, first=13, state=state)
    assert passes == len(want) and len(looked) < (passes - 13) / 2
    assert [r.cluster for r in done.orderBy("id").collect()] == want[-1][0].tolist()

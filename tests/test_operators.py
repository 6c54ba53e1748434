"""Hand-made cases, properties and plans of the operators."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from embprune.functions import vectors
from embprune.operators import dedup, kmeans, prune, samples, similarity, subsets, zeroshot
from embprune.sources import embeddings, shards

ROWS = "id long, embedding array<float>"


def table(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


def rounded(df):
    """Sorted rows; sums of products differ in the last bits with the shape of a block."""
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    return x, table(spark, [(i, v.tolist()) for i, v in enumerate(x)]).repartition(5)


def test_normalize_and_distance(spark):
    df = table(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0])])
    got = {r.id: (r.u, r.d) for r in df.select("id", vectors.l2_normalize(F.col("embedding")).alias("u"), vectors.distance(F.col("embedding"), F.array(F.lit(0.0), F.lit(0.0))).alias("d")).collect()}
    assert got[1] == ([0.6, 0.8], 5.0) and got[2] == (None, 0.0)


@pytest.mark.parametrize("chunks", [1, 3, 11])
def test_topk_does_not_depend_on_chunks(cloud, chunks):
    x, rows = cloud
    queries, base = rows.where("id < 10"), rows.where("id >= 10")
    parts = similarity.topk_by_chunk(queries, base.withColumn("chunk", F.col("id") % chunks), 7, "chunk")
    found = {(r.query_id, r["rank"]): r.id for r in similarity.merge_candidates(parts, 7).collect()}
    s = x[:10].astype(float) @ x[10:].astype(float).T
    assert found == {(q, k + 1): int(i) + 10 for q in range(10) for k, i in enumerate(np.argsort(-s[q], kind="stable")[:7])}


def test_ties_and_small_bases(spark):
    same = table(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])
    query = table(spark, [(9, [1.0, 0.0])])
    got = similarity.topk(query, same, 5).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3, 2]
    assert similarity.topk(query, same.limit(0), 5).collect() == []
    both = table(spark, [(9, [1.0, 0.0]), (4, [1.0, 0.0])])
    assert {r.nearest_query for r in similarity.max_sims(same.where("id = 1"), both).collect()} == {4}


def test_blocks_of_queries_give_the_same(cloud, monkeypatch):
    _, rows = cloud
    queries, base = rows.where("id < 40"), rows.where("id >= 40")
    th = similarity.per_query_best(queries, base.where("id < 60"))
    runs = []
    twice = base.union(base.where("id < 50"))  # repeated ids stay rows of their own
    classes = queries.withColumnRenamed("id", "class_id")
    for block, of_pass in ((similarity.QUERY_BYTES, similarity.PASS_BYTES), (8 * 8 * 7, similarity.PASS_BYTES), (8 * 8 * 7, 8 * 8 * 15)):
        monkeypatch.setattr(similarity, "QUERY_BYTES", block)
        monkeypatch.setattr(similarity, "PASS_BYTES", of_pass)
        frames = (similarity.max_sims(twice, queries), similarity.violations(queries, base, th), similarity.topk(queries, base, 3), similarity.per_query_best(queries, base), zeroshot.predict(twice, classes))
        runs.append([rounded(df) for df in frames] + [[(i, [round(x, 9) for x in v]) for i, v in sorted(map(tuple, zeroshot.logits(twice, classes).collect()))]])
    assert runs[0] == runs[1] == runs[2] and len(runs[0][0]) == twice.count() == len(runs[0][4])


def test_fused_and_chained_violations_agree(cloud):
    _, rows = cloud
    queries, train, pool = rows.where("id % 10 = 0"), rows.where("id % 10 = 1"), rows.where("id % 10 > 2")
    th = similarity.per_query_best(queries, train)
    fused = rounded(similarity.violations(queries, pool, th))
    chained = similarity.violations_unique(similarity.threshold_candidates(similarity.topk(queries, pool, 1000), th))
    assert fused == rounded(chained) and fused
    plan = prune.prune(pool, similarity.violations(queries, pool, th))._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan


def test_threshold_is_strict_and_smallest_query_wins(spark):
    pool = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    queries = table(spark, [(4, [1.0, 0.0]), (2, [1.0, 0.0]), (7, [0.0, 1.0])])
    th = table(spark, [(4, 0.5), (2, 0.5), (7, 1.0)], "query_id long, threshold double")
    assert [tuple(r) for r in similarity.violations(queries, pool, th).collect()] == [(1, 2, 1.0)]


def test_size_report_counts_what_stays(spark):
    pool = table(spark, [(i, [1.0]) for i in range(5)])
    hits = table(spark, [("a", 1), ("a", 1), ("b", 9)], "eval_set string, id long")
    names = table(spark, [("a",), ("b",), ("c",)], "eval_set string")
    got = {r.eval_set: tuple(r)[1:] for r in prune.size_report(pool, hits, names).collect()}
    assert got == {"a": (5, 1, 4, True), "b": (5, 0, 5, True), "c": (5, 0, 5, True)}


def test_global_rank_and_subsets(spark):
    rng = random.Random(1)
    rows = table(spark, [(i, float(rng.randrange(50))) for i in range(500)], "id long, max_sim double").repartition(7)
    order = sorted(((r.max_sim, r.id) for r in rows.collect()))
    got = {r["rank"]: r.id for r in subsets.global_rank(rows, "max_sim", "id").collect()}
    assert got == {k + 1: i for k, (_, i) in enumerate(order)}
    assert "Window" not in subsets.global_rank(rows, "max_sim", "id")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    near = {r.id for r in subsets.prune_near(rows, 100).collect()}
    assert near == {i for _, i in order[:100]}
    ladder = subsets.subset_ladder(rows, [10, 100]).collect()
    assert sum(r.size == 10 for r in ladder) == 20 and {r.id for r in ladder if r.kind == "near" and r.size == 100} == near
    once, again = (sorted(r.id for r in subsets.random_subset(rows, 60, 3).collect()) for _ in range(2))
    assert once == again and len(set(once)) == 60 and subsets.random_subset(rows, 9999, 3).count() == 500


def test_dedup_is_not_greedy_and_limit_is_kept(spark):
    angle = lambda t: [float(np.cos(t)), float(np.sin(t))]
    # 1~2 and 2~3 above the limit, 1~3 below: 3 falls to 2 although 2 falls to 1.
    rows = table(spark, [(1, angle(0.0), 0), (2, angle(0.4), 0), (3, angle(0.8), 0), (4, [1.0, 0.0], 1), (5, [0.0, 1.0], 1)], ROWS + ", cluster int")
    assert sorted(r.id for r in dedup.dedup_all(rows).collect()) == [1, 4, 5]
    exact = table(spark, [(1, [1.0, 0.0], 0), (2, [0.5, 0.0], 0)], ROWS + ", cluster int")
    assert dedup.dedup_all(exact, threshold=0.5).count() == 2 and dedup.dedup_all(exact, threshold=0.51).count() == 1


def test_blocked_maxima_equal_unblocked(cloud):
    _, rows = cloud
    rows = rows.withColumn("cluster", (F.col("id") % 3 == 0).cast("int"))
    whole, blocked = (sorted((r.id, round(r.max_sim, 9)) for r in dedup.pair_maxima(rows, block_rows=n).collect()) for n in (1000, 7))
    assert whole == blocked and len(whole) == 298


def test_kmeans_reaches_a_fixed_point_and_resumes_from_its_state(cloud, spark, tmp_path):
    _, rows = cloud
    seeds, state = kmeans.seed_centers(rows, 5, 1), f"file://{tmp_path}/state"
    done, centers, n = kmeans.fit(rows, seeds)
    want = sorted((r.id, r.cluster) for r in done.collect())
    assert kmeans.change_ratio(kmeans.assign(done, centers)).first().ratio == 0 and n > 1
    with pytest.warns(UserWarning, match="unconverged at pass 2"):
        kmeans.fit(rows, seeds, max_iterations=2, state=state)
    again, _, m = kmeans.fit(rows.withColumn("more", F.lit(1)), None, first=2, state=state)
    assert m == n and sorted((r.id, r.cluster) for r in again.collect()) == want
    # The centres stored under an iteration are the means of its assignment.
    saved = kmeans.saved_centers(spark, state, 2)
    of_2 = kmeans.assign(rows, saved.select("cluster", F.col("before").alias("center")))
    means = {r.cluster: r.center for r in kmeans.update(of_2, saved).collect()}
    assert all(np.allclose(r.center, means[r.cluster]) for r in saved.collect())


@pytest.mark.parametrize("name, value", [("PASS_BYTES", 0), ("QUERY_BYTES", 128)])
def test_kmeans_does_not_depend_on_blocks_of_centres(cloud, monkeypatch, name, value):
    _, rows = cloud
    seeds = kmeans.seed_centers(rows, 5, 1)
    want = kmeans.fit(rows, seeds)
    for module in (kmeans, similarity):
        monkeypatch.setattr(module, name, value)
    got = kmeans.fit(rows, seeds)
    assert got[2] == want[2] and rounded(got[0].select("id", "cluster")) == rounded(want[0].select("id", "cluster"))


def test_rows_without_a_vector_and_no_centres(spark):
    rows = table(spark, [(1, None), (2, [1.0]), (3, [2.0]), (3, [2.0])])
    centers = table(spark, [(4, [0.0]), (2, [2.0]), (0, [0.0])], "cluster int, center array<double>")
    assert sorted(((r.id, r.cluster) for r in kmeans.assign(rows, centers).collect()), key=repr) == [(1, None), (2, 0), (3, 2), (3, 2)]
    assert {r.cluster: r.center for r in kmeans.fit(rows, centers)[1].collect()} == {0: [1.0], 2: [2.0], 4: [0.0]}
    assert {r.cluster: r.center for r in kmeans.fit(rows.limit(0), centers)[1].collect()} == {0: [0.0], 2: [2.0], 4: [0.0]}
    for f in (kmeans.assign, kmeans.fit):
        with pytest.raises(ValueError, match="no centres"):
            f(rows, centers.limit(0))
    classes = table(spark, [(7, [1.0]), (3, [1.0])], "class_id int, embedding array<float>")
    assert sorted(((r.id, r.pred) for r in zeroshot.predict(rows, classes).collect()), key=repr) == [(1, None), (2, 3), (3, 3), (3, 3)]
    assert sorted(((r.id, r.logits) for r in zeroshot.logits(rows, classes).collect()), key=repr) == [(1, None), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (3, [2.0, 2.0])]
    assert zeroshot.predict(rows, classes.limit(0)).collect() == []


def test_ragged_vectors_are_refused(spark):
    ragged, query = table(spark, [(1, [36.0]), (2, [1.0, 2.0, 3.0])]), table(spark, [(9, [0.0, 1.0])])
    with pytest.raises(Exception, match="of one length"):
        similarity.max_sims(ragged.repartition(1), query).collect()


def test_missing_thresholds_are_an_error_and_no_queries_give_no_rows(spark):
    rows = table(spark, [(1, [1.0]), (2, [0.5])])
    th = table(spark, [(1, 0.1)], "query_id long, threshold double")
    candidates = table(spark, [(2, 1, 0.5, 1)], "query_id long, id long, sim double, rank int")
    for make in (lambda: similarity.violations(rows, rows, th), lambda: similarity.threshold_candidates(candidates, th)):
        with pytest.raises(Exception, match="no threshold for query 2"):
            make().collect()
    none = rows.limit(0)
    assert similarity.violations_of_sets(none.withColumn("eval_set", F.lit("a")), rows, th).collect() == []
    assert similarity.max_sims(rows, none).collect() == [] and similarity.topk(none, rows, 3).collect() == []


def test_empty_clusters_keep_their_centre(spark):
    rows = table(spark, [(1, [0.0]), (2, [1.0])])
    centers = table(spark, [(0, [0.5]), (1, [99.0])], "cluster int, center array<double>")
    got = {r.cluster: r.center for r in kmeans.update(kmeans.assign(rows, centers), centers).collect()}
    assert got == {0: [0.5], 1: [99.0]}


def test_close_centres_are_both_replaced(spark):
    schema = "cluster int, id long, center array<double>"
    centers = table(spark, [(0, 10, [1.0, 0.0]), (1, 11, [1.0, 0.0]), (2, 12, [0.0, 1.0])], schema)
    spares = table(spark, [(0, 20, [-1.0, 0.0]), (1, 21, [0.0, -1.0])], "at int, id long, center array<double>")
    assert {r.cluster: r.id for r in kmeans.dedup_centers(centers, spares).collect()} == {0: 20, 1: 21, 2: 12}
    with pytest.raises(ValueError):
        kmeans.dedup_centers(centers, spares.limit(1))


def test_centres_are_replaced_round_by_round_as_by_hand(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, used, rounds = list(range(30)), 30, 0
    while True:
        s = x[own] @ x[own].T
        np.fill_diagonal(s, -1)
        close = np.flatnonzero((s > 0.97).any(1)).tolist()
        if not close:
            break
        for c in close:
            own[c] = used
            used += 1
        rounds += 1
    schema = "cluster int, id long, center array<double>"
    centers = table(spark, [(i, i, x[i].tolist()) for i in range(30)], schema)
    spares = table(spark, [(i - 30, i, x[i].tolist()) for i in range(30, 400)], "at int, id long, center array<double>")
    done = []
    got = kmeans.dedup_centers(centers, spares, 0.97, done)
    products = [w.done.value for w in done]
    # Only pairs with replaced centres are asked for again.
    assert len(products) == rounds + 1 and max(products[1:]) <= products[0] / 3 and products[-1] < products[1]
    assert rounds > 2 and {r.cluster: r.id for r in got.collect()} == dict(enumerate(own))


def test_shards_roll_after_an_input_shard(spark):
    counts = table(spark, [("a", 60), ("b", 60), ("c", 10)], "shard string, n long")
    got = {r.shard: r.out_shard for r in samples.assign_output_shards(counts, 100).collect()}
    assert got == {"a": 0, "b": 0, "c": 1}


def test_selection_and_labels(spark):
    docs = table(spark, [(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    listed = table(spark, [(1, 3), (1, 5), (2, 3), (2, 3), (9, 1)], "id long, cls int")
    assert sorted(r.id for r in samples.select_samples(docs, listed).collect()) == [1, 2]
    assert sorted((r.id, r.cls) for r in samples.select_labeled(docs, listed).collect()) == [(1, 3), (1, 5), (2, 3), (2, 3)]


def test_tar_round_trip_and_broken_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "LOT_BYTES", 150)
    members = table(spark, [("s", "001", "txt", b"hello"), ("s", "001", "json", b"{}"), ("s", "__meta", "x__", b"no"), ("t", "002", "txt", b""), ("v", "003", "txt", b"long" * 9999)], "shard string, key string, ext string, content binary")
    written = shards.write_tar_shards(members, f"file://{tmp_path}/out").collect()
    assert sorted((r.path, r.n_records) for r in written) == [("s.tar", 2), ("t.tar", 1), ("v.tar", 1)]
    (tmp_path / "out" / "u.tar").write_bytes((tmp_path / "out" / "v.tar").read_bytes()[:5000])
    found = shards.read_tar_shards(spark, f"file://{tmp_path}/out/*.tar")
    good = samples.decoded_only(found)
    assert sorted((r.key, r.ext, bytes(r.content)) for r in good.collect()) == [("001", "json", b"{}"), ("001", "txt", b"hello"), ("002", "txt", b""), ("003", "txt", b"long" * 9999)]
    errors = found.where("error IS NOT NULL").collect()
    assert [r.shard.rpartition("/")[2] for r in errors] == ["u.tar"] and errors[0].content is None
    numbers = samples.decode(found.withColumn("content", F.when(F.col("key") == "001", F.encode(F.lit("41"), "utf-8")).otherwise(F.col("content"))), "content", int, "bigint")
    assert sorted((r.ext, r.value) for r in samples.decoded_only(numbers).collect()) == [("json", 41), ("txt", 41)]
    assert {r.error.split(":")[0] for r in numbers.where("error IS NOT NULL").collect()} == {"ReadError", "ValueError"}


def test_chunk_paths():
    assert embeddings.chunk_paths("d/", "metadata", [3, 12, 120]) == ["d/metadata_03.parquet", "d/metadata_12.parquet", "d/metadata_120.parquet"]


def test_masks_and_accuracy(spark):
    classes = table(spark, [(0, [1.0, 0.0]), (4, [0.9, 0.1]), (7, [0.0, 1.0])], "class_id int, embedding array<float>")
    rows = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert {r.id: r.pred for r in zeroshot.predict(rows, classes).collect()} == {1: 0, 2: 7}
    allowed = table(spark, [(4,), (7,)], "class_id int")
    assert {r.id: r.pred for r in zeroshot.masked_predict(rows, classes, allowed).collect()} == {1: 0, 2: 1}
    saved = table(spark, [(0, "d", 0.5)], "epoch int, dataset string, accuracy double")
    new = table(spark, [(0, "d", 0.9), (1, "d", 0.7)], "epoch int, dataset string, accuracy double")
    assert sorted(tuple(r) for r in zeroshot.accuracy_resume(saved, new).collect()) == [(0, "d", 0.5), (1, "d", 0.7)]


def test_kmeans_goes_to_the_change_bound_and_says_where_it_does_not(cloud, spark):
    from embprune.jobs import cluster_jobs
    from embprune.jobs.registry import jobs

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    centers, before, passes = x[:8].copy(), None, 0
    while True:
        at = ((centers * centers).sum(1) - 2 * x @ centers.T).argmin(1)
        centers = np.array([x[at == c].mean(0) if (at == c).any() else centers[c] for c in range(8)])
        passes += 1
        if before is not None and (at == before).all():
            break
        before = at
    assert 3 < passes < cluster_jobs.SQL_PASSES
    want = {r.vec_id: c for r, c in zip(rows, at.tolist())}
    for name in ("kmeans_fit", "kmeans_resume"):
        assert {r.id: r.cluster for r in jobs()[name](spark, "/root/testdata/sf0.001").collect()} == want
    with pytest.warns(UserWarning, match="unconverged at pass 2"):
        kmeans.fit(cloud[1], kmeans.seed_centers(cloud[1], 5, 1), max_iterations=2)


def test_saved_accuracies_grow_by_new_epochs(spark, tmp_path):
    schema, path = "epoch int, dataset string, accuracy double", f"file://{tmp_path}/accuracies"
    one = table(spark, [(0, "a", 0.1), (0, "b", 0.2)], schema)
    two = table(spark, [(0, "a", 0.9), (1, "a", 0.3), (2, "b", 0.4)], schema)
    assert zeroshot.append_accuracies(one.limit(0), path).count() == 0
    zeroshot.append_accuracies(one, path)
    got = zeroshot.append_accuracies(two, path)
    want = [(0, "a", 0.1), (0, "b", 0.2), (1, "a", 0.3), (2, "b", 0.4)]
    assert sorted(map(tuple, got.collect())) == want and sorted(map(tuple, zeroshot.append_accuracies(two, path).collect())) == want
    with pytest.raises(Exception, match="without an epoch"):
        zeroshot.append_accuracies(table(spark, [(None, "a", 0.5)], schema), path)

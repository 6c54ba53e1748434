import random

import numpy as np
import pytest

from embprune.llm import near_dup


def brute(texts, width, percent=80):
    """(n, component position list) by comparing all pairs of full sets of strings."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        m = min(width, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def check(spark, make_docs, texts, width, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    docs = make_docs(texts, ids).withColumnRenamed("source", "kept").withColumnRenamed("lang", "digest")
    found = {r.doc_id: r for r in near_dup.near_duplicates(docs, shingle_words=width).collect()}
    sizes, comps = brute(texts, width)
    for i, n, c in zip(ids, sizes, comps):
        smallest = min(x for x, y in zip(ids, comps) if y == c)
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (n, smallest, i == smallest), texts[i]
    assert len(found) == len(ids)


def copies(rng, base, n, low, high):
    """Copies of a list of words with a share of them changed."""
    for _ in range(n):
        words = list(base)
        for i in rng.sample(range(len(words)), int(len(words) * rng.uniform(low, high))):
            words[i] = f"n{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, make_docs, texts, width):
    rng = random.Random(width)
    groups = [[f"g{g}x{rng.randrange(200)}" for _ in range(rng.choice([6, 30, 120]))] for g in range(12)]
    made = [c for g in groups for c in copies(rng, g, 12, 0.0, 0.12)]
    odd = [None, "", "  \n\t", "one", "One", "one two", "a b c d", "a b c d e", "a b c d e f", " ".join(["same"] * 5000), " ".join(["same"] * 4000), "x" * 60_000]
    every = texts[:120] + made + odd
    order = list(range(len(every)))
    rng.shuffle(order)
    check(spark, make_docs, every, width, ids=order)


def test_one_large_group_of_copies_at_the_limit(spark, make_docs, monkeypatch):
    # Copies that differ about as much as the limit: stars do not reach all of them, blocks are small.
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "SET_BYTES", 1 << 15)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    check(spark, make_docs, list(copies(rng, base, 250, 0.02, 0.09)), 2)


def test_signatures_are_near_for_similar_sets():
    rng = np.random.default_rng(4)
    far = 0
    for _ in range(2000):
        union = rng.integers(0, 1 << 63, 250, dtype=np.uint64)
        x, y = near_dup.signature(np.unique(union[:225])), near_dup.signature(np.unique(union[25:]))
        far += (x != y).sum() > near_dup.DISTANCE
    assert far == 0


def test_first_common_key_and_completeness():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (500, near_dup.SYMBOLS), dtype=np.uint8)
    y = x.copy()
    for row in y:
        at = rng.choice(near_dup.SYMBOLS, rng.integers(0, near_dup.DISTANCE + 1), replace=False)
        row[at] ^= np.uint8(1)
    kx, ky = near_dup.keys_of(x), near_dup.keys_of(y)
    first = near_dup.first_key(x == y)
    for i in range(len(x)):
        same = np.flatnonzero(kx[i] == ky[i])
        assert len(same) and first[i] == same[0] and kx[i][first[i]] >> 32 == first[i]


def test_null_and_repeated_ids(spark, make_docs):
    docs = make_docs(["a b c d", "a b c d", "a b c d", "e f g h", None, "e f g h"], ids=[5, 5, None, None, None, None])
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, shingle_words=2).collect()), key=repr)
    assert found == sorted([(5, 3, 5, True), (5, 3, 5, True), (None, 3, 5, False), (None, 3, None, True), (None, 0, None, True), (None, 3, None, True)], key=repr)


def test_empty_table_and_bad_percent(spark, make_docs):
    assert near_dup.near_duplicates(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        near_dup.near_duplicates(make_docs([]), percent=50)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    found = {r.cid: r.comp for r in near_dup.components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}


def test_many_documents_without_an_id(spark, make_docs):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(2500)]
    found = near_dup.near_duplicates(make_docs(texts * 2, ids=[None] * 5000), shingle_words=2).collect()
    assert len(found) == 5000 and all(r.component_id is None and r.n_shingles == 11 for r in found)


def test_a_hub_of_20000_links(spark):
    links = spark.range(20_000).selectExpr("id + 1 AS a", "0L AS b")
    assert near_dup.components(links).groupBy("comp").count().collect() == [(0, 20_001)]


def test_candidates_grow_with_the_copies_and_not_with_their_pairs(spark, make_docs, monkeypatch):
    # Copies of one text with 2 to 6 of 80 words changed: most pairs are at 0.6 to 0.8.
    confirmed, seen = near_dup.confirmed, []

    def counting(candidates, *more):
        seen.append(sum(len(r.bs) for r in candidates.collect()))
        return confirmed(candidates, *more)

    monkeypatch.setattr(near_dup, "confirmed", counting)
    totals = []
    for n in (300, 600):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(80)]
        texts = []
        for _ in range(n):
            words = list(base)
            for i in rng.sample(range(80), rng.randint(2, 6)):
                words[i] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        seen.clear()
        check(spark, make_docs, texts, 2)
        totals.append(sum(seen))
    assert totals[1] < 3 * totals[0] and totals[1] < 600 * 12

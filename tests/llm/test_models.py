import itertools
import math
import os
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from embprune.llm import ann, hmm, language_id, queries
from embprune.llm._shared import crc_mod5

SF = "/root/testdata/sf0.001"


def path_sum(model, seq):
    """Probability of a sequence by adding up all state paths."""
    states, total = range(len(model.start)), 0.0
    for path in itertools.product(states, repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[b, s]
        total += p
    return total


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    unit = lambda a: a / a.sum(-1, keepdims=True)
    return hmm.Model(unit(rng.random(3)), unit(rng.random((3, 3))), unit(rng.random((3, 5))))


def test_forward_is_the_sum_over_paths(model):
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 5, n) for n in (1, 7, 3, 3, 5)]
    assert np.allclose(hmm.log10_forward(model, seqs), [math.log10(path_sum(model, s)) for s in seqs])


def test_expected_counts_are_the_posterior(model):
    seq = np.array([0, 3, 3, 1, 4])
    starts, moves, emits = hmm.expected(model, [seq, seq[:2]])
    want_s, want_m, want_e = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in (seq, seq[:2]):
        whole = path_sum(model, s)
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[b, x]
            want_s[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                want_m[a, b] += p / whole
            for a, x in zip(path, s):
                want_e[x, a] += p / whole
    assert np.allclose(starts, want_s) and np.allclose(moves, want_m) and np.allclose(emits, want_e)


def lm_by_hand(docs):
    train = [hmm.tokens(t) for i, t in docs if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1]
    c = {}
    for words in train:
        for w in [*words, b""]:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in docs:
        words = [*hmm.tokens(t), b""]
        base = sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out[i] = (len(words), sum(w in c for w in words), n, base)
    return out


@pytest.mark.parametrize("tier", [hmm.TIER_WORDS, 20])
def test_scores_and_counts(spark, make_docs, texts, tier):
    docs = [*enumerate(texts[:80]), (900, None), (901, ""), (902, "word " * 30_000), (903, "unseen\x0bthing"), (904, " \n\t")]
    df = make_docs([t for _, t in docs], [i for i, _ in docs]).withColumnRenamed("source", "score")
    got = {r.doc_id: r for r in hmm.score_texts(df, crc_mod5("doc_id") == 1, iterations=2, tier_words=tier).collect()}
    want = lm_by_hand(docs)
    assert set(got) == set(want)
    for i, (n_tokens, n_known, n, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = queries.op5_hmm(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def test_symbol_and_word_probabilities_add_up(spark, make_docs):
    docs = make_docs(["a b a c", "b a d", "e"])
    counts = hmm.word_counts(docs, "text")
    corpus = hmm.corpus_of(counts)
    first = hmm.first_model(corpus, 4, 1)
    assert np.allclose(first.emit.sum(1), 1) and np.allclose(first.move.sum(1), 1)
    assert (corpus.n, corpus.v, corpus.ends) == (11, 6, 3)
    known = sum((r.c + 0.5) / (corpus.n + 0.5 * (corpus.v + 1)) for r in counts.collect())
    assert known + 0.5 / (corpus.n + 0.5 * (corpus.v + 1)) == pytest.approx(1)


def test_lm_without_training_rows(spark, make_docs):
    rows = hmm.score_texts(make_docs(["a b"]), F.lit(True)).collect()
    assert (rows[0].train_tokens, rows[0].n_known, rows[0].base_score) == (0, 0, 0.0)
    assert hmm.score_texts(make_docs([]), F.lit(False)).collect() == []


def brute_search(rows, asked, k):
    x = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in asked:
        all_ = sorted(((-float((x[q] * x[i]).sum()), i) for i in x if i != q))
        out[q] = [(i, -s) for s, i in all_[:k]]
    return out


def test_recall_against_brute_force(spark):
    got = {}
    for r in queries.op6_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute_search(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(found, found[1:]))
        x = dict(rows)
        assert all(s == pytest.approx(float(np.dot(np.array(x[q], float), np.array(x[i], float))), abs=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_hot_vectors_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0, 0.0]) for i in range(100)]
    odd = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [nan, 1.0, 0.0]), (203, [1.0, inf, 0.0]), (204, [1.0, None, 0.0]), (205, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(same + odd + [(300, [0.5, 0.5, 0.0])], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {*range(100), 300}
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[300] == [0, 1, 2, 3, 4]


def test_fewer_rows_than_k_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, df).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
    assert ann.search(df.limit(0), df.limit(0)).collect() == []


def test_partitions_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 16))[rng.integers(0, 4, 1024)] * 3 + rng.normal(size=(1024, 16))
    graph = ann.neighbour_graph(x, 10)
    label = ann.balanced_partitions(x, graph, 4)
    assert np.bincount(label).tolist() == [256] * 4
    assert (label[graph] == label[:, None]).mean() > 0.75


def test_language_id_held_out_accuracy_and_inputs(spark):
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_id_of_odd_texts(spark, make_docs):
    odd = [None, "", "123 !?", "a", "É", "中文", "the " * 50_000, "12 the and 34", "der und die"]
    profiles = language_id.learn(make_docs(["the and of in that", "der die und das ist", None, "x"], langs=["en", "de", "en", None]))
    assert set(profiles) == {"en", "de"}
    docs = make_docs(odd).withColumnRenamed("source", "score")
    got = [(r.lang_pred, r.score) for r in language_id.identify(docs, profiles).orderBy("doc_id").collect()]
    assert [g[0] == "und" for g in got] == [True, True, True] + [False] * 6
    assert got[7][0] == "en" and got[8][0] == "de" and got[0][1] == 0.0
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.learn(make_docs([])) == {} and language_id.identify(make_docs([]), profiles).collect() == []


def test_bundles_are_sums_of_bound_ngrams():
    text = "ab ab"
    grams = [(0, "a", "b"), ("a", "b", 0), (0, "a", "b"), ("a", "b", 0)]
    vec = lambda c: language_id.letter_vector(ord(c) if c else 0).astype(int)
    want = sum(np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for a, b, c in grams)
    assert np.array_equal(language_id.bundle([text, ""])[0], want) and not language_id.bundle([text, ""])[1].any()


def test_repeated_queries_and_rows_have_k_different_neighbours(spark):
    rng = np.random.default_rng(4)
    x = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(60)]
    # Longest of all: best for themselves, so that 30 copies fill the first places of their own block.
    x[0] = (0, [9.0] * 6)
    rows = spark.createDataFrame(x + [x[0]] * 30, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([x[0]] * 31 + [x[20]] * 4, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(rows, asked, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_search(x, [0], 10)
    assert got[0] == [i for i, _ in want[0]]
    # Query 20 has the 31 copies of row 0 among its rows, as often as they are there.
    sims = sorted((-sum(a * b for a, b in zip(x[20][1], v)), i) for i, v in x + [x[0]] * 30 if i != 20)
    assert got[20] == [i for _, i in sims[:10]] and set(got) == {0, 20}


def score_by_hand(docs, held, tier, own, states, iterations):
    """Scores of whole texts by plain loops over words: all words' emissions, no tiers, no segments, no batches."""
    split = {i: [*(w.decode() for w in hmm.tokens(t)), ""] for i, t in docs}
    train = [split[i] for i, _ in docs if i not in held]
    c = {}
    for words in train:
        for w in words:
            c[w] = c.get(w, 0) + 1
    ranked = sorted((w for w in c if w), key=lambda w: (-c[w], w))
    symbol = {"": 0} | {w: i + 2 for i, w in enumerate(ranked[:own])}
    corpus = hmm.Corpus(sum(c.values()), len(c), c[""], ranked[:tier], [c[w] for w in ranked[:tier]])
    start, move, emit = (x.copy() for x in vars(hmm.first_model(corpus, states, hmm.SEED)).values())
    of = lambda w: symbol.get(w, 1)
    for _ in range(iterations):
        s, m, e, g = np.full(states, 0.5), np.full((states, states), 0.5), np.full(emit.shape, 0.5), {}
        for words in train:
            f = [start * emit[:, of(words[0])]]
            for w in words[1:]:
                f.append(f[-1] / f[-1].sum() @ move * emit[:, of(w)])
            b = np.ones(states)
            for t in range(len(words) - 1, -1, -1):
                gamma = f[t] * b / (f[t] * b).sum()
                e[:, of(words[t])] += gamma
                if of(words[t]) == 1:
                    g[words[t]] = g.get(words[t], 0) + gamma
                if t:
                    pair = f[t - 1][:, None] * move * (emit[:, of(words[t])] * b)[None]
                    m += pair / pair.sum()
                    b = move @ (emit[:, of(words[t])] * b)
                    b /= b.sum()
                else:
                    s += gamma
        start, move, emit = s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True)
    rare = sum(g.values()) if g else np.zeros(states)

    def weights(w):
        return emit[:, of(w)] * ((g.get(w, 0) + 0.5) / (rare + 0.5 * (len(g) + 1)) if of(w) == 1 else 1)

    out = {}
    for i, words in split.items():
        a, total = start * weights(words[0]), 0.0
        for w in words[1:]:
            total += math.log10(a.sum())
            a = a / a.sum() @ move * weights(w)
        out[i] = total + math.log10(a.sum())
    return out


@pytest.mark.parametrize("tier, own", [(1 << 17, 1 << 15), (200, 40), (20, 1 << 15), (0, 5)])
def test_scores_equal_a_plain_computation(spark, make_docs, texts, monkeypatch, tier, own):
    monkeypatch.setattr(hmm, "STATE_WORDS", own + 2)
    docs = [(i, " ".join((t or "").split()[:60])) for i, t in enumerate(texts[:40])] + [(50, "quite unseen things"), (51, ""), (52, "a a a b a")]
    held = {i for i, _ in docs if i % 4 == 1 or i == 50}
    df = make_docs([t for _, t in docs], [i for i, _ in docs])
    got = {r.doc_id: r.score for r in hmm.score_texts(df, F.col("doc_id").isin(*held), iterations=3, tier_words=tier).collect()}
    want = score_by_hand(docs, held, tier, min(tier, own), hmm.STATES, 3)
    assert got == pytest.approx(want, rel=1e-6)


def test_symbols_are_packed_and_unpacked():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 1000):
        x = rng.integers(0, 1 << 18, n)
        assert np.array_equal(hmm.unpacked(hmm.packed(x)), x)


def test_segments_with_context_count_as_whole_texts_do(spark, make_docs, texts):
    long = [" ".join(texts[i : i + 6]) for i in range(0, 60, 6)]
    df = make_docs(long)
    corpus = hmm.corpus_of(hmm.word_counts(df, "text"))
    table = hmm.coded(df.withColumn("held_out", F.lit(False)), corpus)
    model = hmm.first_model(corpus, hmm.STATES, 1)
    for segment in (1 << 20, 1 << 20):
        model, _, _ = hmm.baum_welch_step(model, hmm.summed(hmm.expected_rows(model, table, segment=segment), "kind"))
    whole, cut = (hmm.baum_welch_step(model, hmm.summed(hmm.expected_rows(model, table, segment=n), "kind"))[0] for n in (1 << 20, 100))
    assert np.abs(whole.move - cut.move).max() < 0.01 and np.abs(whole.start - cut.start).max() < 0.02
    assert np.abs(whole.emit - cut.emit).sum() < 0.01 * whole.emit.sum()


def test_routing_reads_a_part_of_structured_data_and_finds_its_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 16_500)] * 2 + rng.normal(size=(16_500, 24))
    assert ann.partitions_for(len(x)) == 8 and ann.partitions_for(4095) == 1 and ann.partitions_for(10**12) == 256
    _, _, read = ann.fit(x[:8192], 16, 20, ann.TARGET)
    assert read < 0.4
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(rows, rows.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        sims = x @ x[q]
        sims[q] = -np.inf
        hits += len(found & set(np.argpartition(-sims, 20)[:20].tolist()))
    assert len(got) == 330 and hits >= 0.9 * 20 * 330


def cosines_by_hand(text, profiles):
    """Language and cosine from n-grams in a dictionary and vectors one by one."""
    low, vector = (text or "").lower(), np.zeros(language_id.DIM)
    letter = lambda c: language_id.letter_vector(ord(c) if c.isalpha() else 0).astype(int)
    for left, middle, right in zip("\0" + low, low, low[1:] + "\0"):
        if middle.isalpha():
            vector += np.roll(letter(left), 2) * np.roll(letter(middle), 1) * letter(right)
    cosine = {lang: float(vector @ p) / (np.linalg.norm(vector) * np.linalg.norm(p)) for lang, p in profiles.items()} if vector.any() else {}
    best = max(sorted(cosine), key=cosine.get, default="und")
    return best, min(1.0, max(0.0, cosine.get(best, 0.0)))


def test_predictions_and_scores_equal_a_plain_computation(spark, make_docs, texts, monkeypatch):
    docs = [(t or "")[:300] for t in texts[:60]] + [None, "", "1 2", "İstanbul ǅ ß", "中文字 و"]
    langs = [["en", "de", "fr"][i % 3] for i in range(len(docs))]
    profiles = language_id.learn(make_docs(docs, langs=langs))
    plain = {}
    for t, lang in zip(docs, langs):
        v = language_id.bundle([t or ""])[0]
        plain[lang] = plain.get(lang, 0) + v
    assert all(np.array_equal(profiles[x], plain[x]) for x in plain)
    # Pieces and blocks of every size give the same.
    for lot, grams in ((1 << 20, 1 << 10), (70, 7)):
        monkeypatch.setattr(language_id, "LOT_CHARS", lot)
        monkeypatch.setattr(language_id, "GRAMS", grams)
        vectors = language_id.bundle([t or "" for t in docs])
        for t, v in zip(docs, vectors):
            cos = {x: v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-12) for x, p in profiles.items()}
            want = cosines_by_hand(t, profiles)
            assert want[1] == pytest.approx(max(0.0, max(cos.values())), abs=1e-9)
    got = language_id.identify(make_docs(docs), profiles).orderBy("doc_id").collect()
    for t, r in zip(docs, got):
        lang, score = cosines_by_hand(t, profiles)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=1e-5))


def test_a_long_text_of_many_letters_stays_within_bounds():
    code = (
        "import resource, numpy as np\n"
        "from embprune.llm import language_id\n"
        "language_id.bundle(['abc'])\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "text = ''.join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FFF, 1_200_000)))\n"
        "assert language_id.bundle([text]).any()\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
    )
    took = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ)
    assert int(took.stdout) < 500


def test_columns_of_any_name_play_no_part_in_a_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    clashing = rows.selectExpr("*", "'x' AS id", "7 AS vector", "7 AS part", "7 AS row", "7 AS score", "7 AS rank", "7 AS query_id")
    assert sorted(ann.search(clashing, clashing).collect()) == sorted(ann.search(rows, rows).collect())


def test_counts_beyond_the_tier_are_exact_integers(spark):
    """Counts above 2^24 of words that the tier lacks come from a column of their own, not from the shares by state."""
    texts = ["a a a b b rare rare", "a b rare once", "b", "other"]
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    corpus = hmm.corpus_of(hmm.word_counts(df, "text"), 2)
    table = hmm.coded(df, corpus).cache()
    model = hmm.first_model(corpus, 2, 1)
    rows = hmm.expected_rows(model, table, len(corpus.words) - corpus.own)
    assert {r.token: r.c for r in hmm.summed(rows, "kind", "token").where("token IS NOT NULL").collect()} == {w: " ".join(texts).split().count(w) for w in {w for t in texts for w in t.split()} - set(corpus.words)}
    _, others, rare = hmm.baum_welch_step(model, hmm.summed(rows, "kind", "token"))
    large = 3 * 10**9 + 1
    misses = table.select("rid", F.posexplode("misses").alias("k", "token")).where("token = 'rare'")
    share = [F.lit(large / 2 * 1.0000002).cast("float").alias(f"s{s}") for s in range(2)]
    found = misses.groupBy("rid").agg(F.collect_list(F.struct("k", F.lit(large).cast("long").alias("c"), *share)).alias("found"))
    got = {r.doc_id: r.base_score for r in hmm.scored(table.join(found, "rid", "left"), hmm.scorer(model, others, rare, corpus)).collect()}
    n = {w: " ".join(texts).split().count(w) for w in corpus.words}

    def base(text):
        c = [large if w == "rare" else n.get(w, 0) for w in text.split()]
        return sum(np.log10(x + 0.5) for x in [*c, len(texts)]) - (len(c) + 1) * corpus.base_log

    assert all(abs(got[i] - base(t)) < 1e-9 for i, t in enumerate(texts) if "other" not in t and "once" not in t)

"""The stages one by one against brute force, and the whole."""

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql.functions import lit
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from embprune.llm import near_dup  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, names = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage_table(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == names and docs.schema == out[0].schema
        out.append(docs)
    return [{r.doc_id: r for r in d.collect()} for d in out]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_language_stage_drops_texts_without_letters_only(staged):
    assert set(staged[1]) == {i for i, r in staged[0].items() if any(c.isalpha() for c in r.text or "")}


def test_line_stage(staged):
    held, key = {}, lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    for i, r in staged[1].items():
        for k in {key(x) for x in r.text.split("\n")}:
            held.setdefault(k, []).append(i)
    for i, r in staged[1].items():
        want = "\n".join(x for x in r.text.split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i)
        assert staged[2][i].text == want


def test_near_dup_stage(staged):
    ids = sorted(staged[2])
    sets = [set(near_dup.shingle_set(staged[2][i].text, 5).tolist()) for i in ids]
    comp = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    assert set(staged[3]) == {ids[c] for c in comp}


def test_contamination_stage(staged, spark):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        m = min(13, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1 if m else 0)}
    for i, r in staged[3].items():
        w, hit = split(r.text), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
        assert (i in staged[4]) == (not hit or 20 * len(hit) < len(w))


def test_last_stage_and_run(staged, spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == set(staged[4])
    for i, r in staged[4].items():
        assert rows[i].n_tokens == len(library.encode(r.text, add_special_tokens=False).ids)
        assert rows[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


MORE = ["n_lines", "lang_pred", "score", "row", "n_hit", "kept", "ids", "decoded", "_row", "__doc", "__gone", "__hash"]


def test_nulls_repeats_and_clashing_columns_in_every_stage(spark, make_docs):
    line = "This line has over twenty characters"
    texts = [None, "", "a word", "a word", "12", f"{line}\nx", f"{line}\ny", f"{line}\nz", "a word"]
    ids, langs = [None, 1, 2, None, 3, 4, 5, None, 2], [None, None, "en", "en", None, "en", None, "en", "en"]
    docs = make_docs(texts, ids=ids, langs=langs).select("*", *(lit(7).alias(c) for c in MORE))
    want = [
        [(None, "a word", "en"), (None, f"{line}\nz", "en"), (2, "a word", "en"), (2, "a word", "en"), (4, f"{line}\nx", "en"), (5, f"{line}\ny", "en")],
        [(None, "a word", "en"), (None, "z", "en"), (2, "a word", "en"), (2, "a word", "en"), (4, "x", "en"), (5, f"{line}\ny", "en")],
        [(None, "z", "en"), (2, "a word", "en"), (4, "x", "en"), (5, f"{line}\ny", "en")],
        [(None, "z", "en"), (2, "a word", "en"), (4, "x", "en"), (5, f"{line}\ny", "en")],
    ]
    names = docs.columns
    for (_, stage), rows in zip(corpus_pipeline.STAGES, want):
        docs = corpus_pipeline.stage_table(stage(spark, docs, SF), "test")
        assert docs.columns == names and all(r[c] == 7 for r in docs.collect() for c in MORE)
        assert sorted(((r.doc_id, r.text, r.lang) for r in docs.collect()), key=repr) == sorted(rows, key=repr)
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in corpus_pipeline.encode_texts(spark, docs, SF).collect()) == [(0, True), (2, True), (4, True), (5, True)]
    # The stages alone, on rows that the first one drops.
    odd = make_docs([None, "", "12"], ids=[None, 1, 1])
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, SF).count() == 3
    assert all(stage(spark, make_docs([]), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_one_row_of_each_group_stays_with_repeated_and_null_ids(spark, make_docs):
    long, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    texts = [long, long, long + " x", long, other, other, third, third + " y", "", ""]
    docs = make_docs(texts, ids=[1, 1, 1, None, None, None, None, 7, 5, 5])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept, key=repr) in [sorted([(1, t), (None, other), (7, third + " y"), (5, ""), (5, "")], key=repr) for t in (long, long + " x")]


def test_language_stage_rejects_by_score_and_keeps_all_with_letters_where_no_language_is_given(spark, make_docs):
    docs = make_docs(["one text", "12", None, "zwei"], langs=[None] * 4)
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()} == {0, 3}
    texts = ["the house of the man is in the town and the child of the man is there"] * 40 + ["xq zw qj vk xx qz jw kq zx vj qk wz"] + ["the man of the house"]
    docs = make_docs(texts, langs=["en"] * 40 + [None, "en"])
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()} == {*range(40), 41}

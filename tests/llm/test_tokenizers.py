import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from embprune.llm import bpe, queries, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(BYTES)
ODD = ["", None, " ", "aaaaaaaaaaaaa aaa  aaaa\n\n\nx", "a <|endoftext|> b<|startoftext|><|endoftext|>", "\x1c \x1f'sx't 12 ½² Ⅷ", "中文字符 é 👍🏽 ՘ a₏", "ΑΣ ΣΑΣ, İ Ⱥ", "x" * 50_000, "".join(map(chr, range(1, 0x600))), "same", "same"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(BYTES)


def test_merge_results_come_after_their_parts(encoder):
    # What allows one step for all occurrences of a rank: no merge makes a pair of a lower rank.
    rank = {int(m): i for i, m in enumerate(encoder.vocab.made)}
    assert len(rank) == len(encoder.vocab.made)
    assert all(rank.get(int(x), -1) < i for side in (encoder.vocab.left, encoder.vocab.right) for i, x in enumerate(side))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab \n't", max_size=40))
def test_encoding_equals_the_library(text):
    encoder, library = bpe.Encoder(BYTES), LIBRARY
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_whole_tables(spark, make_docs, texts):
    docs = make_docs(texts + ODD).withColumnRenamed("source", "ids")
    done = bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    for r in done:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False) == (r.text or "")
    assert len(done) == len(texts) + len(ODD)
    assert bpe.encode(make_docs([]), BYTES, decoded="d").collect() == []


def test_bytes_that_are_no_text_decode_to_replacement(spark):
    half = np.array([bpe.Vocabulary(BYTES).of_byte[0xC3]], "<u4").tobytes()
    rows = bpe.decode(spark.createDataFrame([(half,), (None,)], "ids binary"), BYTES).collect()
    assert [r.decoded for r in rows] == ["\ufffd", ""]


def test_cache_can_be_forgotten(texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 50)
    encoder = bpe.Encoder(BYTES)
    once = [encoder.encode([t])[0] for t in texts[:20]]
    assert once == bpe.Encoder(BYTES).encode(texts[:20])


def test_op1_digests(spark):
    rows = {r.doc_id: r for r in queries.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    library = Tokenizer.from_file(BYTES)
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB \n\x1c't<|>é\u0301", max_size=40))
def test_units_add_up_to_the_text(text):
    library = token_counts.load(WORDS)
    units = token_counts.pre_tokens(text)
    assert sum(token_counts.lengths(library, units)) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("table_size", [0, 7, 1 << 16])
def test_counts_equal_the_library(spark, make_docs, texts, table_size):
    docs = make_docs(texts[:60] + ODD).withColumnRenamed("lang", "n_tokens")
    library = token_counts.load(WORDS)
    done = token_counts.count_tokens(docs, WORDS, limit=100, table_size=table_size).collect()
    for r in done:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 100)
    assert len(done) == 60 + len(ODD)
    assert token_counts.count_tokens(make_docs([]), WORDS).collect() == []


def test_op7_counts_every_document_as_the_library_does(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = queries.op7_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts) and found[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    for r in found:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_caches_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 100)
    own, library = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("short words", "中" * 90, "中" * 90 + "x", "é" * 300, "short words"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.chars <= max(100, len(text))
    monkeypatch.setattr(token_counts, "CACHE_CHARS", 10)
    second, path = token_counts.SecondTier(), public_tokenizers.path("word_bpe_49k.json")
    for used in ({"abcdef"}, {"ghijk", "abcdef"}, {"lmnopqrstuvwxyz"}, {"a"}):
        second.add(token_counts.load(path), used)
        assert used <= second.keys() and sum(map(len, second)) <= max(10, sum(map(len, used)))

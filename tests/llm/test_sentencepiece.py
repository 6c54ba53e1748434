"""The agenda against the sentencepiece library, on the small table, random texts and random ids."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from embprune.llm import queries, sentencepiece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n\n", "a\x00b", "▁▁ x", " " * 3000, "a" * 3000, "<s></s><unk><0x41>", "日本語のテキスト", "\U0001f600\U0001f44d\U0001f3fd", "é", "퟿x",
    "x" * 70 + " " * 70 + "\t" * 5, "=-" * 500, "word " * 100_000, "unbroken" * 20_000, "a", "a",
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def random_texts():
    rng = random.Random(3)
    return ["".join(rng.choices(letters, k=rng.randint(1, 150))) for letters in ("abcdefgh  \n\t.,;<>0x▁éßñ日\U0001f600_-=(){}", " =-_e▁", "theranding  ") for _ in range(500)]


@pytest.mark.parametrize("short", [0, sentencepiece_bpe.SHORT])
def test_both_agendas_equal_the_library(library, monkeypatch, short):
    monkeypatch.setattr(sentencepiece_bpe, "SHORT", short)
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_SIZE", 500)
    texts = [t for t in ODD if t] + random_texts()
    own = sentencepiece_bpe.Encoder(PATH)
    got = [np.frombuffer(x, "<i4").tolist() for i in range(0, len(texts), 40) for x in own.encode(texts[i : i + 40])]
    assert got == library.encode(texts) and len(own.cache) <= 20_000


def test_decoding_equals_the_library(library):
    rng = random.Random(4)
    vocab = sentencepiece_bpe.vocabulary(PATH)
    ids = [[rng.randrange(32000) if rng.random() < 0.7 else rng.randrange(262) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    assert [sentencepiece_bpe.decoded_text(np.array(x, np.int64), vocab) for x in ids] == [library.decode(x) for x in ids]


def test_columns_odd_rows_and_round_trip(spark, library):
    rows = [(i % 7, t, "kept", 5) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    done = sentencepiece_bpe.encode(docs, PATH, decoded="decoded")
    assert done.columns == ["doc_id", "text", "source", "ids", "n_tokens", "decoded"]
    for r in done.collect():
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids) and r.source == "kept" and r.decoded == library.decode(r.ids)
    again = sentencepiece_bpe.decode(done.select("ids", F.lit(1).alias("decoded"), F.col("decoded").alias("want")), PATH)
    assert again.where("decoded <> want").count() == 0 and again.count() == len(ODD)
    assert sentencepiece_bpe.encode(docs.limit(0), PATH).count() == 0
    null = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert {r.decoded for r in sentencepiece_bpe.decode(null, PATH).collect()} == {""}


def test_the_query_equals_the_library_on_the_whole_small_table(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = queries.op12_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_a_difference_from_the_library_is_an_error():
    own = sentencepiece_bpe.Encoder(PATH)
    own.cache["word"] = b"\x05\0\0\0"
    with pytest.raises(ValueError, match="otherwise"):
        own.check(["word"])

"""A corpus pipeline over `documents`: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
`documents`. `run` writes each stage's rows to the shared folder, reads them back for the next, and deletes what no later
stage reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embprune.llm import bpe, decontaminate, language_id, line_dedup, near_dup
from embprune.llm._shared import crc_mod5, drop_table, read, stage_table

#: Numbers of rows to drop that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1 << 20
ROW = "_row"


def beside_text(docs: DataFrame, *more: str) -> DataFrame:
    """(row, text, *more): all other columns as one, so that none of them meets a column that an operator makes."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text", *more)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the profiles can't tell go: those without a letter, and those below the floor of the scores.
    A document that stays and has no `lang` gets the predicted one.

    Profiles are learnt from the labelled rows of this stage's input outside crc mod 5 = 0, the floor is the smallest score
    of the labelled rows that are held out. A document that gets the language of its label stays at any score. Without
    profiles only texts without a letter go and `lang` stays null, without held-out rows there is no floor. A null or empty
    text has no letter and goes; a text of any length is judged whole; languages of one score go by name. Repeated rows are
    judged alike, each for itself; a null id counts as the empty text for the fold. An empty table stays empty. Columns beside
    those of `documents`, of any name, pass.
    """
    order = docs.columns
    profiles = language_id.learn(docs.where(crc_mod5("doc_id") != 0))
    if not profiles:
        return language_id.with_letters(docs)
    held_out = docs.where(F.col("lang").isNotNull() & (crc_mod5("doc_id") == 0))
    judged = language_id.identify(held_out.select("text"), profiles).where(F.col("lang_pred") != language_id.NONE)
    floor = judged.agg(F.min("score")).first()[0] or 0.0
    told = language_id.identify(beside_text(docs), profiles).where(F.col("lang_pred") != language_id.NONE)
    agrees = F.coalesce(F.col("lang_pred") == F.col("row.lang"), F.lit(False))
    new = {"text": F.col("text"), "lang": F.coalesce("row.lang", "lang_pred").alias("lang")}
    return told.where(agrees | (F.col("score") >= floor)).select(*(new.get(c, F.col(f"row.{c}")) for c in order))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters and more found in 3 documents stay in the last one; n_chars follows the text.

    No document goes. A null or empty text is one empty line and comes out empty; rows that share an id are documents of
    their own and keep their lines alike; a null id is below all others. Lines of a text of any length are all judged. An
    empty table stays empty. Columns beside those of `documents` pass, named n_lines or n_dropped too.
    """
    order = docs.columns
    done = line_dedup.dedup_lines(beside_text(docs, "doc_id"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")}
    return done.select(*(new.get(c, F.col(f"row.{c}")) for c in order))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one stays: that of the smallest id, nulls last.

    Rows are told apart by a number that is written once, so repeated rows and ids and null ids are copies as any other; of
    rows that share the smallest id the one of the smallest number stays. A text without words is nobody's copy and stays. Texts
    of any length are compared by all their shingles. An empty table stays empty. Columns beside those of `documents`, of any
    name, pass.
    """
    order = docs.columns
    rows = stage_table(beside_text(docs, "doc_id").withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")
    found = near_dup.near_duplicates(rows, row_col=ROW)
    gone = stage_table(found.where(~F.col("stays")).select(F.col("row").alias(ROW)), "pipeline-copies")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(side, ROW, "left_anti").select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in order))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark windows go.

    A null or empty text has no words and stays; every other one is searched whole. Repeated rows are judged alike, each for
    itself, and ids play no part. An empty table or benchmark changes nothing. Columns beside those of `documents`, of any
    name, pass.
    """
    order = docs.columns
    found = decontaminate.find_contamination(beside_text(docs), read(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*(F.col("text") if c == "text" else F.col(f"row.{c}") for c in order))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of the ids (little-endian unsigned 32-bit) and of the text decoded again.

    A null or empty text has no tokens. Rows stay one for one, repeated rows and null ids too. An empty table gives no rows.
    """
    done = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_texts),
]

#: SQL has neither the language profiles nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Roles that the jobs give to the rows of `embeddings` and `documents`."""

from __future__ import annotations

import re
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..sources.embeddings import read_embeddings
from ..sources.tables import read_table

#: Fixed values of the jobs.
TEMPLATES = [(0, "this one shows {c}"), (1, "{c}, seen from afar"), (2, "{c}, or what is left of a {c}.")]
ALLOWED = [1, 3, 4, 8]
EVAL_SETS = {0: "a", 10: "r", 20: "v2"}
BUCKETS = 256
WORDS = re.compile("[a-z0-9]+")
#: Words whose bucket a task keeps; characters of a text from which its words are taken one by one.
KNOWN_WORDS, LONG = 1 << 18, 1 << 20

#: CTEs of the same roles: v (all), q (queries), t (train), p (pool), th (threshold of each query), qs (queries by set).
SQL_ROLES = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
q AS (SELECT * FROM v WHERE id % 10 = 0), t AS (SELECT * FROM v WHERE id % 10 IN (1, 2)), p AS (SELECT * FROM v WHERE id % 10 > 2),
th AS (SELECT q.id AS query_id, max(list_dot_product(q.e, t.e)) AS threshold FROM q, t GROUP BY q.id),
qs AS (SELECT CASE id % 30 WHEN 0 THEN 'a' WHEN 10 THEN 'r' ELSE 'v2' END AS eval_set, * FROM q)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_embeddings(spark, f"{folder.rstrip('/')}/embeddings.parquet", id_col="vec_id", label_col="label")


def queries(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).where("id % 10 = 0")


def queries_by_set(spark: SparkSession, folder: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in EVAL_SETS.items() for x in kv))
    return queries(spark, folder).withColumn("eval_set", names[(F.col("id") % 30).cast("int")])


def train(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).where("id % 10 IN (1, 2)")


def pool(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).where("id % 10 > 2")


def _word_counts(buckets: int):
    """A function of batches (id, cluster, lower-case text): word counts of each text by bucket, of texts that have words."""

    class Buckets(dict):
        def __missing__(self, word: str) -> int:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = found = int(md5(word.encode()).hexdigest()[:8], 16) % buckets
            return found

    def run(batches):
        bucket = Buckets()
        for batch in batches:
            counts = np.zeros((batch.num_rows, buckets), np.int64)
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                # Of a long text the words are not held at once.
                words = WORDS.findall(text) if len(text) <= LONG else (m[0] for m in WORDS.finditer(text))
                counts[i] = np.bincount(np.fromiter((bucket[w] for w in words), np.int64), minlength=buckets)
            there = np.flatnonzero(counts.any(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * buckets), pa.array(counts[there].ravel()))
            known = batch.take(pa.array(there))
            yield pa.RecordBatch.from_arrays([known.column(0), known.column(1), lists], ["id", "cluster", "counts"])

    return run


def hashed_documents(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, cluster, embedding): word counts of documents hashed into unit vectors; the language is the cluster."""
    texts = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster"), F.lower("text").alias("text")).where("text IS NOT NULL")
    types = [texts.schema[c].dataType.simpleString() for c in ("id", "cluster")]
    counts = texts.mapInArrow(_word_counts(buckets), f"id {types[0]}, cluster {types[1]}, counts array<long>")
    # Rows of one id and language are one document.
    every = counts.groupBy("id", "cluster").agg(F.collect_list("counts").alias("every"))
    one = F.aggregate(F.slice("every", 2, F.size("every")), F.get("every", F.lit(0)), lambda s, c: F.zip_with(s, c, lambda x, y: x + y))
    return every.select("id", "cluster", l2_normalize(one).alias("embedding"))

r"""Line dedup over a corpus: levelled sorted runs of line hashes.

Lines are compared by key: the line without `[\x20\x09-\x0D]` at both ends, A-Z lower-cased, as a hash of 128 bits. Each batch
of documents becomes rows (hash, documents, largest id). They are anti-joined with the runs (a row that a run already
outvotes is not written again) and the rest is added as a run of its own. A run is a table bucketed and sorted by hash, so
these joins merge buckets where they lie: no run is shuffled again. When a level holds two runs they are merged into one
of the next level. The runs then say which lines go.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import new_path
from ._shared import arrow_columns, bound_batches, drop_table, slices, stage_table

#: Batches into which a table that comes at once is dealt, by input partition.
BATCHES = 4
#: Repeated keys that are broadcast at most (24 bytes each); with more, each document meets its own in a join.
BROADCAST_KEYS = 1 << 20
#: Stands for a null id in comparisons: it is below every other.
NO_ID = -(1 << 63)

_WS = b" \t\n\x0b\x0c\r"
_LINES = T.StructType([T.StructField("batch", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("doc", "text_hash", "h1", "h2"))])


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two signed 64-bit numbers for each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def _keys(text: str | None, min_chars: int):
    """The key of each line in order; None where it is shorter than `min_chars` code points."""
    for line in (text or "").encode().lower().split(b"\n"):
        key = line.strip(_WS)
        yield key if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars) else None


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """One row (batch, doc, text_hash, h1, h2) for each document and different key of it."""

    def run(parts):
        batch = TaskContext.get().partitionId() % batches
        for part in (p for whole in parts for p in slices(whole)):
            found = [list({k for k in _keys(text.as_py(), min_chars) if k is not None}) for text in part.column(2)]
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            h = _hashes([k for f in found for k in f])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), batch, np.int32)), *(part.column(i).take(pa.array(of)) for i in (0, 1)), pa.array(h[:, 0]), pa.array(h[:, 1])], _LINES.names)

    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(ids.alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, _LINES)


class Run:
    """A written table (h1, h2, n, top), bucketed and sorted by hash, in the shared folder."""

    def __init__(self, rows: DataFrame, buckets: int):
        self.spark, self.name = rows.sparkSession, f"line_run_{uuid.uuid4().hex}"
        path = new_path(self.spark, "line-run")
        # As many shuffle partitions as buckets: each bucket is one file.
        rows.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        drop_table(self.table)
        self.spark.sql(f"DROP TABLE {self.name}")


class LineRuns:
    """The levels, at most one run each: youngest first. `add` takes a batch of line rows."""

    def __init__(self, min_docs: int, buckets: int):
        self.min_docs, self.buckets = min_docs, buckets
        self.levels: list[Run | None] = []

    @staticmethod
    def merged(one: DataFrame, two: DataFrame) -> DataFrame:
        """Two tables of different keys each as one, by a merge of their buckets."""
        other = two.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n").alias("m"), F.col("top").alias("t"))
        both = one.join(other.hint("merge"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return both.select(F.coalesce("h1", "k1").alias("h1"), F.coalesce("h2", "k2").alias("h2"), n.alias("n"), F.greatest("top", "t").alias("top"))

    def add(self, lines: DataFrame) -> None:
        rows = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("top"))
        for run in filter(None, self.levels):
            settled = run.table.where(F.col("n") >= self.min_docs).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("top").alias("rtop"))
            rows = rows.join(settled.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("rtop") >= F.col("top")), "left_anti")
        new, level = Run(rows, self.buckets), 0
        while level < len(self.levels) and (old := self.levels[level]) is not None:
            self.levels[level], small = None, new
            new = Run(self.merged(old.table, small.table), self.buckets)
            old.drop()
            small.drop()
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = new

    def repeated(self) -> DataFrame:
        """(h1, h2, top) of the keys found in at least `min_docs` documents, from all runs. There must be one."""
        whole = reduce(self.merged, [r.table for r in self.levels if r is not None])
        return whole.where(F.col("n") >= self.min_docs).select("h1", "h2", "top")

    def drop(self) -> None:
        for run in filter(None, self.levels):
            run.drop()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """`docs` with repeated lines taken out of the text, and `n_lines` (before) and `n_dropped`.

    A key of at least `min_chars` code points found in at least `min_docs` documents loses all its lines except in the
    largest id that holds it. A null or empty text is one empty line and comes out empty. Each row is a document; rows
    that share an id are judged alike, and a null id is below all others. All other columns stay; input columns named
    n_lines or n_dropped are replaced.

    Up to `broadcast_keys` repeated keys go to all tasks, and no text is shuffled. More of them are gathered for each document
    (id and hash of the text), and the documents are joined with those.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    lines = stage_table(line_rows(docs, id_col, text_col, min_chars, batches), "lines")
    runs = LineRuns(min_docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    repeated = stage_table(runs.repeated(), "line-repeated")
    runs.drop()
    taken = {"n_lines", "n_dropped"}
    order = [c for c in docs.columns if c.lower() not in taken]
    # The caller's columns as one, so that none of them meets a column that is made here.
    whole = F.struct(*(F.col(f"`{c}`") for c in order if c != text_col)) if order != [text_col] else F.lit(0)
    held = docs.select(whole.alias("row"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__doc"))
    keys = None
    if repeated.count() <= broadcast_keys:
        table = repeated.toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])
        keys = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("h1", "h2", "top")))
        held = held.withColumn("__gone", F.lit(None).cast("array<struct<h1:bigint,h2:bigint>>"))
    else:
        known = repeated.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "top")
        gone = lines.join(known, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("doc") < F.col("top")))
        lists = gone.groupBy(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash")).agg(F.collect_set(F.struct("h1", "h2")).alias("__gone"))
        held = held.withColumn("__hash", F.xxhash64("text")).join(stage_table(lists, "line-gone"), ["__doc", "__hash"], "left").drop("__hash")
    drop_table(lines)

    def start():
        def in_table(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
            """Which hashes are repeated keys of a larger id."""
            h1, h2, top = keys.value
            out = np.zeros(len(h), bool)
            at, end = np.searchsorted(h1, h[:, 0]), np.searchsorted(h1, h[:, 0], "right")
            while len(h1) and (at < end).any():  # more than once where keys share the first 64 bits
                now = np.minimum(at, len(h1) - 1)
                out |= (at < end) & (h2[now] == h[:, 1]) & (ids < top[now])
                at = at + 1
            return out

        def work(texts, ids, gone):
            texts = [t or "" for t in texts.to_pylist()]
            found = [[(i, k) for i, k in enumerate(_keys(t, min_chars)) if k is not None] for t in texts]
            n_keys = [len(f) for f in found]
            h = _hashes([k for f in found for _, k in f])
            if keys is not None:
                drop = in_table(h, np.repeat(ids.to_numpy(), n_keys))
            else:
                listed = [{(g["h1"], g["h2"]) for g in x or ()} for x in gone.to_pylist()]
                of = np.repeat(np.arange(len(texts)), n_keys)
                drop = np.array([tuple(x) in listed[i] for x, i in zip(h.tolist(), of.tolist())], bool)
            out, n_lines, n_dropped, at = [], [], [], 0
            for text, f in zip(texts, found):
                rest = {i for (i, _), d in zip(f, drop[at : at + len(f)].tolist()) if d}
                at += len(f)
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(len(rest))
                out.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in rest) if rest else text)
            return [pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

        return work

    fields = [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    done = arrow_columns(held, ["text", "__doc", "__gone"], fields, start)
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in order), "n_lines", "n_dropped")

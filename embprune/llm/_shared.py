"""What the operators of this subpackage share: Arrow columns, counts, and the library's working tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.subsets import global_rank
from ..sources.tables import drop_table, stage_table
from ..sources.tables import read_table as read

__all__ = ["LOWER", "SLICE_BYTES", "UPPER", "arrow_columns", "bound_batches", "crc_mod5", "drop_table", "give_back", "most_frequent", "read", "slices", "stage_table", "Tables"]

#: Bytes of a batch that a worker handles at once.
SLICE_BYTES = 8 << 20
#: A-Z and a-z, for `translate`, which unlike `lower` leaves other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Tables:
    """Working tables of one operator, deleted together when its result no longer needs them."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(stage_table(df, name))
        return self.held[-1]

    def drop(self) -> None:
        for table in self.held:
            drop_table(table)
        self.held.clear()


def bound_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to workers in batches of SLICE_BYTES, where the session keeps the default of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(SLICE_BYTES))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes, which bounds what a worker makes of it at once."""
    step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker lives on, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    start: Callable[[], Callable[..., list[pa.Array]]],
    most: int = SLICE_BYTES,
) -> DataFrame:
    """`df` with columns computed batch by batch in Arrow; columns of the same names are replaced.

    `start` runs once per task and returns a function that takes the `inputs` as Arrow arrays and returns
    one array per field. All other columns pass through untouched. Batches are cut to about `most` bytes.
    """
    bound_batches(df.sparkSession)
    made = [f.name for f in fields]
    taken = {n.lower() for n in made}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in (part for whole in batches for part in slices(whole, most)):
            new = work(*(batch.column(batch.schema.get_field_index(n)) for n in inputs))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + new, keep + made)
        give_back()

    return df.mapInArrow(run, T.StructType(kept + fields))


def crc_mod5(column: str) -> F.Column:
    """crc32(id as text) mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def most_frequent(counts: DataFrame, key: str, n: str, most: int) -> list[tuple[str, int]]:
    """The `most` keys of the highest counts with these, or all there are: highest first, ties by key.

    Counts are told apart in steps of a sixteenth of a power of two. Steps that fit whole are collected; in the one in which
    `most` is passed, keys are ranked by range partitions. So no task sends more than belongs to the result.
    """
    step = F.floor(F.log2(n) * 16)
    sizes = {r.step: r.size for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("size")).collect()}
    cut, held = max(sizes, default=0) + 1, 0
    for s in sorted(sizes, reverse=True):
        if held + sizes[s] > most:
            break
        cut, held = s, held + sizes[s]
    rows = counts.where(step >= cut).select(key, n).collect() if held else []
    if held < min(most, sum(sizes.values())):
        edge = max(s for s in sizes if s < cut)
        ranked = global_rank(counts.where(step == edge).select(key, n), F.desc(n), F.asc(key), name="__place")
        rows += ranked.where(F.col("__place") <= most - held).select(key, n).collect()
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (-r[1], r[0]))

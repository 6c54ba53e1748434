"""Samples made of members (shard, key, ext, content): grouping, choosing, relabelling, packing into shards."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .subsets import global_rank


def split_name(name: Column) -> tuple[Column, Column]:
    """Sample key (name without its last extension) and extension of a member name."""
    return F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]*)$", 1)


def parse_label(text: Column) -> Column:
    """Label text as an integer; bad text is an error under ANSI rules."""
    return F.trim(text.cast("string")).cast("int")


def group_members(members: DataFrame, pos_col: str = "pos") -> DataFrame:
    """(shard, key, fields MAP ext -> content); of a repeated member name the last one read stays."""
    last = members.groupBy("shard", "key", "ext").agg(F.max_by("content", pos_col).alias("content"))
    return last.groupBy("shard", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "content")))).alias("fields"))


def first_field(fields: str, *extensions: str) -> Column:
    """The first of several extensions that a sample has."""
    return F.coalesce(*(F.col(fields)[e] for e in extensions))


def with_field(samples: DataFrame, ext: str, fields: str = "fields") -> DataFrame:
    """Samples that have a field, such as a caption (txt) or a label (cls)."""
    return samples.where(F.col(fields)[ext].isNotNull())


def map_fields(samples: DataFrame, functions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Apply the caller's function (of columns, built-in or pandas) to each named column."""
    return samples.withColumns({name: f(F.col(name)) for name, f in functions.items()})


def decode(records: DataFrame, column: str, function: Callable[[bytes], object], kind: str) -> DataFrame:
    """`records` with `value`, the caller's `function` of a binary column, and `error`, which says why there is none.

    An error of the records before stays. `kind` is the Spark type of the values.
    """
    def run(batches):
        for batch in batches:
            values, errors = [], []
            for content, before in zip(batch.column(column), batch.column("error").to_pylist()):
                value, error = None, before
                if before is None:
                    try:
                        value = function(content.as_py())
                    except Exception as e:  # whatever a decoder raises is the record's error
                        error = f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            kept = [i for i, n in enumerate(batch.schema.names) if n != "error"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(errors, pa.string()), pa.array(values, made)], [*(batch.schema.names[i] for i in kept), "error", "value"])

    records = records if "error" in records.columns else records.withColumn("error", F.lit(None).cast("string"))
    schema = T.StructType([f for f in records.schema if f.name != "error"] + [T.StructField("error", T.StringType()), T.StructField("value", T._parse_datatype_string(kind))])
    made = to_arrow_type(schema["value"].dataType)
    return records.mapInArrow(run, schema)


def decoded_only(records: DataFrame, error_col: str = "error") -> DataFrame:
    """Records that decoded; those with an error are passed over."""
    return records.where(F.col(error_col).isNull()).drop(error_col)


def first_n(ids: DataFrame, n: int, pos_col: str = "pos") -> DataFrame:
    """The first n entries of an id list in list order."""
    return ids.where(F.col(pos_col) < n)


def select_samples(samples: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Samples whose id is listed, each once however often it is listed."""
    return samples.join(ids.select(id_col).distinct(), id_col, "left_semi")


def select_labeled(samples: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """One copy of a sample for each list entry (id, cls) that names it."""
    return samples.join(ids.select(id_col, "cls"), id_col)


def fixed_shards(ranked: DataFrame, size: int, rank_col: str = "rank") -> DataFrame:
    """`out_shard` of `size` records by rank from 1."""
    return ranked.withColumn("out_shard", F.floor((F.col(rank_col) - 1) / size))


def assign_output_shards(counts: DataFrame, n_per_shard: int, n_workers: int = 1) -> DataFrame:
    """(worker, shard, out_shard, n) for input shards (shard, n): shards by name are dealt to workers in turn.

    A worker goes on to its next output shard only after an input shard has brought the present one above `n_per_shard`. The
    table has a row for each input shard; a worker's share of it is one task.
    """
    ordered = global_rank(counts.select("shard", "n"), "shard").withColumn("at", F.col("rank") - 1)
    dealt = ordered.select((F.col("at") % n_workers).cast("int").alias("worker"), "shard", F.col("n").cast("long").alias("n"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        out, shard, held = [], 0, 0
        for n in table["n"].to_pylist():
            out.append(shard)
            held += n
            if held > n_per_shard:
                shard, held = shard + 1, 0
        return pa.table({"worker": table["worker"], "shard": table["shard"], "out_shard": pa.array(out, pa.int64()), "n": table["n"]})

    return dealt.groupBy("worker").applyInArrow(pack, "worker int, shard string, out_shard long, n long")


def write_by_cluster(assigned: DataFrame, path: str, cluster_col: str = "cluster", id_col: str = "id") -> None:
    """Vectors and ids with the rows of a cluster together: range partitioned by cluster and id, so large clusters span files."""
    assigned.repartitionByRange(cluster_col, id_col).sortWithinPartitions(cluster_col, id_col).write.parquet(path)


def write_id_list(ids: DataFrame, path: str, id_col: str = "id") -> None:
    """The different ids in ascending order, file after file."""
    ids.select(id_col).distinct().repartitionByRange(id_col).sortWithinPartitions(id_col).write.parquet(path)

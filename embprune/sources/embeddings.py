"""Vector tables and the chunk files they come from."""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def read_embeddings(spark: SparkSession, *paths: str, id_col: str = "id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """(id BIGINT, embedding[, label]) of parquet chunks."""
    columns = [F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("embedding")]
    return spark.read.parquet(*paths).select(*columns, *([F.col(label_col).alias("label")] if label_col else []))


def chunk_paths(folder: str, stem: str, numbers: list[int], suffix: str = "parquet") -> list[str]:
    """Paths of numbered chunk files: numbers under 10 have two digits, longer ones stay whole."""
    return [f"{folder.rstrip('/')}/{stem}_{n:02d}.{suffix}" for n in numbers]


def metadata_files(df: DataFrame, chunk_col: str, order_col: str, stem: str = "metadata") -> DataFrame:
    """(path, content): the rows of each chunk, in order, as one numbered parquet file. A chunk must fit into a task."""

    def run(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        pq.write_table(table.sort_by(order_col), out)
        return pa.table({"path": [chunk_paths("", stem, [table[chunk_col][0].as_py()])[0].lstrip("/")], "content": pa.array([out.getvalue()], pa.binary())})

    return df.groupBy(chunk_col).applyInArrow(run, "path string, content binary")


def read_metadata(spark: SparkSession, folder: str, stem: str, numbers: list[int]) -> DataFrame:
    """The rows of numbered metadata files; one that is not there is an error."""
    return spark.read.parquet(*chunk_paths(folder, stem, numbers))


def zip_metadata(vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Vectors with the ids that metadata has at the same (chunk, pos)."""
    return vectors.join(metadata, ["chunk", "pos"])


def positional_id(chunk: Column, pos: Column, base_size: int) -> Column:
    """The id of a row of a chunk without metadata."""
    return chunk.cast("bigint") * F.lit(base_size) + pos


def folder_index(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, label) of class-per-directory files: the label is the place of the directory among the sorted ones, from 0."""
    named = files.select(F.col(path_col).alias("path"), F.element_at(F.split(path_col, "/"), -2).alias("class"))
    # One row for each class, so the single-partition rank is of a bounded table.
    classes = named.select("class").distinct().withColumn("label", F.expr("dense_rank() OVER (ORDER BY class) - 1"))
    return named.join(classes, "class").select("path", "label")

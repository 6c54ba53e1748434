"""Matrix files as a Spark data source: partitions are ranges of rows, a writer streams blocks behind a header.

A file is written under a hidden name in its folder. When all tasks are done the driver gives all files their names; if one
fails it deletes what there is, so no file ever stands under its name half done.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.blocks import matrix
from .files import LOT_BYTES, at, list_files, open_random

#: Bytes of vectors in a partition that is read.
PART_BYTES = 64 << 20
SCHEMA = "chunk long, pos long, embedding array<float>"


def chunk_number(path: str) -> int:
    """The last number in a file's name."""
    return int(re.findall("[0-9]+", path.rsplit("/", 1)[-1])[-1])


@dataclass
class _Range(InputPartition):
    """Rows `first` to `first + n` of a file whose rows of `width` values of `kind` begin at byte `begin`; with `whole`, by columns."""

    path: str
    first: int
    n: int
    begin: int
    width: int
    kind: str
    whole: bool


def _ranges(path: str, part_bytes: int) -> Iterator[_Range]:
    with open_random(path) as file:
        version = np.lib.format.read_magic(file)
        shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
        begin, width = file.tell(), math.prod(shape[1:])
    step = shape[0] if by_columns else max(1, part_bytes // max(width * kind.itemsize, 1))
    for first in range(0, shape[0], max(step, 1)):
        yield _Range(path, first, min(step, shape[0] - first), begin, width, kind.str, by_columns)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], part_bytes: int):
        self.paths, self.part_bytes = paths, part_bytes

    def partitions(self) -> list[_Range]:
        return [r for p in self.paths for r in _ranges(p, self.part_bytes)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        kind, chunk = np.dtype(part.kind), chunk_number(part.path)
        row = part.width * kind.itemsize
        step = part.n if part.whole else max(1, LOT_BYTES // max(row, 1))
        with open_random(part.path) as file:
            file.seek(part.begin + part.first * row)
            for i in range(0, part.n, step):
                n = min(step, part.n - i)
                raw = np.frombuffer(file.read(n * row), kind)
                rows = (raw.reshape((n, part.width), order="F") if part.whole else raw.reshape(n, part.width)).astype(np.float32)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * part.width)
                vectors = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).ravel()))
                pos = np.arange(part.first + i, part.first + i + n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(pos), vectors], ["chunk", "pos", "embedding"])


@dataclass
class _Written(WriterCommitMessage):
    #: (hidden path, path) of each file.
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Rows come as (chunk, order, vector), those of a chunk one after the other; `counts` has the rows of each chunk."""

    def __init__(self, folder: str, stem: str, counts: dict[str, int]):
        self.folder, self.stem, self.counts, self.job = folder.rstrip("/"), stem, counts, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = at(self.folder)
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        chunk = out = width = None
        n = 0

        def close() -> None:
            if out is not None:
                out.close()
                if n != self.counts[str(chunk)]:
                    raise ValueError(f"chunk {chunk} has {n} rows instead of {self.counts[str(chunk)]}: its rows lie in several tasks")

        try:
            for batch in iterator:
                chunks, x = batch.column(0).to_numpy(), matrix(batch.column(2)).astype(np.float32)
                for rows in np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(chunks)) + 1):
                    if len(rows) and chunks[rows[0]] != chunk:
                        close()
                        chunk, n, width = int(chunks[rows[0]]), 0, x.shape[1]
                        name = f"{self.stem}_{chunk}.npy"
                        files.append((f"{folder}/.{name}.{self.job}.{uuid.uuid4().hex}", f"{folder}/{name}"))
                        out = system.open_output_stream(files[-1][0])
                        np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (self.counts[str(chunk)], width)})
                    if x.shape[1] != width:
                        raise ValueError(f"chunk {chunk} has vectors of lengths {width} and {x.shape[1]}")
                    out.write(x[rows].tobytes())
                    n += len(rows)
            close()
        except BaseException:
            for hidden, _ in files:
                system.delete_file(hidden)
            raise
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = at(self.folder)
        for message in messages:
            for hidden, path in message.files if message else []:
                system.move(hidden, path)

    def abort(self, messages: list[_Written | None]) -> None:
        """Also what tasks have left that did not report."""
        from pyarrow import fs

        system, folder = at(self.folder)
        for found in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f".{self.job}." in found.base_name:
                system.delete_file(found.path)


class NpySource(DataSource):
    """Format `npy`. Reading: options `paths`, a JSON list of files, and `partBytes`. Writing: path, `stem`, and `counts`, JSON of the rows of each chunk."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["paths"]), int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("stem", "img_emb"), json.loads(self.options["counts"]))


def read_npy(spark: SparkSession, glob: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(chunk, pos, embedding) from files that hold one matrix each; the chunk is the last number in the name.

    Headers are read when the plan is made; a task reads `part_bytes` of rows, a block at a time, but a file in column order is one
    task. No files give no rows.
    """
    spark.dataSource.register(NpySource)
    paths = sorted(r.path for r in list_files(spark, glob).select("path").collect())
    return spark.read.format("npy").option("paths", json.dumps(paths)).option("partBytes", part_bytes).load() if paths else spark.createDataFrame([], SCHEMA)


def write_npy(df: DataFrame, folder: str, chunk_col: str, order_col: str, vector_col: str = "embedding", stem: str = "img_emb") -> None:
    """Write the vectors of each chunk, in order, as `<folder>/<stem>_<chunk>.npy`, 32-bit, with rows streamed behind the header.

    A task writes whole chunks but holds one batch of rows. Rows without a chunk or a vector are an error, as are vectors of
    different lengths in a chunk; files of the same names are replaced. `folder` is a URI that the driver and every executor reach.
    """
    df.sparkSession.dataSource.register(NpySource)
    rows = df.select(F.col(chunk_col).cast("long").alias("chunk"), F.col(order_col).alias("at"), F.col(vector_col).cast("array<float>").alias("vector"))
    # Chunks are few, as files are.
    counts = {r.chunk: r["count"] for r in rows.groupBy("chunk").count().collect()}
    if None in counts:
        raise ValueError("rows without a chunk")
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "at")
    dealt.write.format("npy").mode("append").option("stem", stem).option("counts", json.dumps(counts)).save(folder)

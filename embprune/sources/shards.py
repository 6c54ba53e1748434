"""Tar shards of samples: members to rows and rows to shards, as streams in the workers."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.work import Work, counting
from .files import LOT_BYTES, list_files, new_file, open_input, open_random
from .tables import stage_table

#: Bytes of members that a task reads; bytes between two members up to which they are read as one range.
TASK_BYTES, GAP_BYTES = 128 << 20, 1 << 16
#: Longest content of a cell.
CELL_BYTES = (1 << 31) - (1 << 16)
_INDEX = "shard string, pos long, key string, ext string, offset long, size long, error string"
_MEMBERS = "shard string, pos long, key string, ext string, content binary, error string"


def _named(member: tarfile.TarInfo) -> tuple[str, str] | None:
    """(key, extension) of a member that counts."""
    name = member.name
    if not member.isreg() or (name.startswith("__") and name.endswith("__")):
        return None
    key, dot, ext = name.rpartition(".")
    return (key, ext) if dot else (name, "")


def _headers(path: str, length: int) -> Iterator[tuple]:
    """A row for each member, by its header alone: contents are skipped. A packed shard has one row without an offset."""
    pos = -1
    try:
        with open_random(path) as file:
            if file.read(2) == b"\x1f\x8b" or file.seek(0) or file.read(3) == b"BZh" or file.seek(0) or file.read(6) == b"\xfd7zXZ\0":
                yield path, 0, None, None, None, None, None
                return
            file.seek(0)
            with tarfile.open(fileobj=file, mode="r:") as tar:
                for pos, member in enumerate(tar):
                    if member.offset_data + member.size > length:
                        raise tarfile.ReadError("unexpected end of data")
                    if (named := _named(member)) is not None:
                        error = None if member.size <= CELL_BYTES else f"ValueError: {member.size} bytes are too many for a cell"
                        yield path, pos, *named, member.offset_data, member.size, error
                    # The archive would remember every member.
                    tar.members = []
    except (tarfile.TarError, EOFError, OSError) as e:
        yield path, pos + 1, None, None, None, None, f"{type(e).__name__}: {e}"


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about LOT_BYTES."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], list(names))

    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > LOT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def index_tar_shards(spark: SparkSession, glob: str) -> DataFrame:
    """(shard, pos, key, ext, offset, size, error) for each regular member of the tar files that match; no content is read.

    Names that begin and end with `__` are passed over. The key is the name without its last extension. A shard that breaks off
    gives the members before and one row with the error. A packed shard (gzip, bzip2, xz) has one row without key and offset. The
    index is a small table: written, so that selections of it are cheap.
    """

    def run(batches):
        files = ((p, n) for batch in batches for p, n in zip(*(batch.column(i).to_pylist() for i in (0, 1))))
        yield from _batches((row for p, n in files for row in _headers(p, n)), _INDEX)

    listed = list_files(spark, glob).select("path", "length")
    return stage_table(listed.mapInArrow(run, _INDEX), "shard-index")


def _packed(path: str) -> Iterator[tuple]:
    """The members of a packed shard, as a stream."""
    pos = -1
    try:
        with open_input(path) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            for pos, member in enumerate(tar):
                if (named := _named(member)) is not None:
                    yield path, pos, *named, tar.extractfile(member).read(), None
                tar.members = []
    except (tarfile.TarError, EOFError, OSError) as e:
        yield path, pos + 1, None, None, None, f"{type(e).__name__}: {e}"


def _by_ranges(rows: list[tuple], count: Callable[[int, int], None]) -> Iterator[tuple]:
    """Members of one shard in the order of their offsets, neighbours read at once."""
    path = rows[0][0]
    with open_random(path) as file:
        at = 0
        while at < len(rows):
            begin, end, last = rows[at][4], rows[at][4] + rows[at][5], at
            while last + 1 < len(rows) and 0 <= rows[last + 1][4] - end <= GAP_BYTES and rows[last + 1][4] + rows[last + 1][5] - begin <= LOT_BYTES:
                last += 1
                end = rows[last][4] + rows[last][5]
            file.seek(begin)
            content = file.read(end - begin)
            count(len(content), 0)
            for shard, pos, key, ext, offset, size, _ in rows[at : last + 1]:
                yield shard, pos, key, ext, content[offset - begin : offset - begin + size], None
            at = last + 1


def read_members(index: DataFrame, work: Work | None = None) -> DataFrame:
    """(shard, pos, key, ext, content, error) of the rows of an index or of a selection of it, each with its error if it has one.

    Members are read by byte range, in tasks of about TASK_BYTES, however large their shard is; what is not in `index` is not
    read. A packed shard is one task. `work` counts the bytes read, and those of all members of the index.
    """
    count = counting(work)
    part = F.floor(F.coalesce("offset", F.lit(0)) / TASK_BYTES)
    total = index.agg(F.sum("size"), F.count_distinct("shard")).first()
    tasks = max(1, -(-(total[0] or 0) // TASK_BYTES), min(total[1] or 0, index.sparkSession.sparkContext.defaultParallelism))
    count(0, total[0] or 0)

    def found(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                own, known = row[:7], row[6] is None and row[4] is not None
                if held and (not known or own[0] != held[0][0] or size > TASK_BYTES):
                    yield from _by_ranges(held, count)
                    held, size = [], 0
                if known:
                    held.append(own)
                    size += own[5]
                elif own[6] is None and own[2] is None:
                    yield from _packed(own[0])
                else:
                    yield *own[:4], None, own[6]
        if held:
            yield from _by_ranges(held, count)

    rows = index.select("shard", "pos", "key", "ext", "offset", "size", "error", part.alias("part"))
    dealt = rows.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "offset")
    return dealt.mapInArrow(lambda batches: _batches(found(batches), _MEMBERS), _MEMBERS)


def read_tar_shards(spark: SparkSession, glob: str) -> DataFrame:
    """(shard, pos, key, ext, content, error) for each regular member of the tar files that match, as `index_tar_shards` names them."""
    return read_members(index_tar_shards(spark, glob))


def write_tar_shards(members: DataFrame, folder: str, shard_col: str = "shard") -> DataFrame:
    """(path, n_records): the members (shard, key, ext, content) of each shard as `<folder>/<shard>.tar`, by key and extension.

    Written when the result is read. Members of a shard pass through one task, which writes them as they come.
    """

    def run(batches):
        paths, counts = [], []
        shard = key = tar = file = None

        def close():
            tar.close()
            file.__exit__(None, None, None)

        for batch in batches:
            for s, k, ext, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if s != shard:
                    if tar is not None:
                        close()
                    shard, key = s, None
                    file = new_file(f"{folder}/{s}.tar")
                    tar = tarfile.open(fileobj=file.__enter__(), mode="w|")
                    paths.append(f"{s}.tar")
                    counts.append(0)
                counts[-1] += k != key
                key = k
                info = tarfile.TarInfo(f"{k}.{ext}")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        if tar is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "n_records"])

    rows = members.selectExpr(f"CAST({shard_col} AS STRING) AS shard", "key", "ext", "content")
    return rows.repartition("shard").sortWithinPartitions("shard", "key", "ext").mapInArrow(run, "path string, n_records long")

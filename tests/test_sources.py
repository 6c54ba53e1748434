"""Matrix files and tar shards by range: what is read, in how many tasks, and what a failed task leaves."""

import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from embprune.functions.work import Work
from embprune.operators import samples
from embprune.sources import npy, shards


def vectors(spark, n, d, chunks=1):
    part = spark.range(n).select((F.col("id") % chunks).alias("chunk"), F.col("id").alias("at"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: (F.col("id") * 7 % 1000 + j).cast("float")).alias("embedding"))
    return part.repartition(8)


def test_matrix_files_are_those_of_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(npy, "LOT_BYTES", 24)
    npy.write_npy(vectors(spark, 100, 5, 3), f"file://{tmp_path}/out", "chunk", "at")
    assert {n for n in os.listdir(tmp_path / "out") if not n.startswith(".")} == {f"img_emb_{c}.npy" for c in range(3)}
    for c in range(3):
        ids = np.arange(c, 100, 3)
        x = np.load(tmp_path / "out" / f"img_emb_{c}.npy")
        assert x.dtype == np.float32 and np.array_equal(x, (ids * 7 % 1000)[:, None] + np.arange(5))
    np.save(tmp_path / "out" / "by_columns_77.npy", np.asfortranarray(np.arange(6, dtype=np.float64).reshape(3, 2)))
    np.save(tmp_path / "out" / "half_78.npy", np.arange(6, dtype=np.float16).reshape(3, 2))
    np.save(tmp_path / "out" / "none_79.npy", np.zeros((0, 4)))
    back = npy.read_npy(spark, f"file://{tmp_path}/out/*.npy", part_bytes=60)
    got = {(r.chunk, r.pos): r.embedding for r in back.collect()}
    assert len(got) == 106 and got[77, 2] == [4.0, 5.0] and got[78, 0] == [0.0, 1.0]
    assert all(got[c, p] == [(c + 3 * p) * 7 % 1000 + j for j in range(5)] for c in range(3) for p in range(33))
    assert back.rdd.getNumPartitions() == 34 + 2  # three rows to a partition
    assert npy.read_npy(spark, f"file://{tmp_path}/out").count() == 106
    with pytest.raises(Exception, match="lengths|one length"):
        ragged = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [1.0, 2.0])], "chunk int, at int, embedding array<float>")
        npy.write_npy(ragged, f"file://{tmp_path}/out", "chunk", "at")
    with pytest.raises(ValueError, match="without a chunk"):
        npy.write_npy(ragged.withColumn("chunk", F.lit(None).cast("int")), f"file://{tmp_path}/out", "chunk", "at")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    df = vectors(spark, 400, 4, 5).withColumn("embedding", F.when(F.col("at") == 399, F.expr("CAST(array(raise_error('broken')) AS ARRAY<FLOAT>)")).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="broken"):
        npy.write_npy(df, f"file://{tmp_path}/out", "chunk", "at")
    short = vectors(spark, 10, 4, 1).withColumn("embedding", F.when(F.col("at") == 3, F.lit(None)).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="1 nulls"):
        npy.write_npy(short, f"file://{tmp_path}/out", "chunk", "at")
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_a_large_chunk_passes_through_little_memory(spark, tmp_path):
    """500,000 x 64 here as 32-bit numbers are 128 MB; a worker grows by much less."""
    import resource

    n, d = 500_000, 64
    npy.write_npy(vectors(spark, n, d), f"file://{tmp_path}/out", "chunk", "at")
    assert os.path.getsize(tmp_path / "out" / "img_emb_0.npy") == 128 + 4 * n * d
    held = npy.read_npy(spark, f"file://{tmp_path}/out/*.npy")

    def peak(batches):
        import pyarrow as pa

        rows = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], ["n", "mb"])

    found = held.mapInArrow(peak, "n long, mb long").agg(F.sum("n").alias("n"), F.max("mb").alias("mb")).first()
    assert found.n == n and found.mb < 400


@pytest.fixture
def shard(tmp_path):
    """One shard of 300 samples of 2 members."""
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for i in range(300):
            for ext, size in (("jpg", 5000 + i), ("txt", i % 7)):
                (tmp_path / "m").write_bytes(bytes([i % 256]) * size)
                tar.add(tmp_path / "m", f"{i:09d}.{ext}")
    (tmp_path / "m").unlink()
    return tmp_path


def test_selected_members_are_read_by_range_in_many_tasks(spark, shard, monkeypatch):
    monkeypatch.setattr(shards, "TASK_BYTES", 100_000)
    index = shards.index_tar_shards(spark, f"file://{shard}/*.tar")
    assert index.count() == 600 and index.agg(F.sum("size")).first()[0] == sum(5000 + i + i % 7 for i in range(300))
    whole = shards.read_members(index)
    assert whole.rdd.getNumPartitions() == 16
    assert {(r.key, r.ext): bytes(r.content) for r in whole.collect()} == {(f"{i:09d}", e): bytes([i % 256]) * n for i in range(300) for e, n in (("jpg", 5000 + i), ("txt", i % 7))}
    ids = spark.createDataFrame([(i,) for i in (3, 50, 51, 299, 299, 7777)], "id long")
    work = Work(spark)
    some = samples.select_samples(index.where("ext = 'jpg'").withColumn("id", F.col("key").cast("long")), ids)
    got = {int(r.key): len(r.content) for r in shards.read_members(some, work).collect()}
    assert got == {i: 5000 + i for i in (3, 50, 51, 299)}
    # 50 and 51 are neighbours but for the other member of 50, padding and headers.
    assert work.done.value <= sum(got.values()) + 5 * 1024 and work.possible.value == sum(got.values())


def test_packed_and_broken_shards(spark, shard):
    raw = (shard / "a.tar").read_bytes()
    for mode in ("gz", "bz2", "xz"):
        with tarfile.open(shard / f"p.{mode}.tar", f"w:{mode}") as tar:
            (shard / "m").write_bytes(b"packed" + mode.encode())
            tar.add(shard / "m", "007.txt")
            tar.add(shard / "m", "__x__")
    (shard / "cut_in_content.tar").write_bytes(raw[: 512 + 700])
    (shard / "cut_in_header.tar").write_bytes(raw[: 512 * 12 + 100])
    (shard / "no.tar").write_bytes(b"nothing" * 500)
    (shard / "empty.tar").write_bytes(b"")
    found = shards.read_tar_shards(spark, f"file://{shard}/*.tar").withColumn("shard", F.regexp_extract("shard", "[^/]*$", 0)).where("shard <> 'a.tar'").collect()
    assert {r.shard: bytes(r.content) for r in found if r.shard.startswith("p.")} == {f"p.{m}.tar": b"packed" + m.encode() for m in ("gz", "bz2", "xz")}
    assert {r.shard for r in found if r.error} == {"cut_in_content.tar", "cut_in_header.tar", "no.tar", "empty.tar"}
    assert not any(r.error for r in found if r.content is not None) and sum(r.shard == "cut_in_header.tar" and r.error is None for r in found) == 1
    assert shards.read_members(shards.index_tar_shards(spark, f"file://{shard}/a.tar").limit(0)).count() == 0

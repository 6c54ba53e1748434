import pyarrow as pa

from embprune.llm import _shared


def test_most_frequent_is_the_prefix_of_the_order(spark):
    counts = [(f"k{i}", 1 + (i * 7919) % 97) for i in range(300)]
    table = spark.createDataFrame(counts, "key string, n long")
    whole = sorted(counts, key=lambda r: (-r[1], r[0]))
    for most in (0, 1, 10, 150, 299, 300, 1000):
        got = _shared.most_frequent(table, "key", "n", most)
        assert got == whole[:most]
    one = spark.createDataFrame([(f"w{i}", 3) for i in range(1000)], "key string, n long")
    for most in (999, 1000, 1001):
        assert _shared.most_frequent(one, "key", "n", most) == sorted((f"w{i}", 3) for i in range(1000))[:most]
    assert _shared.most_frequent(table, "key", "n", 300) == whole
    assert _shared.most_frequent(table.limit(0), "key", "n", 5) == []


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 500)], ["t"])
    parts = list(_shared.slices(batch, 10_000))
    assert sum(p.num_rows for p in parts) == 500 and len(parts) > 40
    assert list(_shared.slices(batch.slice(0, 0))) == []


def test_working_tables_can_be_dropped(spark):
    table = _shared.stage_table(spark.range(5), "test")
    assert table.count() == 5
    _shared.drop_table(table)
    assert not list(__import__("pathlib").Path(table.inputFiles()[0].removeprefix("file://")).parent.glob("*.parquet"))

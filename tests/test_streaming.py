from pyspark.sql import functions as F

from embprune.jobs import roles
from embprune.operators import prune, similarity
from embprune.streaming.prune_stream import prune_stream

SF = "/root/testdata/sf0.001"


def test_stream_keeps_what_the_batch_keeps(spark, tmp_path):
    queries, pool = roles.queries(spark, SF), roles.pool(spark, SF)
    limits = similarity.per_query_best(queries, roles.train(spark, SF))
    for n in range(3):
        pool.where(F.col("id") % 3 == n).withColumn("embedding", F.when(F.col("id") != 4, F.col("embedding"))).write.parquet(str(tmp_path / f"in/part={n}"))
    stream = spark.readStream.schema(pool.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    done = prune_stream(stream, queries, limits).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
    done.awaitTermination()
    kept = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = prune.prune(pool, similarity.violations(queries, pool, limits).where("id <> 4"))
    assert kept == sorted(r.id for r in want.collect()) and 0 < len(kept) < pool.count()

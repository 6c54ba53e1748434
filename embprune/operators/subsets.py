"""Subsets of exact size: random, nearest, farthest, by exact cuts; and a global rank that no single task computes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage_table
from .selection import Cut, select

_IN_PARTITION = (1 << 33) - 1


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """`df` with the place of each row, from 1, in the order of `order`, which should have no ties.

    Rows are range partitioned, sorted and written, so that their places hold; then partition counts give offsets.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = stage_table(ranged, "ranked").withColumn("__part", F.shiftright("__at", 33))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    # One row for each partition, so this window is small.
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit(_IN_PARTITION)) + 1
    return ranged.join(F.broadcast(before), "__part").withColumn(name, place).drop("__part", "__at", "__before")


def chunk_numbers(df: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """`df` with `chunk`: output chunks of `size` rows in that order, from 0."""
    return global_rank(df, *order, name="__rank").withColumn("chunk", F.floor((F.col("__rank") - 1) / size)).drop("__rank")


def prune_near(max_sims: DataFrame, n: int) -> DataFrame:
    """The n ids of the lowest max_sim, ties to the smaller id; rows without either take no part."""
    return subset_ladder(max_sims, [n], ["near"]).select("id")


def prune_far(max_sims: DataFrame, n: int) -> DataFrame:
    """The n ids of the highest max_sim, ties to the smaller id; rows without either take no part."""
    return subset_ladder(max_sims, [n], ["far"]).select("id")


def subset_ladder(max_sims: DataFrame, sizes: list[int], kinds: Sequence[str] = ("near", "far")) -> DataFrame:
    """(kind, size, id) for kinds near and far and all sizes: exactly `size` rows, or all there are.

    (id, max_sim) is written once; the cuts of all kinds and sizes come from shared counts (`selection`), without a sort.
    """
    rows = stage_table(max_sims.select(F.col("id").cast("long").alias("id"), F.col("max_sim").cast("double").alias("max_sim")), "max-sims")
    cuts = [(Cut(s, down=kind == "far"), [F.lit(kind).alias("kind"), F.lit(s).cast("long").alias("size")]) for kind in kinds for s in sizes]
    return select(rows, ["max_sim", "id"], cuts, ["id"])


def random_subset(pool: DataFrame, size: int, seed: int) -> DataFrame:
    """Exactly `size` distinct ids, or all there are, in the order of a hash of seed, size and id: repeatable. Null ids take no part."""
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(size)), F.col("id").cast("string")))
    # The hash as two words; hex digits order as the unsigned numbers do.
    halves = [F.conv(F.substring("key", at, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63))).alias(name) for at, name in ((1, "high"), (17, "low"))]
    ids = pool.select(F.col("id").cast("long").alias("id")).distinct().withColumn("key", key).select("id", *halves)
    return select(stage_table(ids, "hashed-ids"), ["high", "low", "id"], [(Cut(size), [])], ["id"])

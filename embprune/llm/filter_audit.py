"""Audit of how filters interact: what each removes in every order, what others would have removed, and Shapley counts.

A document's failures are a mask of one bit for each filter. Over the documents of a part, 32 signed parity sums (one for each
set of filters: +1 for an even number of failures in the set, -1 for an odd one) are the Walsh-Hadamard transform of the numbers of
documents of each mask. They are aggregated by Spark, map-side first; the transform is its own inverse but for a factor of 32,
so the numbers of all masks come back exactly. All orders of the filters are evaluated on these cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import UPPER, stage_table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Limits of the filters A to C and the signs that D looks for.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
#: Orders of five filters: a document that fails f of them counts for each in 120 / f orders.
ORDERS = 120


def text_failures(text: Column) -> Column:
    """The mask of the filters A to D, which see one text: bit 0 is A's."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    counts = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct"))), F.lit(0))
    few = F.get(F.transform(F.array(counts), lambda c: F.when(c["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * c["distinct"] < LEAST_DISTINCT * c["n"].cast("long"), 2).otherwise(0)), F.lit(0))
    size = F.char_length(text).cast("long")
    capitals = size - F.char_length(F.translate(text, UPPER, ""))
    return few + F.when(100 * capitals > MOST_CAPITALS * size, 4).otherwise(0) + F.when(text.rlike(SIGNS), 8).otherwise(0)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask), a row for each document; a written table stands in between, so a text is read once.

    A copy fails E unless its id is the smallest of its text; texts are told apart by SHA-256. The one that stays is found by text
    and id together, so that a text with very many copies is dealt over all tasks.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("mask"), F.sha2(text.cast("binary"), 256).alias("sha"))
    rows = stage_table(rows, "audit-rows")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "bad"))))
    found = rows.join(first, ["sha", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    return found.select("part", F.coalesce("good", no).alias("good"), F.coalesce("bad", no).alias("toxic"), (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def _sign(mask: Column | int, subset: Column | int) -> Column:
    both = F.lit(mask).bitwiseAND(F.lit(subset))
    return F.lit(1).cast("long") - 2 * F.bit_count(both).bitwiseAND(F.lit(1))


def parity_sums(failed: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): the 32 signed sums of each part and label."""
    sums = F.array(*(F.sum(_sign(F.col("mask"), s)) for s in range(MASKS))).alias("sums")
    return failed.groupBy("part", "good", "toxic").agg(sums)


def cells(sums: DataFrame) -> DataFrame:
    """(part, n, good, toxic): numbers of documents of each mask, arrays of 32: all, of good quality, toxic."""
    masks = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def inverse(s: Column) -> Column:
        of = lambda m: F.aggregate(masks, F.lit(0).cast("long"), lambda total, k: total + _sign(m, k) * F.get(s, k))
        return F.transform(masks, lambda m: (of(m) / MASKS).cast("long"))

    known = sums.select("part", "good", "toxic", inverse(F.col("sums")).alias("n"))
    total = lambda of: F.array(*(F.sum(F.when(of, F.get("n", F.lit(m))).otherwise(0)) for m in range(MASKS)))
    return known.groupBy("part").agg(total(F.lit(True)).alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))


def _steps() -> Column:
    """All orders and steps as an array of (filter_order, step, bit, before): the step's bit and those of the steps before it."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            found.append(f"named_struct('filter_order', '{''.join(FILTERS[x] for x in order)}', 'step', {step}, 'bit', {1 << f}, 'before', {before})")
            before |= 1 << f
    return F.expr(f"array({', '.join(found)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    `docs` has doc_id, text and lang, `labels` doc_id, quality and toxic; further columns play no part. A row for each value of
    lang, order and step, whatever the counts. A null text is empty: it fails A alone, and E where a smaller id is empty
    too; a null lang is the empty one. A null id is no copy and makes none, rows that share the smallest id of a text are all
    first. Several labels of an id count as good, or toxic, if one is; labels of unknown ids and null ids play no part. A text of any
    length is judged whole. No documents give no rows.
    """
    table = cells(parity_sums(failures(docs, labels)))
    at = F.explode(_steps()).alias("s")
    masks = F.sequence(F.lit(0), F.lit(MASKS - 1))
    bit, before, none = F.col("s.bit"), F.col("s.before"), F.lit(0)

    def total(column: str, hit, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(masks, F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(hit(m), F.get(column, m) * weight(m)).otherwise(0))

    fails = lambda m: m.bitwiseAND(bit) != none
    gone = lambda m: m.bitwiseAND(before) != none
    here = lambda m: fails(m) & ~gone(m)
    return table.select("*", at).select(
        "part",
        "s.filter_order",
        "s.step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", fails, lambda m: (F.lit(ORDERS) / F.bit_count(m)).cast("long")).alias("shapley"),
    )

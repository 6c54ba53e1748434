"""Audit of how the sources of each language differ: term frequencies of every pair of sources, and terms that mark a source.

Words are counted by (lang, source, term), map-side first. The counts of a term are then one row with an array by source: the
wide vector. On it the JVM's higher-order functions compute all smoothed frequencies and emit the contribution of each pair of
sources, which are summed map-side. All arithmetic is exact: integers, and decimals where a product passes 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, Tables

#: Documents that a kept term is in, what is added to each count, the scale of frequencies, ranks of terms.
LEAST_DOCS, ADDED, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Numbers of groups (lang, source) whose array may be broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 1 << 16


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and numbers of documents. The words of a text come sorted, each beside the one before it,
    so that the first of each term counts the document."""
    words = F.sort_array(F.array_remove(F.split(F.translate("text", UPPER, LOWER), BETWEEN), ""))
    some = docs.select("lang", "source", words.alias("words")).where(F.size("words") > 0)
    before = F.concat(F.array(F.lit("")), F.slice("words", 1, F.size("words") - 1))
    one = some.select("lang", "source", F.explode(F.arrays_zip(F.col("words").alias("term"), before.alias("before"))).alias("w"))
    return one.groupBy("lang", "source", "w.term").agg(F.count("*").alias("n"), F.count_if(F.col("w.term") != F.col("w.before")).alias("docs"))


def wide_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, by): the terms in at least `least` documents of their language, with their counts by source as a map."""
    pairs = F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by")
    return counts.groupBy("lang", "term").agg(pairs, F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")


def _frequency(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), in decimals."""
    up = (count + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, (total + ADDED * kept).cast("decimal(20,0)")) + 1


def frequencies(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(groups, vectors): (lang, sources, totals, kept) for each language, sources in ascending order; and (lang, term, sources,
    counts, p, q) for each kept term: arrays by source, and the language's own frequency q."""
    terms = tables.stage(wide_terms(count_terms(docs)), "divergence-terms")
    groups = docs.select("lang", "source").distinct()
    totals = terms.select("lang", F.explode("by").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    each = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    listed = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("each"))
    known = listed.join(kept, "lang", "left").select("lang", F.col("each.source").alias("sources"), F.col("each.n").alias("totals"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))
    known = tables.stage(known, "divergence-groups")
    size = known.agg(F.sum(F.size("sources"))).first()[0] or 0
    both = terms.join(F.broadcast(known) if size <= BROADCAST_GROUPS else known, "lang")
    counted = both.withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.col("by")[s], F.lit(0).cast("long"))))
    p = F.transform(F.arrays_zip("counts", "totals"), lambda x: _frequency(x["counts"], x["totals"], F.col("kept")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    q = _frequency(total(F.col("counts")), total(F.col("totals")), F.col("kept"))
    return known, tables.stage(counted.select("lang", "term", "sources", "counts", p.alias("p"), q.alias("q")), "divergence-vectors")


def pair_sums(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each ordered pair of sources of a language the summed differences of frequencies."""
    n = F.size("sources")
    later = lambda i: F.sequence(i + 1, n - 1)
    emit = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(later(i), lambda j: F.struct(i.alias("i"), j.alias("j"), F.abs(F.get("p", i) - F.get("p", j)).alias("f")))))
    sums = vectors.where(n > 1).select("lang", F.explode(emit).alias("e")).groupBy("lang", "e.i", "e.j").agg(F.sum("e.f").alias("f"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(later(i), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("sources", i).alias("a"), F.get("sources", j).alias("b")))))
    every = groups.where(n > 1).select("lang", F.explode(pairs).alias("e")).select("lang", "e.*")
    summed = every.join(sums, ["lang", "i", "j"], "left").withColumn("f", F.coalesce("f", F.lit(0)).cast("long"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", ways.alias("w"), F.col("f").alias("value")).select("lang", "w.source", "w.item", "value")


def marking_terms(vectors: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a source has, and more often than its language."""
    of = F.transform("sources", lambda s, i: F.struct(s.alias("source"), F.get("counts", i).alias("n"), (F.get("p", i) - F.col("q")).alias("value")))
    more = vectors.select("lang", "term", F.explode(F.filter(of, lambda x: (x["n"] > 0) & (x["value"] > 0))).alias("x"))
    return more.select("lang", "x.source", F.col("term").alias("item"), "x.value")


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has all other sources of the language, `term` the 50 terms that mark the source.

    `docs` has text, lang and source; further columns play no part. Nulls are empty strings: a group of that name, a text
    without terms. A text of any length counts whole, repeated rows count each. Equal values go by item in the order of
    UTF-8. A language whose terms are all in fewer than 30 documents has pairs of value 0; one with a single source has no
    pairs. No documents give no rows.
    """
    tables = Tables()
    groups, vectors = frequencies(docs.select(_empty("text"), _empty("lang"), _empty("source")), tables)

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))

    return ranked(pair_sums(groups, vectors), "pair").union(ranked(marking_terms(vectors), "term").where(F.col("rank") <= MOST_TERMS))

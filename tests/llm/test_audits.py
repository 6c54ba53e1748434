"""Filter audit and source divergence against their SQL and brute force, on hand-made cases and the small tables."""

from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from embprune.llm import filter_audit, queries, source_divergence

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def by_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("name, tables", [("op11_filter_audit", ["documents", "labels"]), ("op13_source_divergence", ["documents"])])
def test_small_tables_equal_the_sql(spark, name, tables):
    want = by_duckdb(queries.oracle_sql()[name], **{t: spark.read.parquet(f"{SF}/{t}.parquet") for t in tables})
    assert rows(queries.queries()[name](spark, SF)) == want


LONG = " ".join(f"w{i}" for i in range(250))
CASES = [
    (0, LONG, "en"), (1, LONG, "en"), (1, LONG, "en"), (2, LONG.upper(), "en"), (3, "a b " * 150, "de"), (4, "a # b", None), (5, "", ""), (6, None, "en"), (7, "ABC", "en"),
    (None, LONG, "en"), (None, "only nulls", "en"), (8, "only nulls", "en"), (9, "a b " * 300, "de"), (10, LONG, None), (0, LONG, "de"), (11, "x " * 200_000 + "|", "en"), (12, "ÄÖ " * 220, "de"),
]
LABELS = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (3, 1, None), (None, 1, 1), (99, 1, 1), (6, 1, 0), (10, 0, 1)]


def mask_of(doc_id, text, docs):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    smaller = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)
    failing = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), smaller]
    return "".join(f for f, hit in zip("ABCDE", failing) if hit)


def test_filter_audit_equals_going_through_every_order(spark):
    docs = spark.createDataFrame([(i, t, lang, 1, 2) for i, t, lang in CASES], "doc_id long, text string, lang string, mask int, good int").withColumn("sha", F.lit("x"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("p"))
    good, toxic = ({d for d, *v in LABELS if v[k] == 1 and d is not None} for k in (0, 1))
    want = {}
    for part in {lang or "" for _, _, lang in CASES}:
        own = [(i, mask_of(i, t, CASES)) for i, t, lang in CASES if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                hit = [i for i, m in left if f in m]
                gone = sum(f in m for _, m in own) - len(hit)
                left = [(i, m) for i, m in left if f not in m]
                shapley[f] += len(hit)
                want[part, order, step] = [len(left), len(hit), gone, sum(m == f for _, m in own), sum(i in good for i in hit), sum(i in toxic for i in hit)]
        for (p, order, step), counts in want.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    found = filter_audit.audit(docs, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): list(r[3:]) for r in found.collect()} == want and found.count() == 3 * 600
    plain = docs.select("doc_id", "text", "lang")
    assert rows(filter_audit.audit(plain, labels)) == by_duckdb(queries.OP11_SQL, documents=plain, labels=labels)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0 and filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_cells_come_back_from_the_parity_sums(spark):
    failed = spark.createDataFrame([("p", bool(m % 3), m % 2 == 0, m) for m in range(32) for _ in range(m * m + 1)], "part string, good boolean, toxic boolean, mask int")
    (cell,) = filter_audit.cells(filter_audit.parity_sums(failed)).collect()
    assert cell.n == [m * m + 1 for m in range(32)]
    assert cell.good == [(m * m + 1) * bool(m % 3) for m in range(32)] and cell.toxic == [(m * m + 1) * (m % 2 == 0) for m in range(32)]


def test_source_divergence_of_odd_rows(spark):
    many = [(i, f"Shared word{i % 2} {'only' if i % 3 == 0 else ''} Été a1b", "en", f"s{i % 4}", 0) for i in range(130)]
    odd = [(900, None, "en", "s9", 0), (901, "shared " * 50_000, "en", None, 0), (902, "few words", "de", "a", 0), (903, "few", "de", "b", 0), (904, "alone", "fr", "c", 0), (905, "", None, None, 0), (None, "Shared", "en", "s1", 0)]
    ties = [(i, "beta alpha älpha \U0001f600 ￮", "es", f"t{i % 2}", 0) for i in range(60)]
    repeated = [(1, "twice again", "it", "x", 0)] * 30 + [(2, "twice", "it", "y", 0)]
    docs = spark.createDataFrame(many + odd + ties + repeated, DOCS).withColumnRenamed("n_chars", "words").withColumn("by", F.lit(1))
    found = source_divergence.divergence(docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows(found) == by_duckdb(queries.OP13_SQL, documents=docs)
    by = {(r.lang, r.source, r.part, r.item): r for r in found.collect()}
    assert by["de", "a", "pair", "b"].value == 0 and ("en", "", "pair", "s9") in by
    assert not any(k[0] in ("fr", "") for k in by) and ("it", "x", "pair", "y") in by
    assert source_divergence.divergence(docs.limit(0)).count() == 0


def test_source_divergence_without_a_broadcast_and_with_large_counts(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "BROADCAST_GROUPS", 0)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(source_divergence.divergence(docs)) == by_duckdb(queries.OP13_SQL, documents=docs)
    big = spark.range(1).select(*(F.lit(x).cast("long").alias(n) for n, x in (("c", 9 * 10**15), ("t", 9 * 10**15 + 7), ("k", 10**9))))
    got = big.select(source_divergence._frequency(F.col("c"), F.col("t"), F.col("k"))).first()[0]
    assert got == 1 + 10**9 * (9 * 10**15 + 5) // (9 * 10**15 + 7 + 5 * 10**9)

import hashlib
import re

import duckdb
import pytest
from pyspark.sql.functions import lit

from embprune.llm import decontaminate, line_dedup, queries, url_filter
from embprune.llm.url_filter import Rule


def by_duckdb(spark, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in out.fetchall()), key=repr)


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


WORDS = [f"w{i}" for i in range(40)]
BENCH = [(1, " ".join(WORDS[:20])), (2, "Short item here"), (3, None), (4, ""), (5, "..."), (6, "one"), (6, " ".join(WORDS[5:20])), (7, " ".join(["a"] * 15)), (None, "null item text")]
TEXTS = [
    None, "", "...", " ".join(WORDS[:13]), " ".join(WORDS[:12]), "x " * 300 + " ".join(WORDS[3:18]), "SHORT, item-here!", "short item", "One", "a " * 40, "a " * 14 + "b " + "a " * 12,
    " ".join(WORDS[:13]) + " y " + " ".join(WORDS[:13]), "Éone one", "null item text", "z " * 30_000 + " ".join(WORDS[:20]), " ".join(WORDS[:13]), " ".join(WORDS[:13]),
]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 200])
def test_decontamination_equals_brute_force(spark, make_docs, block_bytes):
    docs, bench = make_docs(TEXTS).withColumnRenamed("lang", "n_hit"), spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, block_bytes=block_bytes)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for r in found.collect():
        words, hit, items = split(r.text), set(), set()
        for item, text in BENCH:
            w = split(text)
            m = min(13, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for j in range(len(words) - m + 1):
                    if words[j : j + m] == w[i : i + m]:
                        hit |= set(range(j, j + m))
                        items.add("" if item is None else str(item))
        assert (r.n_words, r.n_hit, r.item_ids) == (len(words), len(hit), sorted(items))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words)) and r.n_items == len(items)


def test_decontamination_equals_sql(spark, make_docs, tmp_path):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = make_docs(TEXTS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert rows(queries.op3_decontamination(spark, str(tmp_path))) == by_duckdb(spark, queries.OP3_SQL, documents=docs, benchmark=bench)


def test_decontamination_of_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.find_contamination(make_docs(["a b"]), bench).collect()] == [False]
    assert decontaminate.find_contamination(make_docs([]), bench).collect() == []


URLS = [
    None, "", "no scheme", "http://example.org/es/1", "HTTP://Example.ORG/en/1?x#y", "http://a.example.org/en/2", "http://org/", "http://org", "http://borg/x", "http://x.com/fr/", "http://x.com/de/9",
    "http://www.bad.net/p/", "http://bad.net/p?q", "https://bad.net/p#f", "http://bad.net/P", "a://b://c/d", "http://é.net/ü/", "http://bad.net/p", "http://bad.net/p", "://", "http://x.net?a=http://bad.net/p",
]
RULES = queries.RULES


def judged_by_hand(url, listed):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    plain = re.sub(r"^www\.", "", host) + path.rstrip("/")
    return host, path, best and best.text, best.action if best else "block" if plain and plain in listed else "allow"


@pytest.mark.parametrize("listed", [["bad.net/p", "bad.net/p", None, "", "é.net/ü"], []])
def test_url_verdicts(spark, listed):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' AS rule", "1 AS canonical")
    done = url_filter.filter_urls(pages, spark.createDataFrame([(x,) for x in listed], "canonical string"), RULES)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in done.collect()}
    assert found == {i: judged_by_hand(u, set(listed)) for i, u in enumerate(URLS)}
    assert "PythonUDF" not in done._jdf.queryExecution().toString() and "MapIn" not in done._jdf.queryExecution().toString()


def test_bloom_filter_has_no_false_negatives_and_a_bound(spark):
    listed = spark.range(20_000).selectExpr("concat('h.net/', id) AS canonical")
    bloom, blocks = url_filter.bloom_filter(listed, max_blocks=64)
    assert blocks == 64 and bloom.count() <= 64
    pages = spark.range(40_000).selectExpr("id AS page_id", "concat('http://h.net/', id) AS url")
    done = url_filter.filter_urls(pages, listed, [Rule("allow", "none", "/")], max_blocks=64)
    assert done.where("verdict = 'block'").count() == 20_000 == done.where("verdict = 'block' AND page_id < 20000").count()


LINE = "This line has over twenty characters"
LINES = [
    None, "", "\n", f"{LINE}\nshort", f"  {LINE.upper()}\t\nother text of this document, long", f"{LINE}\n{LINE}\nx", f"x\n{LINE}", "short\nshort", "short", "short", "é" * 19 + "\nÉ" * 3, "é" * 20, "é" * 20, "é" * 20 + "\r", "É" * 20,
    "a" * 100_000, f"\x0b{LINE}\x0c",
]


@pytest.mark.parametrize("batches, broadcast_keys", [(1, 1 << 20), (4, 1 << 20), (7, 1 << 20), (4, 0)])
def test_line_dedup_equals_sql(spark, make_docs, batches, broadcast_keys):
    docs = make_docs(LINES, ids=[*range(10, 10 + len(LINES) - 1), None]).repartition(8)
    clashing = docs.withColumnRenamed("source", "n_lines").withColumnRenamed("lang", "doc")
    done = line_dedup.dedup_lines(clashing, batches=batches, broadcast_keys=broadcast_keys)
    assert done.columns == ["doc_id", "text", "doc", "n_chars", "n_lines", "n_dropped"]
    found = sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), r.n_dropped, r.n_lines) for r in done.collect()), key=repr)
    assert found == by_duckdb(spark, queries.OP10_SQL, documents=docs)


def test_line_runs_are_compacted_and_merged_where_they_lie(spark):
    runs = line_dedup.LineRuns(min_docs=3, buckets=3)
    for b in range(5):
        runs.add(spark.createDataFrame([(b, 100 + b, 0, 7, 7), (b, b, 0, b, 1)], "batch int, doc long, text_hash long, h1 long, h2 long"))
    assert [level is not None for level in runs.levels] == [True, False, True]
    found = runs.repeated()
    assert [tuple(r) for r in found.collect()] == [(7, 7, 104)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


@pytest.mark.parametrize("broadcast_keys", [1 << 20, 0])
def test_many_documents_without_an_id(spark, make_docs, broadcast_keys):
    # Texts without an id are told apart by their text; all are below the one that has an id.
    texts = [f"{LINE}\nown line of text number {i}\n{LINE} and {i // 3}" for i in range(300)] + [LINE]
    rows = line_dedup.dedup_lines(make_docs(texts, ids=[None] * 300 + [1]), broadcast_keys=broadcast_keys).collect()
    assert sorted(r.text for r in rows) == sorted([f"own line of text number {i}\n{LINE} and {i // 3}" for i in range(300)] + [LINE])


def test_line_dedup_of_an_empty_table(spark, make_docs):
    assert line_dedup.dedup_lines(make_docs([])).collect() == []


def test_repeated_benchmark_rows_are_collected_once(spark, make_docs, monkeypatch):
    from embprune.llm import decontaminate

    seen, search = [], decontaminate._search_block
    monkeypatch.setattr(decontaminate, "_search_block", lambda df, col, items, window: seen.append(items) or search(df, col, items, window))
    bench = spark.createDataFrame([("a", "one two three")] * 50 + [("b", "four five")], "item_id string, text string")
    rows = decontaminate.find_contamination(make_docs(["one two three", "six"]), bench).collect()
    assert sorted(i for block in seen for i in block) == [("a", "one two three"), ("b", "four five")]
    assert sorted((r.doc_id, r.n_hit, r.item_ids) for r in rows) == [(0, 3, ["a"]), (1, 0, [])]


def test_columns_of_internal_names_pass_the_filters(spark, make_docs):
    names = ["__block", "__url", "__by_rule", "__possible", "__listed", "__w0", "__w3", "__m0", "__m3", "__doc", "__gone", "__hash", "row", "page", "a.b"]
    more = [lit(f"own {n}").alias(n) for n in names]
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/y"), (3, None)], "page_id long, url string").select("*", *more)
    listed = spark.createDataFrame([("b.net/y",)], "canonical string")
    for blocks in (url_filter.MAX_BLOCKS, 1):
        found = url_filter.filter_urls(pages, listed, [Rule("allow", "org", "/")], max_blocks=blocks)
        assert found.columns == [*pages.columns, "host", "path", "rule", "verdict"]
        assert {r.page_id: r.verdict for r in found.collect()} == {1: "allow", 2: "block", 3: "allow"}
        assert all(r[n] == f"own {n}" for r in found.collect() for n in names)
    assert url_filter.filter_urls(pages.limit(0), listed, []).count() == 0
    docs = make_docs(["a line that is long enough\nrest", "a line that is long enough", "A line that is long enough ", None]).select("*", *more)
    for keys in (line_dedup.BROADCAST_KEYS, 0):
        found = line_dedup.dedup_lines(docs, broadcast_keys=keys)
        assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
        assert {r.doc_id: (r.text, r.n_dropped) for r in found.collect()} == {0: ("rest", 1), 1: ("", 1), 2: ("A line that is long enough ", 0), 3: ("", 0)}
        assert all(r[n] == f"own {n}" for r in found.collect() for n in names)


def test_a_full_block_of_the_benchmark_takes_bounded_memory():
    """The tables of BLOCK_BYTES of words without repeats, in a process of its own."""
    import subprocess
    import sys

    code = """
import random, resource
from embprune.llm import decontaminate as D
rng = random.Random(1)
texts, n = [], 0
while n < D.BLOCK_BYTES:
    texts.append(" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(300)))
    n += len(texts[-1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = D.searches(texts, D.WINDOW)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10, len(list(found[0].occurrences(texts[7].encode().split()))))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) < 400 and int(out[1]) == 288


def test_a_worker_builds_a_block_once():
    texts = [" ".join(WORDS[:20])]
    assert decontaminate.searches_of("one", texts, 13) is decontaminate.searches_of("one", texts, 13)
    decontaminate.searches_of("two", texts, 13)
    assert list(decontaminate._BUILT) == ["two"]

"""Every job against its SQL, on the small tables."""

import hashlib
import os
import re
import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from embprune.jobs import roles
from embprune.jobs.registry import jobs, sql

SF = "/root/testdata/sf0.001"
TABLES = "nation documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(sql()))
def test_job_equals_sql(spark, con, name):
    df = jobs()[name](spark, SF)
    names = sorted(df.columns)
    out = con.execute(sql()[name])
    found = [c[0] for c in out.description]
    assert sorted(found) == names
    want = sorted((tuple(plain(r[found.index(n)]) for n in names) for r in out.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == want


def test_words_of_documents_are_hashed_where_the_texts_lie(spark, tmp_path):
    texts = [(1, "A a\u212a b-B c1 \u00e9t\u00e9 0", "en"), (2, "", "en"), (3, None, "fr"), (4, "\u00e9 -- \n", "de"), (5, "x " * 9 + "y", None), (6, "one", "en"), (6, "two one", "en"), (6, "two", "fr")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    want: dict = {}
    for i, text, lang in texts:
        for w in re.findall("[a-z0-9]+", (text or "").lower()):
            want.setdefault((i, lang), np.zeros(256))[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 256] += 1
    df = roles.hashed_documents(spark, f"file://{tmp_path}")
    got = {(r.id, r.cluster): np.array(r.embedding) for r in df.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], v / np.sqrt((v * v).sum()), atol=1e-15) for k, v in want.items())
    # No row for each word is made.
    assert "Generate" not in df._jdf.queryExecution().toString()


def test_centres_are_apart(spark):
    found = jobs()["dedup_centers"](spark, SF).collect()
    assert sorted(r.cluster for r in found) == list(range(8)) and len({r.id for r in found}) == 8
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = np.stack([vectors[r.id] for r in found])
    assert (x @ x.T - 2 * np.eye(8)).max() <= 0.35


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "embprune.llm", "corpus_pipeline"])
def test_the_entry_works_without_what_the_text_operators_need(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ).stdout.split()
    assert int(out[0]) >= len(jobs()) and int(out[1]) >= len(sql()) and out[2] == "False"


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())

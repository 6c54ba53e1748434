import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts; ids from 0 unless given."""

    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        rows = [(i, t, lang, "src0", None if t is None else len(t)) for i, t, lang in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def texts(spark):
    """Texts of the small table."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    return [r.text for r in rows]

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fa long, taken long, stats string"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text, lang, source)``, with columns whose names clash with those operators use."""
    def make(rows):
        full = [(i, t, lang, s, len(t) if t is not None else None, 7, 8, "x") for i, t, lang, s in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def given(spark):
    """The smallest given tables."""
    import os

    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")

import pytest


@pytest.fixture(autouse=True)
def arrow(spark):
    """Tests work with the batch sizes of the queries."""
    from crownlake.llm.common import prepare

    prepare(spark)


@pytest.fixture
def docs(spark):
    """Rows that operators must bear: nulls, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en"), (2, None, None), (3, "", "en"), (None, "no id here", "en"), (4, long, "en")]
    rows += [(5, "repeated row", "en")] * 2 + [(6, " \t\n ", "de"), (7, "1234 ?!", "de"), (8, "Füße über Straßen é 😀", "de")]
    out = spark.createDataFrame([(i, t, lang, "x", 0.5, "s") for i, t, lang in rows], "doc_id long, text string, lang string, hits string, score double, kept_text string")
    return out


@pytest.fixture
def empty(docs):
    return docs.where("false")

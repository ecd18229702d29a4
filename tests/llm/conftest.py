import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns with names that operators use."""
    long = "word " * 3000 + "x" * 5000
    rows = [
        (1, "the same text of a few words and more words", "en", "a", 1), (2, "the same text of a few words and more words", "en", "a", 2), (2, "the same text of a few words and more words", "en", "a", 2),
        (3, None, None, None, None), (4, "", "en", "b", 0), (None, "no id here", "de", "b", 3), (None, None, None, None, None), (None, "no id here", "de", "b", 3), (5, long, "en", "c", 4), (6, long + " end", "fr", "c", 4), (7, "é" * 300 + " ß", "de", None, 5), (8, " \t\n ", "de", "a", 6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("fp", "did", "th", "key", "u", "before", "rank", "score", "size", "n", "words", "id", "part", "place", "bucket", "h1", "wanted", "root", "component_id", "toxic", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture
def given(monkeypatch):
    """Makes an operator's query read a frame instead of the table of that name."""

    def put(module, **tables):
        monkeypatch.setattr(module, "table", lambda spark, sf_dir, name: tables[name])

    return put

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts or (doc_id, text[, source]) tuples, with extra
    columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F

    def make(rows, clash=True):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            source = r[2] if len(r) > 2 else f"s{i % 3}"
            full.append((r[0], r[1], "en", source, len(r[1] or "")))
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for name in ("score", "doc", "size", "s", "node", "key", "_row", "words", "n_words", "length", "start", "id", "version"):
                df = df.withColumn(name, F.lit("clash"))
        return df
    return make


#: Nulls, blanks, ties, repeated rows and a very long text.
ODD = [(0, None), (1, ""), (2, " \t\n "), (3, "one two three"), (4, "one two three"), (None, "a b c d e f g"),
       (6, "x y z " * 30000), (7, "Ünï cödé  wörds"), (7, "Ünï cödé  wörds"), (8, "other text of the same id"), (8, "and this one")]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def empty(docs_of):
    return docs_of([]).limit(0)

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from texts or (text, source) pairs; ids count from 0."""

    def build(rows, schema=SCHEMA):
        full = []
        for i, r in enumerate(rows):
            t, s = r if isinstance(r, tuple) else (r, "h")
            full.append((i, t, "en", s, None if t is None else len(t)))
        return spark.createDataFrame(full, schema)

    return build


# clashing names of columns that the operators make themselves
CLASH = ("n_words", "spans", "sig", "hash", "id", "n", "kept", "text_", "_w", "ids", "terms", "sample")


@pytest.fixture
def clash():
    from pyspark.sql import functions as F

    return lambda d: d.withColumns({c: F.lit("x") for c in CLASH})


ODD = [None, "", " ", "a", "é 日本 🎉", "x" * 5000, "word " * 3000, "\x00\n\t"]


@pytest.fixture
def odd(make):
    return make(ODD)

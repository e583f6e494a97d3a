"""Fixtures of the training-data tests, imported by each module."""

import pytest

TABLES = SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet").cache()


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977} the of" for i in range(30_000))
    texts = [None, "", " ", "one", "a b c d e f g h", "a b c d e f g h", "A B c d e f g x", long,
             long + " end", "ﬁ Ａ́ 🙂 the\tof\nfoo", "x" * 5000, "漢字 " * 40]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "a b c d e f g h", None, None, None), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in
                           ("id", "_row", "_id", "key", "rep", "number", "_score", "part", "k")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

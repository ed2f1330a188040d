import pytest

LONG = "word " * 30_000
ODD = [
    (1, None, "en", "s"), (2, "", None, "s"), (3, "   \t\n", "en", None), (4, LONG, "en", "s"), (5, "A b\tc", "en", "s"), (6, "a B  c", "en", "s"), (7, "A b c", "de", "s"),
    (7, "A b c", "de", "s"), (None, "A b c", "de", "s"), (None, None, None, None), (8, "é 漢字 😀 <|endoftext|> </s> ▁x ", "fr", "s"), (9, "one two three four five six seven", "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns that carry the names of results."""
    names = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(ODD, names)
    return df.selectExpr("*", "'x' AS kept", "1 AS score", "'y' AS keep_id", "2 AS n_bytes", "'z' AS node", "0 AS predicted")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def sf1():
    return "/root/testdata/sf0.01"

import pytest

ROWS = [
    (1, "one two three", "en", "s"),
    (2, None, "en", "s"),
    (3, "", None, None),
    (4, "   \n\t ", "de", "s"),
    (None, "no id here", "en", "s"),
    (5, "same row", "en", "s"),
    (5, "same row", "en", "s"),
    (6, "x" * 60_000, "en", "s"),
    (7, "Ünï çödé — 日本語 😀 " * 200, "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeated rows, very long texts, and extra columns whose names operators use inside."""
    df = spark.createDataFrame([(*r, 0, "k", "n", "c") for r in ROWS], "doc_id long, text string, lang string, source string, n_words int, _d string, kept string, seed string")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def words():
    """A function that makes n invented words, the same for the same seed."""

    def make(n, seed):
        r = random.Random(seed)
        return ["".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(2, 9))) for _ in range(n)]

    return make


@pytest.fixture
def odd_rows(words):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "\n".join(" ".join(words(40, i)) for i in range(400))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", "a", 5), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3),
        (5, "x" * 5000, None, "b", 5000), (6, long, "en", None, len(long)), (6, long, "en", None, len(long)), (None, "no id here at all", "en", "a", 17),
        (7, "#*$ %&| <> a b \U0001F600 it's 12's", "en", "a", 9), (8, "!!!" * 2000, "en", "a", 6000),
    ]


@pytest.fixture
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

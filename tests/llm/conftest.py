import random

import pytest

ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n \r\n", None, "a", 5),
    (4, "One line only", "en", None, 13),
    (None, "No id here, but some words to look at", "en", "b", 37),
    (5, "word " * 30_000, "en", "b", 150_000),
    (6, "Twice the same row.\nAnd a second line.", "de", "b", 37),
    (6, "Twice the same row.\nAnd a second line.", "de", "b", 37),
    (7, "日本語 <|endoftext|> é \x85 ß\x00 😀 it's", "fr", "c", 20),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns of other names."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.selectExpr("*", "1 as n_words", "'x' as host", "true as kept", "0 as item_id",
                           "2 as score", "3 as row", "array(1) as cells", "'k' as drop")


@pytest.fixture
def none(odd):
    return odd.limit(0)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, 1 - i % 2) for i in range(200)] + [(None, 1, 0), (3, None, None)],
        "doc_id bigint, quality int, toxic int",
    )

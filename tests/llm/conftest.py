import pytest

SMALL = "/root/testdata/sf0.001"

#: Nulls, empty and very long texts, repeated rows, ties.
ODD = [
    (3, "A b c d e f", "s", "x"),
    (1, None, "s", None),
    (2, "", None, "x"),
    (2, "", None, "x"),
    (None, "a null id", "t", "x"),
    (7, "word " * 30_000, "t", "x"),
    (8, "a" * 60_000, "t", "x"),
    (9, "A b c d e f", "s", "x"),
    (5, "é中\U0001f600 don't  stop\n\n <|endoftext|> end", "u", "x"),
    (5, "same id, other text", "u", "x"),
    (11, "\t \n", "u", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns whose names clash with those of results."""
    rows = [(i, t, s, "zz", c, 1.5, "mine", 4) for i, t, s, c in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, fingerprint string, score double, n_tokens string, shard int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())

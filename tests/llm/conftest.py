from __future__ import annotations

import pytest

#: Every kind of awkward row: nulls in each column, empty, blank and long texts, ties, repeated rows; `rid` and `ord` clash with inner names.
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (0, "the quick brown fox jumps over the lazy dog and runs away. " * 12, "en", "a", 1, "x"),
    (1, "the quick brown fox jumps over the lazy dog and runs away. " * 12, "en", "a", 1, "x"),
    (1, "the quick brown fox jumps over the lazy dog and runs away. " * 12, "en", "a", 1, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, ""),
    (4, " \t\n\x0b ", "fr", None, 5, "y"),
    (5, LONG, "en", "b", len(LONG), "z"),
    (None, "a row without an id. It has words.", "de", "b", 3, "w"),
    (7, "é̂ 🎉 <|endoftext|> naïve  text\n\nwith   gaps", None, "b", 9, "v"),
    (8, "short", "en", "a", 5, "u"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

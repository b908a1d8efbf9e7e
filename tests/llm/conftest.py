"""Small documents with every odd case."""

import sys
from pathlib import Path


import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"



@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, odd characters, and extra columns with common names."""
    long = "lorem ipsum dolor sit amet " * 40_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (None, "a text without an id and some more words", None, "b", 1), (4, long, "en", None, len(long)),
        (5, "the same row twice " * 12, "en", "a", 1), (5, "the same row twice " * 12, "en", "a", 1), (6, "the same row twice " * 12, "fr", "a", 1), (7, "été   über ñandú \U0001f600 é \x1c x\x85y", "fr", "c", 9), (8, "12 34 ... !!", "de", "c", 9), (9, "A" * 5000, None, "c", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "doc_id as b", "text as task", "doc_id as root", "lang as kind", "n_chars as h", "source as piece", "doc_id as findings").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")

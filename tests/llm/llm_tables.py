"""Tables the tests of this folder share."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF001 = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Nulls, empty and blank texts, a long text, one without spaces, repeated rows, ties, odd characters.
LONG = " ".join(f"word{i % 977} and the number {i}" for i in range(6000))
ODD = [
    (1, "The cat sat on the mat. " * 3, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "   \n\t ", "en", "b"),
    (5, LONG, "en", "b"), (6, "x" * 3000, "de", "b"), (7, "日本語のテキスト😀 mixed text", None, "c"),
    (7, "日本語のテキスト😀 mixed text", None, "c"), (8, "The cat sat on the mat. " * 3, "en", "a"),
    (None, "a row without an id", "en", None), (9, "one", "fr", "d"), (10, "a  b   c \n \n d\t\te <|endoftext|> f", "fr", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every awkward kind, with extra columns whose names operators use themselves."""
    rows = [(i, t, la, s, None if t is None else len(t), "extra", 7) for i, t, la, s in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", id string, size int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, ties, repeated rows, case, marks, scripts, a very long text.
TEXTS = [
    None, "", " \t\n", "A", "a", "Ä b", "ä b", "one two", "One  two", "it's A.B's C!! d'x 12 ###",
    "İΣ é J̌  x <|endoftext|> \U0001f600", "word " * 30_000, "z" * 20_000,
]
DOCS = "doc_id bigint, text string, start int, ids string, kept string, id string, normal int"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with columns named like the operators' own; the last row repeats the one before."""
    rows = [(i, t, i, "x", "y", "z", 1) for i, t in enumerate(TEXTS)] + [(99, "A", 0, "", "", "", 1)] * 2
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")

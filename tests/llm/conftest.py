import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows that every operator on documents must take: nulls in all columns, empty and blank texts, a repeated row, ties, a very
#: long text, and a column named like a result.
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today", "en", "b", 5),
    (3, None, "en", "a", None), (4, "", None, "a", 0), (5, "  \t\n ", "en", None, 3), (6, "12345 !!", "de", "b", 1),
    (None, "no id here at all", "en", "a", 1), (7, None, None, None, None), (8, LONG, "en", "c", 1),
    (9, "short", "en", "c", 1), (10, "short", "en", "c", 1), (11, "Ünïcödé straße naïve 東京 🙂", "de", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, score long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

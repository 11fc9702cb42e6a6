"""Small frames with the awkward cases that every corpus operator must take."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null and empty texts, repeated rows, nulls in other columns, a very long text, odd characters, a clashing extra column."""
    rows = [
        (1, None, "en", "a", 0, "x"), (2, "", "en", None, 0, "x"), (3, "a b c d e f g", None, "a", 1, "x"), (3, "a b c d e f g", None, "a", 1, "x"),
        (4, "word " * 100_000, "fr", "b", 2, "x"), (None, "hello there you", "en", "a", 3, "x"), (5, "\u0000퟿ odd \U0001f600 <|endoftext|>", None, None, 3, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

from __future__ import annotations

import pytest

#: Null, empty, blank, one-word, tied, repeated and very long texts.
EDGES = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "word", "b"), (5, "One two three four five six seven", "b"), (6, "one TWO three four five six seven", "b"),
    (6, "one TWO three four five six seven", "b"), (None, "no id here at all my friend", "c"), (7, "x" * 50_000, "c"), (8, "the end of a long line " * 3000, "c"), (9, "ünï côdé \x00 \x1c odd   space", "c"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with the edge cases and columns whose names clash with those of the operators."""
    rows = [(i, t, "en", s, len(t or ""), 1, 2, "k", 0.5, True) for i, t, s in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, line int, `class` string, score double, kept boolean")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)

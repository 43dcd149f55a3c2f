from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with the given (doc_id, text) rows and columns whose names clash with those that operators make."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1.0, 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double, nth int, gone_id int")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four"), (4, "one two three four"), (5, "one two three four"), (None, "one two three four"), (6, "long words " * 60_000), (7, "ümlaut é́ İ$ <|endoftext|> ok"), (8, "x"), (9, "x y")]

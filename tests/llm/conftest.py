from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """``documents(rows, extra=...)``: a table of documents from (doc_id, text) or whole rows."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        whole = [(r + ("en", "s", len(r[1] or "")) if len(r) == 2 else r) for r in rows]
        return spark.createDataFrame(whole, schema)

    return make


#: Nulls, empty and blank texts, ties, repeated rows, one very long text.
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one two three four five"), (6, "one two three four five"), (7, "ü" * 70_000), (8, "word " * 30_000), (None, "one two three four five six"), (9, "!!! ### 12")]

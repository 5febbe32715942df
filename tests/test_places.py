"""Places of a text's words and what matches cover of them, against plain readings."""

from __future__ import annotations

import re
import time

from paperloom.operators import QUERIES
from paperloom.operators import spans as S

PLACED = [(1, "one te t"), (2, ""), (3, None), (4, " e té  t "), (5, "ä e t e tt\n𝄞e t"), (6, "e te te t"), (7, "x " * 3000 + "e t"), (8, "e "), (9, "t"), (None, "the t")]


def by_hand(literal):
    words, crossed = [], []
    for doc, text in PLACED:
        pieces, at = [], 0
        for k, w in enumerate([] if text is None else [*(w + " " for w in text.split(" ")[:-1]), text.split(" ")[-1]]):
            pieces.append((k, at, at + len(w)))
            at += len(w)
        words += [(doc, *p) for p in pieces]
        for nth, m in enumerate(re.finditer(re.escape(literal), text or ""), 1):
            crossed += [(doc, nth, k, max(a, m.start()) - a, min(b, m.end()) - a) for k, a, b in pieces if a < m.end() and m.start() < b]
    return words, crossed


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


def test_words_of_texts_are_placed_without_a_shuffle(spark):
    got = S.text_places(spark.createDataFrame(PLACED, "doc_id long, text string").repartition(2), "doc_id")
    assert ordered(got.collect()) == ordered(by_hand("e t")[0])
    plan = spark._jvm.PythonSQLUtils.explainString(S.text_places(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id")._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "Window" not in plan


def test_places_are_linear_in_a_text(spark):
    """A text of 400,000 words takes seconds: it is cut once, not once for each of its words."""
    text = "the tide " * 200_000
    began = time.monotonic()
    got = S.text_places(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").agg({"stop": "max", "k": "count"}).first()
    assert sorted(got) == [400_001, len(text)] and time.monotonic() - began < 30


def test_matches_are_cut_at_words_in_their_text(spark):
    table = spark.createDataFrame(PLACED, "doc_id long, text string").repartition(2)
    for literal in ("e t", "te t", "é  t", "e te", " "):
        assert ordered(S.text_places(table, "doc_id", literal=literal).collect()) == ordered(by_hand(literal)[1])


def test_crossings_of_a_long_text(spark, tmp_path):
    """A text of 400,000 words and 399,999 matches takes seconds, and a row without an id joins with nothing."""
    spark.createDataFrame([(1, "the tide " * 200_000), (None, "the tide")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.monotonic()
    got = QUERIES["match_crossings"](spark, str(tmp_path))
    assert got.count() == 2 * 399_999 and time.monotonic() - began < 30
    assert ordered(got.where("nth = 1").collect()) == [(1, 1, 0, 2, 4), (1, 1, 1, 0, 1)]

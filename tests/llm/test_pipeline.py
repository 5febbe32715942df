"""The pipeline's stages and the registry."""

from __future__ import annotations

import random

import corpus_pipeline
import __spark_entry__ as entry


def test_registry():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 11)}
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark, documents):
    random.seed(3)
    words = ["the", "and", "of", "to", "in", "cat", "house", "river", "stone", "garden", "window"]
    german = ["der", "und", "die", "von", "im", "katze", "haus", "fluss", "stein", "garten", "fenster"]
    make = lambda w, n: " ".join(random.choice(w) for _ in range(n))
    rows = [(i, make(german if i % 4 == 0 else words, 40 + i), "de" if i % 4 == 0 else "en", f"s{i % 3}", 0) for i in range(60)]
    passage = make(words, 60)
    twin = make(words, 200)
    rows += [(100, f"a first line\n{passage}", "en", "s0", 0), (101, f"another line\n{passage}", "en", "s0", 0), (102, twin, None, "s1", 0), (103, f"{twin} more", "en", "s1", 0), (104, None, "en", "s1", 0), (105, "12 !!", "en", "s1", 0), (106, passage, "en", None, 0)]
    docs = documents(rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert name == "sequences" or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs.toPandas()
    assert set(seen["language"]["doc_id"]) == {r[0] for r in rows} - {104, 105}
    lines = seen["lines"].set_index("doc_id")
    assert lines.loc[100, "text"] == rows[60][1] and lines.loc[101, "text"] == "another line" and 106 not in lines.index and lines.loc[101, "n_chars"] == 12
    assert 103 not in set(seen["near_duplicates"]["doc_id"]) and 102 in set(seen["near_duplicates"]["doc_id"])
    assert set(seen["mixture"]["doc_id"]) == set(seen["near_duplicates"]["doc_id"]) == set(seen["sequences"]["doc_id"])


def run_stages(spark, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "")
        assert name == "sequences" or got.columns == docs.columns
        docs = spark.createDataFrame(got.collect(), got.schema)
        out[name] = docs.toPandas()
    return out


def test_stages_of_an_empty_table_and_clashing_columns(spark, documents):
    clash = ["1 as n", "2 as score", "'x' as spans", "3 as piece", "4 as hits", "5 as cid", "6 as kept", "7 as entry", "8 as key", "9 as start"]
    assert all(len(d) == 0 for d in run_stages(spark, documents([]).selectExpr("*", *clash)).values())
    rows = [(i, f"the {w} and the {w} of house number {i} " * 3, "en", "s", 0) for i, w in enumerate(["cat", "dog", "river", "stone"] * 5)]
    seen = run_stages(spark, documents(rows).selectExpr("*", *clash))
    assert len(seen["language"]) == len(rows) and seen["mixture"]["n"].eq(1).all() and len(seen["sequences"]) > 0


def test_stages_of_repeated_rows_and_null_ids(spark, documents):
    text = "the cat and the dog of the house in the garden by the river and the stone"
    rows = [(5, text, "en", "s", 0)] * 4 + [(7, text, "en", "s", 0), (None, text, "en", None, 0), (None, text, "en", None, 0), (9, None, "en", "s", 0), (9, "", "en", "s", 0), (11, "w" * 60_000, "en", "t", 0)]
    seen = run_stages(spark, documents(rows))
    assert len(seen["language"]) == len(rows) - 2
    near = seen["near_duplicates"]
    assert (near["doc_id"] == 5).sum() == 1 and not (near["doc_id"] == 7).any() and near["doc_id"].isna().sum() == 2
    assert set(seen["mixture"]["doc_id"].dropna()) == {5, 11}


def test_a_corpus_without_labels_is_kept(spark, documents):
    rows = [(i, f"some text number {i} of the river", None, "s", 0) for i in range(20)] + [(30, "12 !!", None, "s", 0)]
    got = corpus_pipeline.STAGES[0][1](spark, documents(rows), "").toPandas()
    assert set(got["doc_id"]) == set(range(20)) and got["lang"].isna().all()


def test_mixture_takes_what_the_stream_of_places_takes(spark, documents):
    from paperloom.llm.mixing import mix, repeated_by_weight

    random.seed(5)
    rows = [(i, "w " * random.randint(0, 40), "en", random.choice(["a", "a", "a", "a", "a", "b", "c", None]), 0) for i in range(500)]
    docs = documents(rows)
    count = lambda d: sorted((r.doc_id, r["count"]) for r in d.groupBy("doc_id").count().collect())
    assert count(repeated_by_weight(docs)) == count(mix(docs)) and len(rows) < repeated_by_weight(docs).count()

"""Quality, language, personal data, line and n-gram operators against brute force."""

from __future__ import annotations

import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import langid, line_dedup, mixing, ngram_join, pii, quality
from tests.llm.conftest import AWKWARD

EXTRA = ["1 as n", "2 as score", "'x' as spans", "3 as lines", "4 as h", "5 as cid", "6 as kept"]


def same(spark_rows: pd.DataFrame, sql: str, docs: pd.DataFrame) -> None:
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.execute(sql).df()[list(spark_rows.columns)]
    key = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert key(spark_rows) == key(want)


def texts(seed: int, n: int) -> list[tuple[int, str | None]]:
    random.seed(seed)
    line = lambda: " ".join(random.choice(["a", "b", "the", "of", "##", "word", "x1"]) for _ in range(random.randint(0, 30)))
    pool = [line() for _ in range(25)]
    return [(i * 2, "\n".join(random.choice(pool) if random.random() < 0.6 else line() for _ in range(random.randint(1, 12)))) for i in range(n)]


def test_quality_equals_its_sql(documents):
    rows = [(d, t, random.choice(["en", "de", None]), random.choice(["a", "b", None]), 0) for d, t in texts(1, 260)] + [(d, t, None, None, 0) for d, t in AWKWARD]
    docs = documents(rows).selectExpr("*", *EXTRA)
    same(quality.quality_verdicts(docs).toPandas(), quality.OP4_SQL, docs.select("doc_id", "text", "lang", "source").toPandas())
    assert quality.quality_verdicts(documents([])).count() == 0


def test_lines_equal_their_sql(documents):
    rows = [*texts(2, 80), (1001, None), (1002, ""), (1003, " \n\t"), (1004, "w " * 60_000)]
    docs = documents(rows).selectExpr("*", *EXTRA)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "__lines", "__gone"]
    out = got.selectExpr("doc_id", "text", "cast(__lines as long) as n_lines", "cast(coalesce(size(__gone), 0) as long) as n_removed", "coalesce(array_join(transform(__gone, x -> cast(x as string)), ','), '') as removed")
    same(out.toPandas(), line_dedup.OP7_SQL, pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_filtering_by_quality_with_repeated_and_null_ids(documents):
    rows = [(i, t, "en", "a", 0) for i, t in texts(3, 150)] + [(0, None, "en", "a", 0), (None, texts(3, 150)[0][1], "en", "a", 0), (None, "short", "en", "a", 0)]
    docs = documents(rows).selectExpr("*", *EXTRA)
    kept = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
    got = quality.filter_quality(docs)
    assert got.columns == docs.columns and sorted(r.doc_id or -1 for r in got.collect()) == sorted(-1 if r[0] is None else r[0] or -1 for r in rows if r[0] in kept)
    assert quality.filter_quality(documents([])).count() == 0


def test_lines_are_not_deleted_on_clashing_hashes(documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "line_hash", lambda line: F.length(line).cast("long"))
    rows = [*texts(7, 40), *[(2000 + k, "\n".join(f"{'ab'[k % 2]}{w:03}" for w in range(60))) for k in range(4)]]
    got = line_dedup.dedup_lines(documents(rows))
    out = got.selectExpr("doc_id", "text", "cast(__lines as long) as n_lines", "cast(coalesce(size(__gone), 0) as long) as n_removed", "coalesce(array_join(transform(__gone, x -> cast(x as string)), ','), '') as removed")
    same(out.toPandas(), line_dedup.OP7_SQL, pd.DataFrame(rows, columns=["doc_id", "text"]))


def test_long_passage_goes_from_later_documents(documents):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(1, f"start\n{passage}\nend"), (2, f"other\n{passage}"), (3, passage), (3, passage), (None, passage), (4, "w0 w1")]
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert got == {(1, rows[0][1]), (2, "other"), (3, ""), (None, passage), (4, "w0 w1")}


def shingles(text: str | None) -> set:
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets, tree = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x: int) -> int:
        while tree[x] != x:
            x = tree[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                tree[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize(("block", "few"), [(4096, 8), (16, 1)])
def test_ngram_components(documents, block, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "TREE", 8)
    random.seed(block)
    base = [[random.choice("abcdefghij") + str(random.randint(0, 300)) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(160):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = f"X{random.randint(0, 99)}"
        rows.append((i * 3, " ".join(w[: random.randint(1, 60) if random.random() < 0.3 else 60])))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "One TWO"), (1004, "one two"), (1005, "ü" * 50_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(documents(rows).selectExpr("*", *EXTRA)).collect()}
    assert got == brute_components(rows)


def test_ngram_doubted_forest_is_done_again(documents, monkeypatch):
    """Where every candidate counts as sure, false ones must not join what does not link."""
    real = ngram_join._differ

    def eager(*args):
        differ, _ = real(*args)
        return differ, np.ones(len(differ), dtype=bool)

    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[i * 4 :] + [f"v{i}{k}" for k in range(i * 4)])) for i in range(8)]
    want = brute_components(rows)
    monkeypatch.setattr(ngram_join, "_differ", eager)
    monkeypatch.setattr(ngram_join, "FEW", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(documents(rows)).collect()}
    assert got == want


def test_ngram_shingles_are_hot_by_their_classes_whatever_the_mean(documents, monkeypatch):
    """Counters far above ``BLOCK`` on average: every shingle is dealt by classes, and the links are the same."""
    sketch = documents([(1, "x")]).sparkSession.createDataFrame([(k, 5000 + k) for k in range(16)] + [(16, 4096), (17, 3)], "at int, count long")
    assert ngram_join._levels(sketch, 18)[1].tolist() == [True] * 16 + [False, False]
    rows = [(i, " ".join(f"w{(i // 7) * 50 + k}" for k in range(40 - i % 7 % 4)) + " and so on for all") for i in range(60)]
    plain = sorted(map(tuple, ngram_join.similar_documents(documents(rows)).collect()))
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", (4, 4))
    assert sorted(map(tuple, ngram_join.similar_documents(documents(rows)).collect())) == plain and len({r[2] for r in plain}) < 60


def test_lines_with_clashing_columns(documents):
    """Columns of the names that the work uses pass through."""
    passage = "\n".join(f"line {k} of a passage with some words in it" for k in range(9))
    rows = documents([(1, passage), (2, f"own words\n{passage}\nmore"), (3, None), (4, "short")])
    names = ["__doc", "__key", "__id", "__hash", "__raw", "row", "gone", "raw", "h", "filter", "maybe", "id", "hash"]
    got = line_dedup.dedup_lines(rows.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)], F.lit("mine").alias("__gone")), deleted="cut")
    assert got.columns == [*rows.columns, *names, "__gone", "__lines", "cut"]
    found = {r.doc_id: (r.text, r["__lines"], r["cut"], r["__gone"], [r[n] for n in names]) for r in got.collect()}
    assert found[2][:4] == ("own words\nmore", 11, list(range(1, 10)), "mine") and found[1][:3] == (passage, 9, None) and found[3][:3] == (None, 0, None) and found[4][4] == list(range(13))


def test_ngram_repeated_and_null_ids(documents):
    same_ = "one two three four five six seven"
    rows = [(5, same_), (5, same_), (3, same_), (None, same_), (9, "else")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.similar_documents(documents(rows)).collect())
    assert got == [(0, 0), (3, 3), (5, 3), (5, 3), (9, 9)]
    assert sorted(r.doc_id or 0 for r in ngram_join.first_of_each(documents(rows)).collect()) == [0, 3, 9]
    assert ngram_join.similar_documents(documents([])).count() == 0


def test_ngram_names_of_classes_that_clash_are_given_anew(documents, monkeypatch):
    real = ngram_join.class_of
    monkeypatch.setattr(ngram_join, "class_of", lambda grams, seed=0: real(grams, seed) if seed else len(grams))
    rows = [(i, f"w{i} " + " ".join(f"x{i % 3}{k}" for k in range(30))) for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(documents(rows)).collect()}
    assert got == brute_components(rows)


def test_ngram_one_row_of_each(documents):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve one two"
    rows = [(3, a)] * 3 + [(5, a)] + [(3, b), (None, a), (None, a), (8, None), (8, None), (9, "")]
    got = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.first_of_each(documents(rows)).collect())
    assert got == sorted([(3, a), (3, b), (0, a), (0, a), (8, ""), (9, "")])


def short_copies(n: int) -> list[str]:
    words = [f"w{k}" for k in range(54)]
    return [" ".join(words[:30] + [f"changed{i}"] + words[31:]) for i in range(n)]


def group_of(rows: list[str]) -> pa.RecordBatch:
    sets = sorted(ngram_join.shingle_sets(pa.array(rows)), key=ngram_join.class_of)
    marks = [getattr(ngram_join, "mark", ngram_join.bitmap)(s) for s in sets]
    columns = [pa.array([7] * len(sets), pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([ngram_join.class_of(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([[7]] * len(sets), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["grp", "n", "cid", "bitmap", "firsts"])


def test_ngram_group_of_short_copies_gives_a_forest():
    one = group_of(short_copies(500))
    assert sum(b.num_rows for b in ngram_join._similar(False)(iter([one]))) == 499
    batches = [b.num_rows for b in ngram_join._similar(True)(iter([one]))]
    assert sum(batches) == 500 * 499 // 2 and max(batches) <= 100_000


def test_ngram_short_copies_are_one_component(documents):
    rows = list(enumerate(short_copies(60))) + [(100 + i, " ".join(t.split()[i % 9 :])) for i, t in enumerate(short_copies(40))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(documents(rows)).collect()}
    assert got == brute_components(rows)


def test_tree_walk_equals_sets():
    rng = np.random.default_rng(2)
    one = np.unique(rng.integers(0, 80, 50)).astype(np.uint64)
    others = [np.unique(np.concatenate([one[rng.random(len(one)) < rng.uniform(0.6, 1)], rng.integers(0, 80, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(300)]
    want = [100 * len(np.intersect1d(one, o)) >= 80 * len(np.union1d(one, o)) for o in others]
    assert ngram_join.tree_links(one, others) == want and any(want) and not all(want)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = langid.identify(docs, langid.fit_on_documents(docs)).where(langid.held_out()).toPandas()
    assert (told["lang"] == told["lang_pred"]).mean() > 0.97 and told["score"].between(0, 1).all()


def test_language_of_awkward_rows(documents):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("the end of it", "en")] * 8)]
    model = langid.fit(documents(rows).selectExpr("text", "lang", "doc_id as key"))
    got = langid.identify(documents(AWKWARD).selectExpr("*", "'q' as SCORE"), model).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    empty = langid.fit(documents([]).selectExpr("text", "lang", "doc_id as key"))
    assert {r.lang_pred for r in langid.identify(documents(AWKWARD), empty).collect()} == {"und"}


def test_no_language_is_left_out(documents, monkeypatch):
    """More languages than the whole sample has room for at full size."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 700)
    random.seed(9)
    words = {f"l{k}": ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for k in range(70)}
    rows = [(i, " ".join(random.choices(words[lang], k=20)), lang, "s", 0) for i, lang in enumerate(list(words) * 12)]
    docs = documents(rows)
    told = langid.identify(docs, langid.fit(docs.selectExpr("text", "lang", "doc_id as key"), 600)).toPandas()
    assert set(told["lang_pred"]) == set(words) and (told["lang"] == told["lang_pred"]).mean() > 0.9


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    find = lambda p: re.finditer(p, text)
    out = [("email", m.start(), m.end()) for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [("ip", m.start(), m.end()) for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m.start(), m.end()) for m in find(r"[0-9]([\x20-]?[0-9])+") if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_equal_the_patterns():
    random.seed(4)
    long_ = "0" * 5000
    for text in (f"{long_}1.1.1.1", f"1.{long_}.2.{long_}9", f"{long_}300.1.1.1 {'9' * 6000}", f"+{long_}", f"{'1.' * 4000}", f"a@{'b.' * 4000}c"):
        assert [s[1:] for s in pii.base_spans(text) if s[0] == "ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        assert all(pii.describe(text, s) for s in pii.candidates(text))
    for alphabet in ("a1@.%-+ 2(9", "0123456789 -.+", "a@.b1"):
        for _ in range(4000):
            text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 45)))
            assert pii.base_spans(text) == brute_spans(text), text


def test_personal_data(documents):
    rows = [*AWKWARD, (30, "mail a.b@c.example.com or +1 (376) 555-9077, card 4111 1111 1111 1111, at 10.0.0.255 ü")]
    docs = documents(rows).selectExpr("*", *EXTRA)
    got = {r.doc_id: r for r in pii.spans(docs, pii.fit(docs)).collect()}
    r = got[30]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert pii.redacted(rows[-1][1], r.spans) == "mail [EMAIL] or [PHONE], card [CARD], at [IP] ü"
    assert got[1].spans == got[2].spans == "" and pii.spans(docs, pii.fit(docs)).count() == len(rows)
    assert pii.spans(documents([]), pii.fit(documents([]))).count() == 0


def test_rewritten_spans_are_accepted(documents):
    random.seed(8)
    words = ["river", "stone", "garden", "window", "house", "market", "letter"]
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    real = ["ann.lee@mail.example.com", "+44 20 7946 0018", "4111 1111 1111 1111", "10.0.0.255"]
    docs = documents([(i, f"{prose(20)} {random.choice(real)} {prose(20)}") for i in range(4000)])
    model = pii.fit(docs)
    for kind, span in [("email", "jane (at) example (dot) com"), ("phone", "00 44 20 7946 0018"), ("ip", "10 . 0 . 0 . 7"), ("card", "4111 1111 1111 1111")]:
        text = f"{prose(5)} {'7 ' if kind == 'card' else ''}{span} {prose(5)}"
        assert pii.base_spans(text) == [] and [(k, text[a:b]) for k, a, b in model.added(text, [])] == [(kind, span)]
    for text in ["meet @ noon. Then go", "at 10 . 0 . 300 . 7 too", "see 1. 2. 3. 4 there", "on 2024-05-17 10 he", "pay 7 4111 1111 1111 1112 now"]:
        assert model.added(text, []) == []


class AcceptsAll:
    def score(self, x):
        return 0.9 + 0.05 * (x[:, 1] % 2)


def test_added_spans_equal_a_plain_search():
    """Overlaps are looked up in marks; the plain search compares each candidate with each span."""
    rng, model = random.Random(4), pii.PiiModel(AcceptsAll(), dict.fromkeys(pii.KINDS, 0.91))
    pieces = ["10.1.2.3", " 10 . 1 . 2. 9", "a (at) b (dot) c", "x@y.de", "00 44 20 7946 0018", "4111 1111 1111 1111", "+1 (555) 123-4567", " ", ", ", "12 ", "3.4. "]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        base = pii.base_spans(text)
        new = [s for s in pii.candidates(text) if not any(s[1] < b and a < s[2] for _, a, b in base)]
        taken = []
        for s in sorted(new, key=lambda s: (-(0.9 + 0.05 * ((s[2] - s[1]) % 2)), s[1], pii.KINDS.index(s[0]), s[2])):
            if (s[2] - s[1]) % 2 and pii.describe(text, s)[pii.FEATURES.index("check")] and not any(s[1] < b and a < s[2] for _, a, b in taken):
                taken.append(s)
        assert model.added(text, base) == taken, text


def test_a_long_text_of_very_many_spans(documents):
    """Five megabytes with some 300,000 spans take seconds, in the search and in the fit."""
    line = "10.0.{a}.{b} GET /x{a} a{a}@host{b}.org 10 . 0 . {b} . 7 -> +49 30 12{a:04}{b:03}\n"
    text = "".join(line.format(a=k % 256, b=k % 199) for k in range(75_000))
    model, began = pii.PiiModel(AcceptsAll(), dict.fromkeys(pii.KINDS, 0.5)), time.time()
    base = pii.base_spans(text)
    found = model.added(text, base)
    assert len(text) > 5e6 and len(base) >= 225_000 and len(found) >= 75_000 and time.time() - began < 60
    began = time.time()
    pii.fit(documents([(k, f"write to a{k}@b.org or 10.0.0.{k}") for k in range(60)] + [(99, text)]))
    assert time.time() - began < 60


def test_trees_learn_what_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, len(pii.FEATURES)))
    y = ((x[:, 3] > 0.2) & (x[:, 5] < 0.5)).astype(float)
    assert (((pii.boost(x, y).score(x) > 0.5) == y).mean()) > 0.97


def test_mixing_equals_its_sql(documents):
    random.seed(6)
    rows = [(i, "w " * random.randint(0, 50), "en", random.choice(["a", "a", "a", "a", "b", "c", None]), 0) for i in range(400)]
    docs = documents(rows).selectExpr("*", "1 as __x", "2 as tokens", "3 as quota")
    out = mixing.mix(docs)
    got = out.selectExpr("doc_id", "source", "cast(__epoch as int) as epoch", "__tokens as n_tokens", "__start as start", "__block as block").toPandas()
    same(got, mixing.OP8_SQL, pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    assert got["doc_id"].nunique() == 400 and out.columns[: len(docs.columns)] == docs.columns


def test_mixing_meets_limits(documents):
    rows = [(i, "w " * 10, "en", "big" if i < 900 else f"s{i % 4}", 0) for i in range(1000)]
    got = mixing.mix(documents(rows), repetitions=3.0).toPandas()
    tokens = got.groupby("source")["__tokens"].sum()
    assert tokens["big"] == 9000 and tokens.drop("big").max() <= 3 * 250
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents([(1, None), (2, "")])).count() == 2


def test_trees_are_learned_from_all_documents(documents, spark):
    """All that there is to learn is in documents whose hashes are high, where a sample of 8,000 by hash has none."""
    random.seed(9)
    docs = spark.range(14_000).selectExpr("id as doc_id", "if(pmod(xxhash64(id), 1L << 30) > 0.7 * (1L << 30), concat('river stone write to ann', id, '@mail', id % 7, '.example.com or 10.0.', id % 256, '.7 garden window'), null) as text")
    model = pii.fit(docs)
    text = "stone garden jane (at) example (dot) com window"
    assert [(k, text[a:b]) for k, a, b in model.added(text, [])] == [("email", "jane (at) example (dot) com")]


def test_the_fit_equals_one_in_memory(documents, monkeypatch):
    """Every candidate of every document counts, also of one with very many; sums by Spark and by the driver are the same."""
    docs = documents([(i, f"call +44 20 7946 {i:04} or mail a{i}@b{i % 9}.org, host 10.0.{i % 256}.255, see {i}. {i + 1}. 3. 4 and 1234 5678 {i:04} 1111") for i in range(300)] + [(999, "".join(f"at 10.0.0.{i % 256} ip 10 . 0 . 300 . {i} or 00 44 20 7946 {i:04}\n" for i in range(400))), (1000, None), (None, "x@y.de")])
    rows = []
    for r in docs.select(F.xxhash64("doc_id").alias("draw"), "text").collect():
        for place in pii._places(r["text"] or "", r["draw"]) if r["text"] else ():
            rows += [(r["draw"] % 4 == 0, *row) for row in pii._learned(*place)]
    held, good, free = (np.array([r[k] for r in rows]) for k in range(3))
    x = np.array([r[3] for r in rows], dtype=float)
    assert sum(r["n"] for r in pii.learned(docs).collect()) == len(rows)
    veiled = x[~held].copy()
    veiled[:, pii.HIDDEN] = -1
    trees = pii.boost(np.concatenate([x[~held], veiled]), np.tile(good[~held].astype(float), 2))
    model = pii.fit(docs)
    assert np.allclose(model.trees.score(x), trees.score(x), rtol=0, atol=1e-9)
    p = np.where(x[:, pii.FEATURES.index("check")] == 1, model.trees.score(x), 0.0)
    for k, kind in enumerate(pii.KINDS):
        some = held & free & (x[:, 0] == k)
        passing = [q for q in set(p[some]) if good[some & (p >= q)].mean() >= pii.PRECISION]
        assert model.threshold[kind] == pytest.approx(max(0.5, min(passing)) if passing else 2.0)
    monkeypatch.setattr(pii, "HERE", 0)
    again = pii.fit(docs)
    assert again.threshold == model.threshold and (again.trees.score(x) == model.trees.score(x)).all()

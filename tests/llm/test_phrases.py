"""Phrase collocations against a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from paperloom.llm.phrases import OP11_SQL, collocations, op11_phrase_mining, ranked
from tests.llm.conftest import AWKWARD
from tests.test_queries import SF, duck, same  # noqa: F401


def plain(rows, least, top, size=4):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, *w[i : i + m]) for m in range(1, size + 1) for i in range(len(w) - m + 1))
    out = []
    for lang in total:
        found = []
        for (la, *p), a in counts.items():
            if la != lang or len(p) < 2 or a < least:
                continue
            inside = any(lo[0] == lang and len(lo) - 1 > len(p) and 100 * f >= 80 * a and any(list(lo[1 + i : 1 + i + len(p)]) == p for i in range(len(lo) - len(p))) for lo, f in counts.items())
            if not inside:
                score, _, l, r = min((2_000_000 * a // (counts[la, *p[:k]] + counts[la, *p[k:]]), k, counts[la, *p[:k]], counts[la, *p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Ä", "ä", "d e", " x", "aa", "Z"]
    blanks = [" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n", "; "]
    return [("".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 1 << 10])
def test_equals_a_plain_count(spark, most):
    rows = texts(7, 80)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations(docs, least=5, top=40, most=most).collect())) == plain(rows, 5, 40)


def test_ties_repeats_and_top_in_parts(spark):
    rows = [("x y. p q. m n", "en")] * 40 + [("x y z", "en")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(map(tuple, collocations(docs, least=30, top=2).collect()))
    assert got == plain(rows, 30, 2) and [r[2] for r in got] == ["x y", "m n"]
    many = spark.range(500).selectExpr("'en' lang", "concat('w', id) phrase", "id % 7 score", "id % 3 a")
    best = ranked(many, 20).orderBy("rank").collect()
    whole = sorted(many.collect(), key=lambda r: (-r["score"], -r["a"], r["phrase"]))[:20]
    assert [r["phrase"] for r in best] == [r["phrase"] for r in whole] and [r["rank"] for r in best] == list(range(1, 21))


def test_awkward_rows(spark, documents):
    docs = documents(AWKWARD).selectExpr("*", "1 as w1", "'x' as h_w2", "2 as phrase", "3 as filter", "4 as words", "5 as lang_1")
    got = sorted(map(tuple, collocations(docs).collect()))
    assert got == plain([(r["text"], r["lang"]) for r in docs.collect()], 30, 2000) and got[0][2] == "word word word word"
    assert collocations(docs.limit(0)).collect() == []
    assert collocations(documents([(1, None), (2, "")])).collect() == []


def test_large_counts_are_exact(spark):
    from paperloom.llm.phrases import scored

    n = 9 * 10**12 + 1
    rows = [("en", "a", 1, n + 2), ("en", "b", 1, n + 5), ("en", "a b", 2, n)]
    got = scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).first()
    assert got["score"] == 2_000_000 * n // (2 * n + 7) and (got["l"], got["r"]) == (n + 2, n + 5)


def test_sql(spark, duck):  # noqa: F811
    same(op11_phrase_mining(spark, SF.replace("sf0.001", "sf0.01")).toPandas(), duck.execute(OP11_SQL.replace("FROM documents", f"FROM '{SF.replace('sf0.001', 'sf0.01')}/documents.parquet'")).df())

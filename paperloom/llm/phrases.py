"""Phrase collocations: runs of words that stand together far more often than their parts would.

All runs of one to ``MAX_WORDS`` words are exploded into rows and hash-aggregated per language;
a phrase's parts are looked up in the same counts by a join for each side of a cut, the score is
a whole number made in Decimal, phrases that mostly occur inside a longer one go by an anti-join
with the extensions by one word, and what is left is ranked in windows.

Most runs are rare, and shuffling them all as text would be ten times the corpus.  A run occurs no
more often than any word and any two neighbouring words in it, so words and pairs are counted
first by 64-bit hashes.  Those that reach the least count set bits in a filter of bounded size
(``FILTER_WORDS``), and exploded rows with a word or pair that is not in it are dropped before the
aggregation.  Hashes that clash and a full filter only let rows pass that the exact counts
decide, so no result depends on either.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import FILTER_WORDS, hash_filter, in_filter, table, written

MAX_WORDS = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
#: A phrase goes where a longer one around it has this percentage of its count.
INSIDE = 80
#: Without a language.
NONE = "und"

#: What ends a piece, and what parts words in it.
ENDS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"


def pieces(docs: DataFrame) -> DataFrame:
    """``lang, words``: the words of each piece of each text, in order; pieces without words are left out.

    One pass over the characters lowers letters and makes all ends line feeds and all blanks
    spaces, so that both splits are by a single character.
    """
    plain = F.translate(F.col("text").cast("string"), string.ascii_uppercase + ENDS + BLANKS, string.ascii_lowercase + "\n" * len(ENDS) + " " * len(BLANKS))
    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), F.explode(F.split(plain, "\n")).alias("piece"))
    return each.select("lang", F.array_remove(F.split("piece", " "), "").alias("words")).where(F.size("words") > 0)


def runs(docs: DataFrame, size: int = MAX_WORDS) -> DataFrame:
    """``lang, w1 ... w<size>``: a row for each word of each piece with those that follow it there."""
    ahead = [F.slice("words", k, F.size("words")).alias(f"w{k}") for k in range(1, size + 1)]
    return pieces(docs).select("lang", F.inline(F.arrays_zip(*ahead)))


def _hash(*words: str) -> Column:
    return F.xxhash64("lang", *words)


def frequent_filter(docs: DataFrame, least: int = LEAST, most: int = FILTER_WORDS[1]) -> DataFrame:
    """``words``: one row, the filter of the words and pairs that occur ``least`` times or more in their language (clashing hashes count together)."""
    first = runs(docs, 2).select(_hash("w1").alias("one"), F.when(F.col("w2").isNotNull(), _hash("w1", "w2")).alias("two"))
    hashes = first.select(F.explode(F.array("one", "two")).alias("h")).where("h is not null")
    often = written(hashes.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h"), "frequent")
    return hash_filter(often, most)


def phrase_counts(docs: DataFrame, size: int = MAX_WORDS, least: int = LEAST, most: int = FILTER_WORDS[1]) -> DataFrame:
    """``lang, phrase, words, f``: the exact counts of all runs of ``size`` words at most that occur ``least`` times or more.

    The row of no words (``phrase`` empty, ``words`` 0) has the number of all words of a language.
    """
    bits = frequent_filter(docs, least, most)
    passed, rows = bits.select("words").scalar(), runs(docs, size)
    names = [f"w{k}" for k in range(1, size + 1)]
    hashes = {**{f"h_{n}": F.when(F.col(n).isNotNull(), _hash(n)) for n in names[:1]}, **{f"h_{b}": F.when(F.col(b).isNotNull(), _hash(a, b)) for a, b in zip(names, names[1:], strict=False)}}
    rows = rows.withColumns(hashes)
    rows = rows.withColumn("filter", passed)
    rows = rows.select("lang", *names, *[in_filter("filter", h).alias(h) for h in hashes])
    each, ok = [F.lit("")], F.lit(True)
    for k in range(1, size + 1):
        ok = F.col(f"h_w{k}") if k < 3 else ok & F.col(f"h_w{k}")
        each.append(F.when(ok, F.concat_ws(" ", *names[:k])))
    grams = rows.select("lang", F.explode(F.array(*each)).alias("phrase")).where("phrase is not null")
    counted = grams.groupBy("lang", "phrase").agg(F.count("*").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return counted.select("lang", "phrase", words.cast("int").alias("words"), "f")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of every phrase of two words or more: the cut of the lowest score, the earliest of equal ones."""
    phrases = counts.where("words >= 2")
    parts = F.split("phrase", " ")
    join = lambda a, n: F.array_join(F.slice(F.col("parts"), a, n), " ")
    cuts = phrases.select("lang", "phrase", "words", F.col("f").alias("a"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda side, f: counts.where("words >= 1").select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr(f"cast(a as decimal(20,0)) * cast({SCALE} as decimal(10,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def outermost(phrases: DataFrame) -> DataFrame:
    """``phrases`` (``lang, phrase, words, a``) without those that mostly stand inside a longer one.

    Whatever longer phrase has the needed share of a count, the one a single word longer between
    the two has it too, so extensions by one word decide.
    """
    parts = F.split("phrase", " ")
    cut = lambda a: F.array_join(F.slice(parts, a, F.col("words") - 1), " ")
    inner = phrases.where("words >= 3").select("lang", F.col("a").alias("longer"), F.explode(F.array(cut(1), cut(2))).alias("phrase"))
    covers = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    hit = covers.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), "longer")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    return phrases.join(hit, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase")) & (100 * whole("longer") >= INSIDE * whole("a")), "left_anti")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their ``rank``: by score and count, the highest first, then by the phrase's bytes.

    Ranks are first given in parts of a language, and only the first ``top`` of a part go on, so
    no task meets all phrases of a language.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    n = phrases.count()
    split = max(1, math.ceil(math.sqrt(n / top)))
    part = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(split)))
    part = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return part.drop("part", "place").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, size: int = MAX_WORDS, least: int = LEAST, top: int = TOP, most: int = FILTER_WORDS[1]) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases of each language of ``docs`` (``text, lang``).

    ``a`` is the phrase's count, ``l`` and ``r`` those of the parts of its weakest cut, ``n`` the
    words of its language.  A null language is ``und``, and one with the documents that say so; a
    null or empty text, and one of punctuation, has no words.  Repeated rows count as often as they
    come, ties are broken by the phrase, other columns are ignored, and an empty table or one
    without a phrase of ``least`` occurrences gives no row.
    """
    counts = written(phrase_counts(docs.select("text", "lang"), size, least, most), "counts")
    kept = written(outermost(scored(counts)), "phrases")
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked(kept, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first 2,000 phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM words, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
parts AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m >= 2),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM parts, (VALUES (1), (2), (3)) AS spot(k) WHERE k < m),
scores AS (SELECT c.lang, c.m, c.phrase, a, k, p.f AS l, s.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (p.f + s.f) AS BIGINT) AS score FROM cuts c JOIN counts p ON p.lang = c.lang AND p.phrase = x JOIN counts s ON s.lang = c.lang AND s.phrase = y),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM counts o WHERE o.lang = b.lang AND o.m > b.m AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.f >= 80 * b.a)),
places AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM places JOIN total USING (lang) WHERE rank <= 2000"""

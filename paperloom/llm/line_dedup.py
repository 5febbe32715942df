"""Removal of repeated runs of lines by winnowing, in DataFrame functions only.

A document's lines with a word are a sequence of hashes; lines without a word take no part and
stay.  A run counts when its lines have ``MIN_WORDS`` words or more.  Windows are the shortest
such runs: one forward from each line, one backward to each line; a run of lines with that many
words is the union of the windows in it.

* Winnowing: of each window only the line of least hash is kept, as a fingerprint with its
  position.  Equal windows keep the same line, so a repeated run always has a fingerprint in
  common; fingerprints that stand at one position of the corpus go.
* Joined positions: a position of a repeated fingerprint is joined with the first position that
  kept it in the same window, in order of ``doc_id`` and line.  That is one partner for each
  window and not a pair for each two positions, so that a frequent line costs what it occurs.
* Extension: each joined pair grows line by line both ways, as far as the lines are the same by a
  digest of their texts (``DIGEST`` hexadecimal digits of SHA-256); hashes only propose.
* Runs that have ``MIN_WORDS`` words then are deleted at the later place; the first stays.

All tables that are joined grow with the corpus, so joins are merges of sorted rows at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import hash_filter, in_filter, table, written

MIN_WORDS = 50
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Hexadecimal digits of a line's SHA-256 that tell whether lines are the same.
DIGEST = 32
#: Lines whose windows are looked for in one row; the lines around them that a window can need come along.
STRETCH = 64
#: Lines that are looked at first for a window; where they have too few words, ``MIN_WORDS`` lines are.
NEAR = 8
#: Lines on both sides of joined windows that an extension looks at; what lies beyond has windows of its own.
REACH = 16


def line_hash(line: Column) -> Column:
    """What proposes matches; equal for different lines at no harm but work."""
    return F.xxhash64(line)


def _windows() -> Column:
    """First line ``i`` and number of lines ``n`` of the window from, and of that to, each line of a stretch.

    Works on the column ``w`` (words of each line, ``MIN_WORDS`` at most), of which ``STRETCH``
    lines from ``begin`` are asked.  A line has a word at least, so a window has no more than
    ``MIN_WORDS`` lines.  The search keeps words and lines in one integer.
    """
    enough = MIN_WORDS * 64

    def search(backward: bool) -> Column:
        def grown(i: Column, lines: int) -> Column:
            first = F.greatest(i - (lines - 1), F.lit(0))
            reach = F.reverse(F.slice("w", first + 1, i - first + 1)) if backward else F.slice("w", i + 1, F.lit(lines))
            return F.aggregate(reach, F.lit(0), lambda a, x: F.when(a >= enough, a).otherwise(a + x * 64 + 1))

        def found(x: Column, i: Column) -> Column:
            longer = F.get(F.transform(F.array(grown(i, NEAR)), lambda v: F.when(v >= enough, v).otherwise(grown(i, MIN_WORDS))), 0)
            mine = (i >= F.col("begin")) & (i < F.col("begin") + STRETCH)
            return F.when(mine, F.when(x >= MIN_WORDS, F.lit(enough + 1)).otherwise(longer))

        def placed(v: Column, i: Column) -> Column:
            n = v % 64
            return F.when((v >= enough) & (n > 1) if backward else v >= enough, F.struct((i - n + 1 if backward else i).alias("i"), n.alias("n")))

        return F.filter(F.transform(F.transform("w", found), placed), lambda v: v.isNotNull())

    return F.concat(search(False), search(True))


def _kept(windows: Column) -> Column:
    """The fingerprint ``m`` of each of ``windows``, its position ``at`` in the document, and the window."""
    sliced = F.transform(windows, lambda v: F.struct(v["i"].alias("i"), v["n"].alias("n"), F.slice("hs", v["i"] + 1, v["n"]).alias("hs")))
    return F.transform(sliced, lambda x: F.struct(F.array_min(x["hs"]).alias("m"), (F.col("base") + x["i"] + F.array_position(x["hs"], F.array_min(x["hs"])).cast("int") - 1).alias("at"), x["i"].alias("i"), x["n"].alias("n"), x["hs"].alias("hs")))


def _lines(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and, of each line with a word, the number in ``ks``, the hash in ``hs``, the digest in ``ds`` and the words in ``w``."""
    split = docs.select(*columns, F.split("text", "\n").alias("raw"))
    full = F.filter(F.transform("raw", lambda x, k: F.struct(F.btrim(x, F.lit(SPACE)).alias("t"), x.alias("x"), k.alias("k"))), lambda x: x["t"] != "")
    words = F.transform("full", lambda x: F.least(F.size(F.split(x["t"], SPACE_CLASS)), F.lit(MIN_WORDS)))
    digests = F.transform("full", lambda x: F.unhex(F.substring(F.sha2(x["x"], 256), 1, DIGEST)))
    return split.withColumn("full", full).withColumns({"w": words, "hs": F.transform("full", lambda x: line_hash(x["x"])), "ds": digests, "ks": F.col("full.k")}).drop("raw", "full")


def _stretches(lined: DataFrame, *arrays: str) -> DataFrame:
    """The lines of a document as short overlapping ``arrays``: a slice costs as much as its array is long."""
    start = F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(STRETCH)))).alias("start")
    base = F.greatest(F.col("start") - (MIN_WORDS - 1), F.lit(0))
    near = lined.select("*", start).withColumns({"base": base, "begin": F.col("start") - base})
    return near.select("doc", "key", "base", "begin", *[c for c in ("hits",) if c in lined.columns], *[F.slice(c, F.col("base") + 1, F.lit(STRETCH + 2 * MIN_WORDS)).alias(c) for c in arrays])


def _joined(lined: DataFrame) -> DataFrame:
    """``doc, key, doc0, key0, lag, low, high``: where lines from ``low`` to ``high`` have windows that stand ``lag`` lines before, in an earlier document or place."""
    marks = _stretches(lined, "w", "hs").select("doc", "key", F.explode(F.array_distinct(F.transform(_kept(_windows()), lambda x: F.struct(x["m"].alias("m"), x["at"].alias("at"))))).alias("v"))
    prints = written(marks.select("doc", "key", "v.*"), "prints")
    place = F.xxhash64("doc", "key", "at")
    repeated = prints.groupBy("m").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("m")
    hits = prints.join(written(repeated, "repeated").hint("merge"), "m").groupBy("doc", "key").agg(F.collect_set("at").alias("hits"))
    there = _stretches(lined.join(written(hits, "hits").hint("merge"), ["doc", "key"]), "w", "hs", "ds")
    mine = F.filter("hits", lambda x: (x >= F.col("base")) & (x < F.col("base") + F.size("w")))
    there = there.withColumn("hits", mine).where(F.size("hits") > 0)
    live = F.filter(_kept(_windows()), lambda x: F.array_contains("hits", x["at"]))
    named = F.transform(live, lambda x: F.struct(F.xxhash64(x["hs"]).alias("h"), F.xxhash64(F.slice("ds", x["i"] + 1, x["n"])).alias("g"), (F.col("base") + x["i"]).alias("i"), x["n"].alias("n")))
    windows = written(there.select("doc", "key", F.explode(named).alias("v")).select("doc", "key", "v.*"), "windows")
    at = F.struct("doc", "key", "i")
    first = windows.groupBy("h", "g").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low < high").select("h", "g", "low")
    later = windows.join(written(first, "first").hint("merge"), ["h", "g"]).where(at > F.col("low"))
    lag = (F.col("i") - F.col("low.i")).alias("lag")
    return later.groupBy("doc", "key", F.col("low.doc").alias("doc0"), F.col("low.key").alias("key0"), lag).agg(F.min("i").alias("low"), F.max(F.col("i") + F.col("n") - 1).alias("high"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``__doc, __key, __gone``: for each document with deletions the numbers (from 0, among all its lines) of the deleted lines."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    lined = written(_lines(texts, F.col("doc"), F.col("key")), "lines", compression="zstd")
    joined = written(_joined(lined), "joined")

    start = F.greatest(F.col("low") - REACH, F.col("lag"), F.lit(0))  # neither document has lines before its first
    names = written(joined.select("doc", "key").unionByName(joined.select(F.col("doc0").alias("doc"), F.col("key0").alias("key"))).distinct(), "names")
    one = written(lined.select("doc", "key", "w", "ks", "ds").join(names.hint("merge"), ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"]), "near", compression="zstd")
    later = joined.withColumn("start", start).join(one.hint("merge"), ["doc", "key"])
    cut = lambda c: F.slice(c, F.col("start") + 1, F.col("high") + (1 + REACH) - F.col("start")).alias(c)
    later = later.select("doc", "key", "doc0", "key0", "lag", "start", cut("w"), cut("ks"), cut("ds"))
    other = one.select(F.col("doc").alias("doc0"), F.col("key").alias("key0"), F.col("ds").alias("ds0"))
    both = later.join(other.hint("merge"), ["doc0", "key0"])
    alike = F.zip_with("ds", F.slice("ds0", F.col("start") - F.col("lag") + 1, F.size("ds")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    breaks = F.filter(F.transform(alike, lambda x, k: F.when(~x, k)), lambda k: k.isNotNull())
    ends = F.concat(F.array(F.lit(-1)), breaks, F.array(F.size("ds")))
    both = both.withColumn("ends", ends)
    runs = F.transform(F.sequence(F.lit(0), F.size("ends") - 2), lambda j: F.struct((F.get("ends", j) + 1).alias("a"), (F.get("ends", j + 1) - F.get("ends", j) - 1).alias("n")))
    whole = F.filter(runs, lambda r: F.aggregate(F.slice("w", r["a"] + 1, r["n"]), F.lit(0), lambda x, y: x + y) >= MIN_WORDS)
    gone = both.select("doc", "key", F.flatten(F.transform(whole, lambda r: F.slice("ks", r["a"] + 1, r["n"]))).alias("gone")).where(F.size("gone") > 0)
    gone = gone.groupBy("doc", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("gone"))
    return gone.select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("gone").alias("__gone"))


def dedup_lines(docs: DataFrame, count: str = "__lines", deleted: str = "__gone") -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and the columns ``count`` (its lines before) and ``deleted`` (the numbers of the deleted lines; null if none).

    A null or empty text, a row without ``doc_id`` and documents of fewer than ``MIN_WORDS``
    words are never changed.  Rows that repeat both id and text are one document, rows that
    repeat only the id come in the order of their texts' hashes.  Order of lines is kept; an
    empty table gives no row; further columns pass through, whatever their names, but for those
    that ``count`` and ``deleted`` replace.

    Rows with deletions are looked up by a merge of sorted rows, since they grow with the corpus;
    a filter of bounded size first lets those pass that surely have none, whose texts stay where
    they are.
    """
    gone = written(repeated_lines(docs.select("doc_id", "text")), "gone")
    known = hash_filter(written(gone.select(F.xxhash64("__doc", "__key").alias("h")), "changed")).select("words").scalar()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text"))
    whole = whole.withColumn("h", F.when(F.col("id").isNotNull() & F.col("text").isNotNull(), F.xxhash64("id", "hash"))).withColumn("filter", known)
    whole = whole.withColumn("maybe", in_filter("filter", "h")).drop("filter", "h")
    none = F.lit(None).cast(gone.schema["__gone"].dataType)
    some = whole.where("maybe").join(gone.hint("merge"), (F.col("id") == F.col("__doc")) & (F.col("hash") == F.col("__key")), "left").select("row", "text", F.col("__gone").alias("gone"))
    both = whole.where("not maybe").select("row", "text", none.alias("gone")).unionByName(some).withColumn("raw", F.split("text", "\n"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), "gone")
    kept = F.array_join(F.transform(stays, lambda k: F.get("raw", k)), "\n")
    lines = F.when(F.col("text").isNotNull(), F.size("raw")).otherwise(0)
    return both.select(*[F.when(F.col("gone").isNotNull(), kept).otherwise(F.col(f"row.`{c}`")).alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (count, deleted)], lines.alias(count), F.col("gone").alias(deleted))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, the ``text`` that stays, ``n_lines`` before, ``n_removed``, and ``removed`` (the numbers of the deleted lines, comma-joined)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.transform("__gone", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, k - 1 AS k, ls[k] AS line, len(regexp_extract_all(ls[k], '[^\x20\x09-\x0D]+')) AS w FROM d, unnest(range(1, len(ls) + 1)) AS u(k)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM x WHERE w > 0),
f AS (SELECT a.doc_id, a.i AS lo, min(b.i) AS hi FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {MIN_WORDS} AND b.c - a.c + a.w >= {MIN_WORDS} GROUP BY ALL),
b AS (SELECT a.doc_id, max(b.i) AS lo, a.i AS hi FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i AND b.i + {MIN_WORDS} AND a.c - b.c + b.w >= {MIN_WORDS} GROUP BY ALL),
v AS (SELECT * FROM f UNION SELECT * FROM b),
t AS (SELECT v.doc_id, v.lo, v.hi, string_agg(n.line, chr(10) ORDER BY n.i) AS body FROM v JOIN n ON n.doc_id = v.doc_id AND n.i BETWEEN v.lo AND v.hi GROUP BY ALL),
e AS (SELECT *, min((doc_id, lo)) OVER (PARTITION BY body) AS first FROM t),
g AS (SELECT DISTINCT e.doc_id, n.k FROM e JOIN n ON n.doc_id = e.doc_id AND n.i BETWEEN e.lo AND e.hi WHERE (e.doc_id, e.lo) > e.first),
s AS (SELECT doc_id, list(k ORDER BY k) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN d.text ELSE coalesce((SELECT string_agg(x.line, chr(10) ORDER BY x.k) FROM x WHERE x.doc_id = d.doc_id AND NOT list_contains(s.gone, x.k)), '') END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed
FROM d LEFT JOIN s USING (doc_id)
"""

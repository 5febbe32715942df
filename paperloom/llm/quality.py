"""Quality rules whose thresholds adapt to each language and source.

Everything here is DataFrame functions.  Each metric is an integer; its sketch is a histogram
whose bins keep the six leading bits of a value, so sketches of any rows merge by adding counts,
a value is kept to within 1/32 of itself, and the result does not depend on the order of
merging.  From the sketches of documents that pass the fixed base rules come quartiles, and from
those a fence on each metric; a joined filter then takes out the documents beyond a fence.  A
language and source with fewer than ``MIN_DOCUMENTS`` use the merged sketch of the language, a
language with fewer that of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import table, written

SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCUMENTS = 50
#: A fence lies so many spreads beyond the nearer quartile.
SPREADS = 3
#: Metric: the expression of its integer, the least spread that counts, whether low values fail too.
METRICS = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 50, False),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 100, False),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 100, False),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 60, True),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the five counts, ``n_lines`` (lines with a word) and ``base_failed`` of each row; a null text has no words."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), t.alias("t"), F.btrim(t, F.lit(SPACE)).alias("trimmed"))
    words = words.select("doc_id", "lang", "source", "t", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACE_CLASS)).alias("words"), F.filter(F.split("t", "\n"), lambda x: _without(x, SPACE) != "").alias("lines"))
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    words = words.withColumn("windows", F.when(F.size("words") >= 3, F.slice(hashes, F.lit(1), F.size("words") - 2)).otherwise(F.array().cast("array<long>")))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = words.withColumn("ordered", F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, k: F.coalesce(x["h"] == F.get("ordered", k)["h"], F.lit(False))
    found = F.transform(F.filter("ordered", lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"])
    placed = ordered.withColumn("at", F.when(F.col("ordered").isNotNull(), F.sort_array(found)))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    out = placed.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), SPACE)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, level, metric, value, n``: the bins of each metric, for each language and source (level 0), language (1), and all (2)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).alias("value")) for m, (e, _, _) in METRICS.items()])).alias("m")
    values = rows.where(~F.col("base_failed")).select("lang", "source", each).select("lang", "source", "m.metric", F.expr("m.value").alias("x"))
    low = "greatest(length(bin(x)) - 6, 0)"
    bins = values.groupBy("lang", "source", "metric", F.expr(f"shiftleft(shiftright(x, {low}), {low})").alias("value")).agg(F.count("*").alias("n"))
    merged = bins.withColumn("at", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    lang, source = F.when(F.col("at") < 2, F.col("lang")), F.when(F.col("at") < 1, F.col("source"))
    return merged.groupBy(lang.alias("lang"), source.alias("source"), F.col("at").alias("level"), "metric", "value").agg(F.sum("n").alias("n"))


def fences(bins: DataFrame) -> DataFrame:
    """``lang, source, level, documents`` and for each metric ``<metric>_low`` and ``<metric>_high``, bounds that still pass."""
    group = ["lang", "source", "level", "metric"]
    upto = Window.partitionBy(*group).orderBy("value")
    total = Window.partitionBy(*group)
    ranked = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("of", F.sum("n").over(total))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("of"), F.col("value")))
    spans = ranked.groupBy(*group).agg(F.max("of").alias("documents"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    columns = []
    for m, (_, least, both) in METRICS.items():
        spread = SPREADS * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        columns.append(F.max(F.when(F.col("metric") == m, F.col("q3") + spread)).alias(f"{m}_high"))
        columns.append(F.max(F.when(F.col("metric") == m, F.col("q1") - spread if both else F.lit(-1).cast("long"))).alias(f"{m}_low"))
    return spans.groupBy("lang", "source", "level").agg(F.max("documents").alias("documents"), *columns)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed`` and ``kept`` of each row of ``docs``.

    A null language or source is a group like any other; repeated rows count as often as they
    come; an empty table gives no row; other columns are ignored.
    """
    rows = written(measured(docs), "quality")
    bounds = written(fences(sketches(rows)), "fences")
    names = [f"{m}_{side}" for m in METRICS for side in ("low", "high")]
    level = lambda k, on: bounds.where(F.col("level") == k).where(F.col("documents") >= MIN_DOCUMENTS).select(*[F.col(c).alias(f"{c}_{k}") for c in on], *[F.col(n).alias(f"{n}_{k}") for n in names])
    joined = rows.join(level(0, ["lang", "source"]), F.col("lang").eqNullSafe(F.col("lang_0")) & F.col("source").eqNullSafe(F.col("source_0")), "left")
    joined = joined.join(level(1, ["lang"]), F.col("lang").eqNullSafe(F.col("lang_1")), "left")
    everywhere = bounds.where("level = 2").first()  # one row: the fences of all documents
    fence = lambda n: F.coalesce(F.col(f"{n}_0"), F.col(f"{n}_1"), F.lit(everywhere and everywhere[n]))
    within = F.lit(True)
    for m, (e, _, _) in METRICS.items():
        value = F.expr(e)
        within &= (value <= fence(f"{m}_high")) & (value >= fence(f"{m}_low"))
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns.

    Rows that repeat an id, and those without one, stay or go together: they stay if one of them
    is kept.  An empty table gives no row.
    """
    kept = quality_verdicts(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of every document."""
    return quality_verdicts(table(spark, sf_dir, "documents"))


_METRIC_SQL = {m: e.replace(" div ", " // ") for m, (e, _, _) in METRICS.items()}
_Q = {m: (f"q3 + {SPREADS} * greatest(q3 - q1, {least})", f"q1 - {SPREADS} * greatest(q3 - q1, {least})" if both else "-1") for m, (_, least, both) in METRICS.items()}

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
x AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {e} AS x FROM b WHERE NOT base_failed" for m, e in _METRIC_SQL.items())}),
s AS (SELECT lang, source, metric, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS v FROM x),
l AS (SELECT 0 AS level, lang, source, metric, v FROM s UNION ALL SELECT 1, lang, NULL, metric, v FROM s UNION ALL SELECT 2, NULL, NULL, metric, v FROM s),
c AS (SELECT level, lang, source, metric, v, count(*) AS n FROM l GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY v) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS tot FROM c),
q AS (SELECT level, lang, source, metric, max(tot) AS documents, min(v) FILTER (4 * upto >= tot) AS q1, min(v) FILTER (4 * upto >= 3 * tot) AS q3 FROM k GROUP BY ALL),
f AS (SELECT level, lang, source, max(documents) AS documents, {", ".join(f"max({hi}) FILTER (metric = '{m}') AS {m}_high, max({lo}) FILTER (metric = '{m}') AS {m}_low" for m, (hi, lo) in _Q.items())} FROM q GROUP BY ALL),
j AS (SELECT b.*, {", ".join(f"coalesce(f0.{m}_{s}, f1.{m}_{s}, f2.{m}_{s}) AS {m}_{s}" for m in METRICS for s in ("low", "high"))}
  FROM b LEFT JOIN f f0 ON f0.level = 0 AND f0.documents >= {MIN_DOCUMENTS} AND b.lang IS NOT DISTINCT FROM f0.lang AND b.source IS NOT DISTINCT FROM f0.source
  LEFT JOIN f f1 ON f1.level = 1 AND f1.documents >= {MIN_DOCUMENTS} AND b.lang IS NOT DISTINCT FROM f1.lang LEFT JOIN f f2 ON f2.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(f"{e} BETWEEN {m}_low AND {m}_high" for m, e in _METRIC_SQL.items())}, true) AS kept FROM j
"""

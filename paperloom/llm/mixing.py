"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent, normalised.  The exponent
is bisected over a fixed grid from 0 (all sources alike) to 1 (as they are): the largest at which
the weights' entropy reaches a target, or, if that asks too many repetitions of a source, the
least that keeps within the limit.  The budget is the least at which every document comes once.

Weights are realised as block permutations: each epoch of a source is a permutation of its
documents by a seeded hash, whole epochs as often as the source's budget holds them and of the
last one as many documents as fit.  The stream is cut into blocks of about ``BLOCK_TOKENS``, each
of which takes the same part of every source's budget.  Prefix sums of tokens run over hash
ranges of a source first, then inside each, so a source of any size is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import table, written

SPACE = " \t\n\x0b\x0c\r"
#: The entropy aimed at, as a share of that of equal weights.
ENTROPY = 0.98
#: Times that a source's tokens may come at most.
REPETITIONS = 2.0
#: Steps of the exponent between 0 and 1.
GRID = 1024
BLOCK_TOKENS = 1 << 20
RANGE_DOCUMENTS = 4096


def words(text: str = "text") -> Column:
    """Words of a text as its tokens; none for null."""
    trimmed = F.btrim(F.col(text).cast("string"), F.lit(SPACE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def exponent(sources: DataFrame, entropy: float = ENTROPY, repetitions: float = REPETITIONS) -> float:
    """The exponent for ``sources`` (``tokens`` of each), as a multiple of ``1 / GRID``; 1 without tokens."""
    live = sources.where("tokens > 0")
    top = live.agg(F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count("*").alias("n")).first()
    if not top["n"] or top["n"] == 1:
        return 1.0

    def reaches(steps: list[int]) -> list[bool]:
        """Whether the entropy at each step reaches the target; one pass over the sources for all of them."""
        share = F.col("tokens") / F.lit(float(top["most"]))
        sums = [c for k in steps for p in [F.pow(share, F.lit(k / GRID))] for c in (F.sum(p), F.sum(p * F.log(share)) * (k / GRID))]
        row = live.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
        return [math.log(row[2 * i]) - row[2 * i + 1] / row[2 * i] >= entropy * math.log(top["n"]) - 1e-12 for i in range(len(steps))]

    low, high = 0, GRID  # the entropy falls as the exponent grows: at ``low`` it reaches the target
    if reaches([GRID])[0]:
        low = GRID
    while high - low > 1:
        steps = sorted({low + (high - low) * k // 16 for k in range(1, 16)} - {low, high})
        for k, ok in zip(steps, reaches(steps), strict=True):
            low, high = (max(low, k), high) if ok else (low, min(high, k))
    spread = math.log(top["most"] / top["least"])
    limit = math.ceil(GRID * (1 - math.log(repetitions) / spread) - 1e-9) if spread else 0
    return max(low, min(GRID, max(0, limit))) / GRID


def _order(seed: int, epoch: Column) -> Column:
    """Where a document stands in an epoch's permutation."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _source() -> Column:
    """A source's key: null is one too."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source").cast("string")))


def mix(docs: DataFrame, entropy: float = ENTROPY, repetitions: float = REPETITIONS, seed: int = 1, tokens: Column | None = None) -> DataFrame:
    """``docs``, all columns, each row as often as its source's weight asks, with ``__tokens``, ``__epoch``, ``__start`` and ``__block``.

    ``__start`` is the place in the source's stream, ``__block`` that in the mixed one.  A null
    source is a source.  Documents without tokens come once, in the block of their place.  Rows
    that repeat an id are documents of their own; an empty table gives no row.
    """
    keyed = docs.withColumn("__source", _source()).withColumn("__tokens", words() if tokens is None else tokens)
    small = written(keyed.groupBy("__source").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("documents")), "sources")
    power = exponent(small, entropy, repetitions)
    top = small.where("tokens > 0").agg(F.max("tokens").alias("most"), F.sum("documents").alias("documents")).first()
    if not top["documents"]:
        return keyed.withColumns({"__epoch": F.lit(0), "__start": F.lit(0).cast("long"), "__block": F.lit(0).cast("long")}).drop("__source")
    # At the least budget with every document once, the largest source comes just once.
    quota = F.round(F.col("tokens") * F.pow(F.lit(float(top["most"])) / F.col("tokens"), F.lit(1 - power))).cast("long")
    quotas = small.select("__source", "tokens", F.when(F.col("tokens") > 0, quota).otherwise(0).alias("quota"))
    budget = quotas.agg(F.sum("quota").alias("b")).first()["b"]
    blocks = max(1, math.ceil(budget / BLOCK_TOKENS))
    ranges = 1 << max(0, math.ceil(math.log2(max(1, small.agg(F.max("documents")).first()[0] / RANGE_DOCUMENTS))))
    quotas = written(quotas, "quotas").withColumnsRenamed({"__source": "__of", "tokens": "__all", "quota": "__quota"})

    dealt = keyed.join(quotas, F.col("__source") == F.col("__of"))
    last = F.when(F.col("__all") > 0, F.floor((F.col("__quota") - 1) / F.greatest(F.col("__all"), F.lit(1)))).otherwise(0)
    each = dealt.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("__tokens") > 0, F.greatest(last, F.lit(0))).otherwise(0).cast("int"))))
    each = each.withColumn("__order", _order(seed, F.col("__epoch"))).withColumn("__range", F.floor(F.conv(F.substring("__order", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("int"))
    within = Window.partitionBy("__source", "__epoch", "__range").orderBy("__order", "__tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("__s", "__e").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy(F.col("__source").alias("__s"), F.col("__epoch").alias("__e"), F.col("__range").alias("__r")).agg(F.sum("__tokens").alias("__sum"))
    bases = written(sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum"), "ranges")
    placed = each.withColumn("__upto", F.sum("__tokens").over(within)).join(bases, (F.col("__source") == F.col("__s")) & (F.col("__epoch") == F.col("__e")) & (F.col("__range") == F.col("__r")))
    start = F.col("__epoch") * F.col("__all") + F.col("__base") + F.col("__upto") - F.col("__tokens")
    taken = placed.withColumn("__start", start).where((F.col("__start") + F.col("__tokens") <= F.col("__quota")) | (F.col("__epoch") == 0) & (F.col("__tokens") == 0))
    block = F.when(F.col("__quota") > 0, F.least(F.floor(F.col("__start") * F.lit(blocks) / F.greatest(F.col("__quota"), F.lit(1))), F.lit(blocks - 1))).otherwise(0)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], "__tokens", "__epoch", "__start", block.cast("long").alias("__block"))


def repeated_by_weight(docs: DataFrame, entropy: float = ENTROPY, repetitions: float = REPETITIONS, seed: int = 1) -> DataFrame:
    """``docs``, all columns, each row as often as ``mix`` takes it; texts stay where they are.

    Only ids, sources and counts of tokens are sorted.  An epoch takes a source's documents up to
    a place of its permutation, so a row needs no more than the last place of each epoch of its
    source.  Rows that tie with that last place, which repeat its id, are all taken.  A null text,
    and one without words, comes once; an empty table gives no row.
    """
    narrow = written(docs.select("doc_id", "source", words().alias("__n")), "narrow")
    taken = mix(narrow, entropy, repetitions, seed, F.col("__n")).where("__tokens > 0")
    last = taken.groupBy(_source().alias("__of"), "__epoch").agg(F.max(_order(seed, F.col("__epoch"))).alias("last"))
    limits = written(last.groupBy("__of").agg(F.collect_list(F.struct(F.col("__epoch").alias("epoch"), "last")).alias("__limits")), "limits")
    some = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    times = F.when(some, F.size(F.filter(F.coalesce("__limits", F.array().cast("array<struct<epoch:int,last:string>>")), lambda x: _order(seed, x["epoch"]) <= x["last"]))).otherwise(1)
    both = docs.join(limits, _source() == F.col("__of"), "left").withColumn("__times", times)
    return both.where("__times > 0").select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__time")).drop("__time")


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, epoch, n_tokens, start, block`` of each place that a document has in the mixed stream."""
    narrow = written(table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("n")), "narrow")
    mixed = mix(narrow, tokens=F.col("n"))
    return mixed.select("doc_id", "source", F.col("__epoch").cast("int").alias("epoch"), F.col("__tokens").alias("n_tokens"), F.col("__start").alias("start"), F.col("__block").alias("block"))


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS t FROM documents),
s AS (SELECT source, CAST(sum(t) AS BIGINT) AS tokens FROM d GROUP BY source),
l AS (SELECT *, tokens / max(tokens) OVER () AS share FROM s WHERE tokens > 0),
h AS (SELECT k, ln(sum(pow(share, k / {GRID}))) - sum(pow(share, k / {GRID}) * ln(share)) * k / {GRID} / sum(pow(share, k / {GRID})) AS e FROM l, range(0, {GRID} + 1) AS g(k) GROUP BY k),
x AS (SELECT max(k) FILTER (e >= {ENTROPY} * ln((SELECT count(*) FROM l)) - 1e-12) AS k FROM h),
r AS (SELECT CASE WHEN max(tokens) > min(tokens) THEN least({GRID}, greatest(0, ceil({GRID} * (1 - ln({REPETITIONS}) / ln(max(tokens) / min(tokens))) - 1e-9))) ELSE 0 END AS k, count(*) AS n, max(tokens) AS most FROM l),
p AS (SELECT CASE WHEN n <= 1 THEN 1 ELSE greatest(coalesce(x.k, 0), r.k) / {GRID} END AS power, most FROM x, r),
q AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN CAST(round(tokens * pow(most / tokens, 1 - power)) AS BIGINT) ELSE 0 END AS quota FROM s, p),
b AS (SELECT greatest(1, CAST(ceil(sum(quota) / {BLOCK_TOKENS}) AS BIGINT)) AS blocks FROM q),
e AS (SELECT d.*, q.tokens, q.quota, u.epoch FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, unnest(range(0, CAST(CASE WHEN d.t > 0 THEN greatest((q.quota - 1) // greatest(q.tokens, 1), 0) ELSE 0 END + 1 AS BIGINT))) AS u(epoch)),
c AS (SELECT *, epoch * tokens + sum(t) OVER (PARTITION BY source, epoch ORDER BY md5('1:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), t ROWS UNBOUNDED PRECEDING) - t AS start FROM e)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, t AS n_tokens, CAST(start AS BIGINT) AS start,
  CAST(CASE WHEN quota > 0 THEN least(floor(start * blocks / greatest(quota, 1)), blocks - 1) ELSE 0 END AS BIGINT) AS block
FROM c, b WHERE start + t <= quota OR (epoch = 0 AND t = 0)
"""

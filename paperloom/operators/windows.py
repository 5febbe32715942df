"""Ordered operators: ordinals, neighbours, running counters, pairing of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paperloom.functions import occurrences
from paperloom.operators.reading import BLOCKS
from paperloom.operators.registry import Tables, query
from paperloom.plans import blocks

LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem)"


def in_order() -> WindowSpec:
    """An order's lines in the order of ``ord``; windows take it also where ``ord`` would do, so that one sort serves them all."""
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


def ordered_lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("ord", F.row_number().over(in_order()).cast("long"))


@query(f"SELECT l_orderkey, ord, l_partkey FROM {LINES}")
def ordinals(t: Tables) -> DataFrame:
    """Ordinals of a table's rows."""
    return ordered_lines(t).select("l_orderkey", "ord", "l_partkey")


@query(f"SELECT a.l_orderkey, a.ord AS target, b.ord AS neighbour, CASE WHEN b.ord < a.ord THEN 'before' WHEN b.ord = a.ord THEN 'target' ELSE 'after' END AS relation, b.l_partkey FROM {LINES} a JOIN {LINES} b ON a.l_orderkey = b.l_orderkey AND b.ord BETWEEN a.ord - 1 AND a.ord + 1 WHERE a.l_returnflag = 'R'")
def context_radius(t: Tables) -> DataFrame:
    """The neighbours of each target, in the one pass over the story that numbers it: no join is needed, and no second sort."""
    w = in_order()
    at = F.row_number().over(w).cast("long")
    lines = t.lineitem.where("l_orderkey is not null").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("asked"))
    near = lines.select("l_orderkey", "asked", at.alias("target"), F.lag("l_partkey").over(w).alias("before"), "l_partkey", F.lead("l_partkey").over(w).alias("after"), F.lead("l_orderkey").over(w).isNotNull().alias("more")).where("asked")
    side = lambda relation, step, part: F.struct(F.lit(relation).alias("relation"), (F.col("target") + step).alias("neighbour"), F.col(part).alias("l_partkey"))
    each = F.array(F.when(F.col("target") > 1, side("before", -1, "before")), side("target", 0, "l_partkey"), F.when(F.col("more"), side("after", 1, "after")))
    rows = near.select("l_orderkey", "target", F.explode(each).alias("n")).where("n is not null")
    return rows.select("l_orderkey", "target", "n.neighbour", "n.relation", "n.l_partkey")


@query(f"SELECT o_orderkey, CAST(0 AS BIGINT) AS ord, 'parent' AS relation, o_custkey AS ref FROM orders UNION ALL SELECT l_orderkey, ord, 'child', l_partkey FROM {LINES} WHERE ord <= 3")
def row_context(t: Tables) -> DataFrame:
    """A parent, then the first ``2 r + 1`` of its children."""
    parents = t.orders.select("o_orderkey", F.lit(0).cast("long").alias("ord"), F.lit("parent").alias("relation"), F.col("o_custkey").alias("ref"))
    return parents.union(ordered_lines(t).where("ord <= 3").select("l_orderkey", "ord", F.lit("child"), "l_partkey"))


@query(f"SELECT l_orderkey, ord, span, 1 + coalesce(CAST(sum(span) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS visual_column FROM (SELECT *, 1 + CAST(l_quantity AS BIGINT) % 3 AS span FROM {LINES})")
def visual_columns(t: Tables) -> DataFrame:
    """A cell's visual column is one more than the spans before it."""
    w = in_order().rowsBetween(Window.unboundedPreceding, -1)
    cells = ordered_lines(t).withColumn("span", 1 + F.col("l_quantity").cast("long") % 3)
    return cells.select("l_orderkey", "ord", "span", (1 + F.coalesce(F.sum("span").over(w), F.lit(0))).alias("visual_column"))


def list_counters(rows: DataFrame, key: list[str], order: list[str], level: Column, levels: int) -> DataFrame:
    """``n0``, ``n1`` and so on: each level's counter, which any shallower item resets; ``level`` counts from 0."""
    run = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__level", level)
    for k in range(levels):
        out = out.withColumn(f"__run{k}", F.sum((F.col("__level") < k).cast("long")).over(run))
        inside = Window.partitionBy(*key, f"__run{k}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"n{k}", F.sum((F.col("__level") == k).cast("long")).over(inside))
    return out.drop("__level", *[f"__run{k}" for k in range(levels)])


@query("""
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 ELSE 1 END AS level FROM conversations),
a AS (SELECT *, sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t),
b AS (SELECT conv_id, turn, level, CAST(sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS n0, CAST(sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, run ORDER BY turn) AS BIGINT) AS n1 FROM a)
SELECT conv_id, turn, CASE level WHEN 0 THEN n0 || '.' ELSE n0 || '.' || n1 END AS label FROM b""")
def list_labels(t: Tables) -> DataFrame:
    """Two-level list labels: questions count, answers count under them."""
    counted = list_counters(t.conversations, ["conv_id"], ["turn"], F.when(F.col("role") == "user", 0).otherwise(1), 2)
    label = F.when(F.col("role") == "user", F.concat(F.col("n0").cast("string"), F.lit("."))).otherwise(F.concat_ws(".", F.col("n0").cast("string"), F.col("n1").cast("string")))
    return counted.select("conv_id", "turn", label.alias("label"))


@query(f"SELECT doc_id, ord, n, CAST(CASE WHEN n >= 2 THEN p1 + 1 + instr(substr(text, p1 + 2), 'th') ELSE 0 END AS BIGINT) AS second FROM (SELECT *, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT) AS n, instr(text, 'th') AS p1 FROM {BLOCKS})")
def occurrence_n(t: Tables) -> DataFrame:
    """How often a literal occurs without overlap, and where it does so the second time."""
    text = F.col("text")
    first = F.locate("th", text)
    second = F.when(F.col("n") >= 2, F.expr("locate('th', text, locate('th', text) + 2)")).otherwise(0)
    rows = blocks(t.documents).withColumn("n", occurrences(text, "th"))
    return rows.withColumn("p1", first).select("doc_id", "ord", "n", second.cast("long").alias("second"))


def range_pairs_of(rows: DataFrame, key: list[str], order: list[str], start: Column, end: Column) -> DataFrame:
    """Starts and ends paired first in, first out; an end without an open start is dropped.

    With the running counts of starts and ends, the underflow is the running maximum of ends over
    starts; an end at which it rises is dropped, and the r-th start meets the r-th end that stays.
    """
    run = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumns({"__s": start.cast("long"), "__e": end.cast("long")}).withColumns({"__starts": F.sum("__s").over(run), "__ends": F.sum("__e").over(run)})
    under = counted.withColumn("__over", F.col("__ends") - F.col("__starts")).withColumn("__under", F.greatest(F.max("__over").over(run), F.lit(0))).withColumn("__was", F.coalesce(F.greatest(F.max("__over").over(before), F.lit(0)), F.lit(0)))
    keep_end = (F.col("__e") == 1) & (F.col("__under") == F.col("__was"))
    ranked = under.withColumn("__rank", F.when(F.col("__s") == 1, F.col("__starts")).when(keep_end, F.col("__ends") - F.col("__under"))).where("__rank is not null")
    return ranked.groupBy(*key, "__rank").agg(F.max(F.when(F.col("__s") == 1, F.struct(*order))).alias("start"), F.max(F.when(F.col("__e") == 1, F.struct(*order))).alias("end")).withColumnRenamed("__rank", "pair")


@query("""
WITH r AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS s, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS e FROM events WHERE event_type IN ('signup', 'purchase')),
c AS (SELECT *, sum(s) OVER w AS ss, sum(e) OVER w AS ee FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, greatest(0, max(ee - ss) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS under, coalesce(greatest(0, max(ee - ss) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS was FROM c)
SELECT a.user_id, CAST(a.ss AS BIGINT) AS pair, a.event_id AS start_id, b.event_id AS end_id FROM u a LEFT JOIN u b ON a.user_id = b.user_id AND b.e = 1 AND b.under = b.was AND b.ee - b.under = a.ss WHERE a.s = 1""")
def range_pairs(t: Tables) -> DataFrame:
    """Signups as starts and purchases as ends of ranges, paired for each user."""
    rows = t.events.where(F.col("event_type").isin("signup", "purchase")).select("user_id", "ts", "event_id", "event_type")
    pairs = range_pairs_of(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return pairs.where("start is not null").select("user_id", "pair", F.col("start.event_id").alias("start_id"), F.col("end.event_id").alias("end_id"))


@query("SELECT user_id, event_id, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM events")
def nesting_depth(t: Tables) -> DataFrame:
    """Running begins less ends."""
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.sum(step).over(w).cast("long").alias("depth"))

"""What is said about targets, of any kinds, in one grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.registry import Tables, query

#: Places of a target that share a row; a target with annotations in more of them has several rows.
SLICE = 10_000


def tagged(rows: DataFrame, target: Column | str, place: Column | str, key: list[str], **values: Column | str) -> DataFrame:
    """``key, target, place`` and a column for each of ``values``, by kind, null where it is blank; rows without a target or a value say nothing about any.

    ``place`` orders annotations of a kind, and is where the annotating row stands, so that what a
    target is told from far apart need not meet in one row.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    told = lambda c: F.when(F.btrim(c) != "", c)
    each = rows.select(*key, col(target).cast("string").alias("target"), col(place).cast("long").alias("place"), *[told(col(v).cast("string")).alias(kind) for kind, v in values.items()])
    return each.where((F.btrim("target") != "") & F.coalesce(*[F.col(f"`{kind}`") for kind in values]).isNotNull())


def gathered(parts: list[DataFrame], key: list[str], kinds: list[str], size: int = SLICE) -> DataFrame:
    """``key, target, slice`` and an array for each kind: its distinct values in the order of their first places, then of the values.

    All parts are one union whose rows, a row for all that it says, are exchanged once, by target
    and slice, before they are grouped: what is shuffled are plain rows, not collections.  A target
    is one row unless its annotations stand further apart than ``size`` places; values are distinct in a row.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("slice", F.floor(F.col("place") / size))
    some = [k for k in kinds if k in every.columns]
    dealt = every.select(*key, "target", "slice", "place", *some).repartition(*key, "target", "slice")
    told = dealt.groupBy(*key, "target", "slice").agg(F.collect_set(F.struct("place", *some)).alias("__told"))
    none = F.array().cast("array<string>")
    of = lambda kind: F.array_distinct(F.transform(F.array_sort(F.transform(F.filter("__told", lambda x: x[kind].isNotNull()), lambda x: F.struct(x["place"].alias("place"), x[kind].alias("value")))), lambda x: x["value"]))
    return told.select(*key, "target", "slice", *[(of(kind) if kind in some else none).alias(kind) for kind in kinds])


ORDER_KINDS = ["parts", "suppliers", "flags", "status", "customer", "priority"]


@query(
    """
WITH e AS (SELECT l_orderkey AS target, l_linenumber AS place, unnest([{'kind': 'parts', 'value': CAST(l_partkey AS VARCHAR)}, {'kind': 'suppliers', 'value': CAST(l_suppkey AS VARCHAR)}, {'kind': 'flags', 'value': l_returnflag}, {'kind': 'status', 'value': l_linestatus}], recursive := true) FROM lineitem
UNION ALL SELECT o_orderkey, 0, unnest([{'kind': 'customer', 'value': CAST(o_custkey AS VARCHAR)}, {'kind': 'priority', 'value': o_orderpriority}], recursive := true) FROM orders),
f AS (SELECT target, place // 4 AS slice, kind, value, min(place) AS place FROM e WHERE target IS NOT NULL AND trim(value) <> '' GROUP BY ALL)
SELECT CAST(target AS VARCHAR) AS target, CAST(slice AS BIGINT) AS slice, """
    + ", ".join(f"coalesce(string_agg(value, ',' ORDER BY place, value) FILTER (kind = '{k}'), '') AS {k}" for k in ORDER_KINDS)
    + " FROM f GROUP BY target, slice"
)
def target_annotations(t: Tables) -> DataFrame:
    """All that lines and orders say about each order, in one grouping; an order's slice has four lines."""
    lines = tagged(t.lineitem, "l_orderkey", "l_linenumber", [], parts="l_partkey", suppliers="l_suppkey", flags="l_returnflag", status="l_linestatus")
    orders = tagged(t.orders, "o_orderkey", F.lit(0), [], customer="o_custkey", priority="o_orderpriority")
    both = gathered([lines, orders], [], ORDER_KINDS, 4)
    return both.select("target", F.col("slice").cast("long").alias("slice"), *[F.array_join(k, ",").alias(k) for k in ORDER_KINDS])

"""Edit operations in their set-based form: one operation over many documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import nth_replaced, occurrences
from paperloom.operators.reading import BLOCKS
from paperloom.operators.registry import Tables, query
from paperloom.operators.windows import LINES, in_order, ordered_lines
from paperloom.plans import blocks


@query("SELECT o_orderkey, coalesce(n, 0) AS actual, CAST(1 + o_orderkey % 7 AS BIGINT) AS expected, CASE WHEN coalesce(n, 0) = 1 + o_orderkey % 7 THEN 'ok' ELSE 'E3201' END AS code FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def guard_rows(t: Tables) -> DataFrame:
    """Row-count guards: a mismatch is a diagnostic, never a failed job."""
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    actual, expected = F.coalesce("n", F.lit(0)).cast("long"), (1 + F.col("o_orderkey") % 7).cast("long")
    return t.orders.join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", actual.alias("actual"), expected.alias("expected"), F.when(actual == expected, "ok").otherwise("E3201").alias("code"))


@query(f"""
WITH b AS (SELECT *, string_split(text, 'on') AS parts FROM {BLOCKS})
SELECT doc_id, ord, CASE WHEN len(parts) > 2 THEN array_to_string(parts[1:2], 'on') || 'ON' || array_to_string(parts[3:], 'on') ELSE text END AS text, CAST(len(parts) - 1 AS BIGINT) AS matches, CASE WHEN len(parts) < 3 THEN 'E4203' ELSE 'ok' END AS code FROM b""")
def replace_text(t: Tables) -> DataFrame:
    """The second occurrence replaced in each block; E4203 where there is none."""
    n = occurrences(F.col("text"), "on")
    return blocks(t.documents).select("doc_id", "ord", nth_replaced(F.col("text"), "on", "ON", 2).alias("text"), n.alias("matches"), F.when(n < 2, "E4203").otherwise("ok").alias("code"))


@query(f"""
WITH h AS (SELECT doc_id, ord, ord * 2 AS place, text FROM {BLOCKS} UNION ALL SELECT doc_id, NULL, ord * 2 + 1, 'NEW' FROM {BLOCKS} WHERE contains(text, 'the '))
SELECT doc_id, ord AS input_ord, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS final_ord, text FROM h""")
def insert_after(t: Tables) -> DataFrame:
    """A block after each target; input ordinals stay bound while final ones are counted anew."""
    rows = blocks(t.documents)
    kept = rows.select("doc_id", F.col("ord").alias("input_ord"), (F.col("ord") * 2).alias("place"), "text")
    new = rows.where(F.contains("text", F.lit("the "))).select("doc_id", F.lit(None).cast("long").alias("input_ord"), (F.col("ord") * 2 + 1).alias("place"), F.lit("NEW").alias("text"))
    final = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")).cast("long")
    return kept.unionByName(new).select("doc_id", "input_ord", final.alias("final_ord"), "text")


@query(f"""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, count(*) FILTER (l_returnflag <> 'R') OVER (PARTITION BY l_orderkey) AS stay FROM {LINES})
SELECT l_orderkey, ord AS input_ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) AS final_ord, CASE WHEN stay = 0 THEN 'E4304' ELSE 'ok' END AS code FROM c WHERE l_returnflag <> 'R' OR stay = 0""")
def delete_row(t: Tables) -> DataFrame:
    """Returned rows deleted, the others counted anew; a table may not lose its last row (E4304), so it stays as it is."""
    stay = F.count_if(F.col("l_returnflag") != "R").over(Window.partitionBy("l_orderkey"))
    rows = ordered_lines(t).withColumn("stay", stay).where((F.col("l_returnflag") != "R") | (F.col("stay") == 0))
    final = F.row_number().over(in_order()).cast("long")
    return rows.select("l_orderkey", F.col("ord").alias("input_ord"), final.alias("final_ord"), F.when(F.col("stay") == 0, "E4304").otherwise("ok").alias("code"))

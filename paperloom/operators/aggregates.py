"""Summaries, duplicates and conditional counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.registry import Tables, query


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def change_summary(t: Tables) -> DataFrame:
    """Changes by type."""
    return t.events.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


_DIMENSIONS = {"story": "CAST(user_id % 3 AS VARCHAR)", "part": "strftime(ts, '%Y-%m-%d')", "author": "CAST(user_id AS VARCHAR)", "target": "coalesce(nullif(props, '{}'), '(none)')"}


@query(" UNION ALL ".join(f"SELECT '{d}' AS dimension, {e} AS key, event_type AS type, count(*) AS n FROM events GROUP BY ALL" for d, e in _DIMENSIONS.items()))
def group_summary(t: Tables) -> DataFrame:
    """Changes by each of four dimensions and type, in one pass; a blank key counts as ``(none)``."""
    e = t.events.select("event_type", (F.col("user_id") % 3).cast("string").alias("story"), F.date_format("ts", "yyyy-MM-dd").alias("part"), F.col("user_id").cast("string").alias("author"), F.coalesce(F.nullif("props", F.lit("{}")), F.lit("(none)")).alias("target"))
    stacked = e.select(F.col("event_type").alias("type"), F.expr("stack(4, 'story', story, 'part', part, 'author', author, 'target', target) as (dimension, key)"))
    return stacked.groupBy("dimension", "key", "type").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(sum(n) AS BIGINT) AS n, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS types FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def target_summary(t: Tables) -> DataFrame:
    """Changes of each target, with the counts of its types."""
    by_type = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("k"))
    named = F.concat_ws("=", "event_type", F.col("k").cast("string"))
    return by_type.groupBy("user_id").agg(F.sum("k").alias("n"), F.array_join(F.array_sort(F.collect_list(named)), ",").alias("types"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS replies, arg_min(role, turn) AS first_role, length(arg_min(text, turn)) AS first_chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def thread_summary(t: Tables) -> DataFrame:
    """A thread's counts, and what its first and last entries say; each group of columns is from one entry."""
    first, last = F.min_by(F.struct("role", "text"), "turn"), F.max_by(F.struct("role"), "turn")
    rows = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("replies"), first.alias("f"), last.alias("l"))
    return rows.select("conv_id", "turns", "replies", F.col("f.role").alias("first_role"), F.length("f.text").cast("long").alias("first_chars"), F.col("l.role").alias("last_role"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def duplicates(t: Tables) -> DataFrame:
    """Documents whose text others have too, with the least id of those and their number.

    Texts meet by their digest (SHA-256), so none is shuffled; a text of very many documents is
    counted before it is shuffled and is never one row or one list.
    """
    keyed = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    groups = keyed.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, F.col("digest").eqNullSafe(F.col("d"))).select("doc_id", "first_id", "n")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS starts, count(*) FILTER (o_orderstatus = 'O') AS ends FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') <> count(*) FILTER (o_orderstatus = 'O')")
def paired_counts(t: Tables) -> DataFrame:
    """Ids whose starts and ends are not as many."""
    counts = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("starts"), F.count_if(F.col("o_orderstatus") == "O").alias("ends"))
    return counts.where("starts <> ends")


_TAGS = ["p", "li", "a", "b", "br", "h1", "table", "img"]


@query(" UNION ALL ".join(f"SELECT page_id, '{tag}' AS feature, CAST(len(regexp_extract_all(html, '<{tag}[ >]')) AS BIGINT) AS n FROM pages WHERE regexp_matches(html, '<{tag}[ >]')" for tag in _TAGS))
def feature_counts(t: Tables) -> DataFrame:
    """Counts of many features in one pass over a page; those that do not occur are left out."""
    counted = t.pages.select("page_id", *[F.regexp_count("html", F.lit(f"<{tag}[ >]")).cast("long").alias(tag) for tag in _TAGS])
    return counted.unpivot("page_id", _TAGS, "feature", "n").where("n > 0")


@query("SELECT l_orderkey, count(*) AS rows, CAST(max(l_linenumber) AS BIGINT) AS columns, bool_or(l_returnflag = 'R') AS any_returned FROM lineitem GROUP BY l_orderkey")
def table_rollup(t: Tables) -> DataFrame:
    """Rows, columns and flags of each table."""
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.max("l_linenumber").cast("long").alias("columns"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


@query("SELECT CAST(coalesce(max(event_id), 0) + 1 AS BIGINT) AS next_id FROM events")
def max_id(t: Tables) -> DataFrame:
    """The next revision id."""
    return t.events.agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).cast("long").alias("next_id"))

"""Which parts of a package can be reached from its root by relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.packages import parts, rels
from paperloom.sources.tables import written

KEY = ["doc_id", "part"]


def reached(rows: DataFrame) -> DataFrame:
    """``doc_id, part, steps``: the parts that internal relationships lead to from the package's root, and how many it takes at least.

    A part may have several parents, and circles close: each round goes on from what the last one
    found for the first time, so there are as many rounds as the longest way is long, over all
    packages together, and each edge is looked at once.
    """
    there = parts(rows).select(*KEY)
    edges = rels(rows).where("mode = 'Internal'").select("doc_id", F.col("source").alias("from"), F.col("target").alias("part")).distinct()
    edges = written(edges.join(there, KEY, "left_semi"), "edges")
    front = written(edges.where("`from` = '/'").select(*KEY).distinct().withColumn("steps", F.lit(1)), "reached")
    seen, steps = front, 1
    while not front.isEmpty():
        steps += 1
        onward = edges.join(front.select("doc_id", F.col("part").alias("from")), ["doc_id", "from"]).select(*KEY).distinct()
        front = written(onward.join(seen.select(*KEY), KEY, "left_anti").withColumn("steps", F.lit(steps)), "reached")
        seen = seen.unionByName(front)
    return seen


def media_use(rows: DataFrame) -> DataFrame:
    """``doc_id, part, users, shared, orphaned``: each part below ``media``, how many reached parts refer to it, and whether none does, so that it could be left out when the package is saved."""
    found = written(reached(rows), "reached")
    edges = rels(rows).where("mode = 'Internal'").select("doc_id", F.col("source").alias("from"), F.col("target").alias("part")).distinct()
    live = edges.join(found.select("doc_id", F.col("part").alias("from")), ["doc_id", "from"], "left_semi")
    users = live.groupBy(*KEY).agg(F.count("*").alias("users"))
    media = parts(rows).where(F.col("part").contains("/media/")).select(*KEY)
    n = F.coalesce("users", F.lit(0).cast("long"))
    return media.join(users, KEY, "left").select(*KEY, n.alias("users"), (n > 1).alias("shared"), (n == 0).alias("orphaned"))


def pruned(rows: DataFrame) -> DataFrame:
    """The parts to save without media that nothing reached refers to; all else stays, in the columns that ``save`` takes."""
    orphaned = media_use(rows).where("orphaned").select(*KEY)
    return parts(rows).join(orphaned, KEY, "left_anti")

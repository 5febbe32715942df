"""Connected components of a graph of links, as Spark joins.

Each round every node points to its neighbour of least rank (a hash, so that chains of pointers
stay short), pointers are followed to their roots by doubling, and the links are drawn anew
between roots.  Each round leaves at most half of the nodes that still have links.  What a round
makes is a table in the shared folder; no link and no component comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import written


def _rank(c: str) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (``a, b``; any order, repeats and loops allowed): nodes share a root when linked."""
    now = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    every = written(now.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "nodes")
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_rank("b")).alias("to"))
        step = written(least.select(F.col("a").alias("node"), F.when(F.col("to") < _rank("a"), F.col("to.v")).otherwise(F.col("a")).alias("up")), "pointers")
        while True:
            onward = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
            doubled = written(step.join(onward, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "pointers")
            step = doubled.select("node", "up")
            if doubled.where("moved").isEmpty():
                break
        every = written(every.join(step.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "nodes")
        left, right = step.select(F.col("node").alias("a"), F.col("up").alias("ua")), step.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        drawn = now.join(left, "a").join(right, "b").where("ua <> ub")
        now = written(drawn.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
    return every

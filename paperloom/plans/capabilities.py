"""What can be done with a paragraph: facts about each, joined with a table of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.plans.offsets import CONTAINERS, RANGES
from paperloom.plans.packages import attr, blocks, named, nodes

#: Whatever makes a paragraph protected, with what it is called.
PROTECTED = CONTAINERS | {f"{name}{side}": feature for name, feature in RANGES.items() for side in ("Start", "End")} | {"w:fldChar": "field", "w:instrText": "field", "w:commentReference": "comment"}
#: What a run may hold for its changes to be tracked.
PLAIN = ["w:rPr", "w:t", "w:tab", "w:br"]
MODES = ["off", "suggest", "require"]
#: For each operation, in the order in which they are asked, the fact, and the verdict in each mode (none: the fact does not count in it).
DECISIONS = {
    "replace-text": [("protected", "conditional", "conditional", "conditional"), ("run-content", None, "conditional", "unsupported"), ("mixed-formats", None, "conditional", "unsupported"), ("breaks", "conditional", "conditional", "conditional")],
    "replace-paragraph": [("protected", "unsupported", "unsupported", "unsupported"), ("run-content", None, "conditional", "unsupported"), ("mixed-formats", None, "conditional", "unsupported"), ("breaks", None, "conditional", "unsupported")],
    "insert-before": [],
    "insert-after": [],
    "delete-block": [("orphan", "unsupported", "unsupported", "unsupported"), ("section", "supported", "supported", "unsupported"), ("protected", "supported", "supported", "unsupported"), ("breaks", "supported", "supported", "unsupported")],
    "set-style": [],
    "add-bookmark": [("any", None, None, "unsupported"), ("protected", "unsupported", "unsupported", "unsupported")],
    "add-comment": [("protected", "conditional", "conditional", "conditional"), ("breaks", "conditional", "conditional", "conditional")],
}
KEY = ["doc_id", "part", "para_id"]


def decisions() -> list[tuple[str, str, int, str, str]]:
    """``(operation, mode, priority, fact, verdict)``; at last what is true of every paragraph, ``any``, is supported."""
    return [(operation, mode, k, fact, verdict) for operation, rules in DECISIONS.items() for k, (fact, *by_mode) in enumerate([*rules, ("any", *["supported"] * 3)]) for mode, verdict in zip(MODES, by_mode, strict=True) if verdict]


def facts(rows: DataFrame) -> DataFrame:
    """``doc_id, part, para_id, fact, detail`` of the paragraphs right in a story: what is true of each, and by what.

    ``protected`` (by the first such element), ``run-content`` (the first element of its own runs
    beside text), ``mixed-formats`` (own runs with text of unlike properties), ``section``,
    ``orphan`` (a bookmark or comment range, or a field, that would lose an end), ``breaks`` (a
    tab or line break), and ``any``.
    """
    n = nodes(rows)
    para = blocks(rows, "markup").where("kind = 'paragraph'").select("doc_id", "part", F.col("node_id").alias("para_id"))
    depth = n.where("name = 'w:p' and node_id = block_id").select("doc_id", "part", F.col("node_id").alias("para_id"), F.col("depth").alias("at"))
    inner = n.where("node_id <> block_id").drop("para_id").withColumnRenamed("block_id", "para_id").join(depth, KEY)
    own = F.col("depth") == F.col("at") + 2
    local = F.regexp_replace("name", "^[A-Za-z0-9]+:", "")
    first = lambda value, c: F.min_by(value, F.when(c, F.col("node_id")))
    odd = own & (F.col("up") == "w:r") & ~F.col("name").isin(*PLAIN)
    broken = ~F.col("in_del") & (F.col("name").isin("w:tab", "w:br") | (F.col("name") == "w:t") & F.col("text").rlike("[\\t\\n]"))
    said = inner.groupBy(*KEY).agg(
        first(named(PROTECTED), F.col("name").isin(*PROTECTED)).alias("protected"), first(local, odd).alias("run-content"),
        F.max(F.when((F.col("name") == "w:sectPr") & (F.col("up") == "w:pPr") & own, "section")).alias("section"), F.max(F.when(broken, "breaks")).alias("breaks"),
    )

    # A run's properties: the elements from its ``w:rPr`` to its next child, without regard to the order of attributes.
    runs = inner.where("run_id is not null").withColumn("child", F.last(F.when(own & (F.col("up") == "w:r"), F.struct("node_id", "name")), ignorenulls=True).over(Window.partitionBy("doc_id", "part", "run_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)))
    pairs = F.array_sort(F.map_entries("attrs"))
    props = F.array_sort(F.collect_list(F.when(F.col("child.name") == "w:rPr", F.struct("node_id", F.struct("depth", "name", pairs.alias("set"), "text").alias("x")))))
    shown = F.bool_or(own & (F.col("up") == "w:r") & F.col("name").isin("w:t", "w:tab", "w:br"))
    direct = F.bool_or((F.col("node_id") == F.col("run_id")) & (F.col("depth") == F.col("at") + 1))
    marked = runs.groupBy(*KEY, "run_id").agg(F.transform(props, lambda p: p["x"]).alias("props"), shown.alias("shown"), direct.alias("direct")).where("shown and direct")
    mixed = marked.groupBy(*KEY).agg((F.min(F.to_json(F.struct("props"))) != F.max(F.to_json(F.struct("props")))).alias("mixed"))

    # Ends of ranges that count once each in the part, one of them outside.
    ends = n.where(F.col("name").isin("w:bookmarkStart", "w:bookmarkEnd", "w:commentRangeStart", "w:commentRangeEnd")).where(F.btrim(attr("w:id")) != "")
    ends = ends.select("doc_id", "part", "node_id", F.col("block_id").alias("para_id"), F.when(F.col("name").startswith("w:book"), "bookmark").otherwise("comment range").alias("label"), F.col("name").endswith("Start").alias("start"), attr("w:id").alias("id"), attr("w:name").alias("called"))
    of = Window.partitionBy("doc_id", "part", "label", "id")
    ends = ends.withColumns({"starts": F.count_if("start").over(of), "ends": F.count_if(~F.col("start")).over(of), "inside": F.count("*").over(Window.partitionBy("doc_id", "part", "label", "id", "para_id"))})
    lost = ends.where("starts = 1 and ends = 1 and inside = 1 and para_id is not null")
    name = F.concat("label", F.lit(" "), F.when(F.btrim("called") != "", F.col("called")).otherwise(F.col("id")))
    lost = lost.groupBy(*KEY).agg(F.min_by(name, F.struct("label", ~F.col("start"), "node_id")).alias("range"))
    step = F.when(attr("w:fldCharType") == "begin", 1).when(attr("w:fldCharType") == "end", -1).otherwise(0)
    marks = n.where("name = 'w:fldChar'").select("doc_id", "part", F.col("block_id").alias("para_id"), step.alias("step")).withColumn("all", F.sum("step").over(Window.partitionBy("doc_id", "part")))
    split = marks.where("all = 0").groupBy(*KEY).agg((F.sum("step") != 0).alias("split"))

    both = para.join(said, KEY, "left").join(mixed, KEY, "left").join(lost, KEY, "left").join(split, KEY, "left")
    orphan = F.coalesce("range", F.when(F.col("split"), "complex field boundary"))
    values = {"protected": F.col("protected"), "run-content": F.col("`run-content`"), "mixed-formats": F.when(F.col("mixed"), "mixed"), "section": F.col("section"), "orphan": orphan, "breaks": F.col("breaks"), "any": F.lit("")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), v.alias("detail")) for k, v in values.items()])).alias("f")
    return both.select(*KEY, each).select(*KEY, "f.fact", "f.detail").where("detail is not null")


def capabilities(rows: DataFrame, mode: str = "off") -> DataFrame:
    """``doc_id, wire, operation, verdict, reason, detail`` of each operation on each paragraph when changes are tracked as ``mode`` says.

    The decisions, a small table, are joined with the facts; the first of an operation that meets
    one is the verdict, and the fact its reason (``any``: nothing about the paragraph).
    """
    table = rows.sparkSession.createDataFrame([d for d in decisions() if d[1] == mode], "operation string, mode string, priority int, fact string, verdict string").drop("mode")
    first = F.min_by(F.struct("verdict", F.col("fact").alias("reason"), "detail"), "priority")
    best = facts(rows).join(table, "fact").groupBy(*KEY, "operation").agg(first.alias("b")).select(*KEY, "operation", "b.*")
    wires = blocks(rows, "markup").select("doc_id", "part", F.col("node_id").alias("para_id"), "wire")
    return best.join(wires, KEY).select("doc_id", "wire", "operation", "verdict", "reason", F.when(F.col("reason") != "any", F.col("detail")).alias("detail"))

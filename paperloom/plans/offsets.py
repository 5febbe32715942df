"""Where the characters of a paragraph stand: text nodes with offsets, what protects them, matches across runs, and texts of bookmarks.

All of it is windows over rows in document order.  What protects a text node is found by sweeps:
nested elements around it by levels (the element that encloses a node is the last one begun on
the node's level), ranges between markers by running counts of those that are open.  So no node
is compared with every range, and no range is spread over the nodes that it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.spans import crossings, matches, offsets
from paperloom.plans.packages import attr, blocks, named, nodes
from paperloom.sources.tables import written

#: Elements that a text edit must not cross, with what they are called.
CONTAINERS = {
    "m:oMath": "equation",
    "m:oMathPara": "equation",
    "w:hyperlink": "hyperlink",
    "w:fldSimple": "field",
    "w:sdt": "content-control",
    "w:ins": "tracked-insertion",
    "w:del": "tracked-deletion",
    "w:moveFrom": "tracked-move-from",
    "w:moveTo": "tracked-move-to",
    "w:drawing": "drawing",
    "w:pict": "picture",
    "w:object": "object",
}
#: The element names of ranges, without ``Start`` and ``End``, with what they are called.
RANGES = {
    "w:bookmark": "bookmark",
    "w:commentRange": "comment",
    "w:moveFromRange": "tracked-move-from-range",
    "w:moveToRange": "tracked-move-to-range",
    "w:customXmlInsRange": "tracked-custom-xml-insertion",
    "w:customXmlDelRange": "tracked-custom-xml-deletion",
    "w:customXmlMoveFromRange": "tracked-custom-xml-move-from",
    "w:customXmlMoveToRange": "tracked-custom-xml-move-to",
}
FIELD = "field"
PARA = ["doc_id", "part", "para_id"]
STORY = ["doc_id", "part"]


def _markers(rows: DataFrame) -> DataFrame:
    """``doc_id, part, node_id, para_id, feature, id, step``: the ends of ranges and complex fields, and ``paired``: whether the story has one start and one end of the id (or as many begins as ends)."""
    n = nodes(rows)
    names = {f"{name}{end}": (feature, step) for name, feature in RANGES.items() for end, step in (("Start", 1), ("End", -1))}
    ranges = n.where(F.col("name").isin(*names) & attr("w:id").isNotNull()).select(*STORY, "node_id", "para_id", "in_del", named({k: v for k, (v, _) in names.items()}).alias("feature"), attr("w:id").alias("id"), F.when(F.col("name").endswith("Start"), 1).otherwise(-1).alias("step"))
    kind = attr("w:fldCharType")
    fields = n.where("name = 'w:fldChar'").where(kind.isin("begin", "end")).select(*STORY, "node_id", "para_id", "in_del", F.lit(FIELD).alias("feature"), F.lit("").alias("id"), F.when(kind == "begin", 1).otherwise(-1).alias("step"))
    of = Window.partitionBy(*STORY, "feature", "id")
    starts, ends = F.count_if(F.col("step") == 1).over(of), F.count_if(F.col("step") == -1).over(of)
    both = ranges.unionByName(fields).withColumn("paired", F.when(F.col("feature") == FIELD, starts == ends).otherwise((starts == 1) & (ends == 1)))
    return both.where(~F.col("in_del") & (F.col("paired") | F.col("para_id").isNotNull())).drop("in_del")


def _covered(rows: DataFrame) -> DataFrame:
    """``doc_id, part, at, o, feature, step``: where texts begin and cease to be inside of a range.

    Paired ends count in the whole story, others in their paragraph alone.  An end without an
    open start covers its paragraph up to it, a start without an end the rest of its own.
    """
    m = _markers(rows).withColumn("scope", F.when(F.col("paired"), -1).otherwise(F.col("para_id")))
    w = Window.partitionBy(*STORY, "feature", "id", "scope").orderBy("node_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("sum", F.sum("step").over(upto)).withColumn("low", F.least(F.lit(0), F.min("sum").over(upto)))
    m = m.withColumn("open", F.col("sum") - F.col("low")).withColumns({"was": F.coalesce(F.lag("open").over(w), F.lit(0)), "lowest": F.coalesce(F.lag("low").over(w), F.lit(0)), "last": F.lead("node_id").over(w).isNull()})
    para = nodes(rows).where("name = 'w:p'").select(*STORY, F.col("node_id").alias("para_id"), F.col("end_id").alias("para_end"))
    m = m.join(para, PARA, "left")
    event = lambda c, at, o, step: m.where(c).select(*STORY, F.col(at).alias("at"), F.lit(o).alias("o"), "feature", F.lit(step).alias("step"))
    under = (F.col("low") < F.col("lowest")) & F.col("para_id").isNotNull()
    return (
        event((F.col("open") == 1) & (F.col("was") == 0), "node_id", 1, 1).unionByName(event((F.col("open") == 0) & (F.col("was") == 1), "node_id", 1, -1))
        .unionByName(event(under, "para_id", 1, 1)).unionByName(event(under, "node_id", 1, -1)).unionByName(event(F.col("last") & (F.col("open") > 0) & ~F.col("paired"), "para_end", 2, -1))
    )


def text_nodes(rows: DataFrame) -> DataFrame:
    """The visible characters of paragraphs: ``doc_id, part, para_id, node_id, name, text, start, stop, direct, feature``, a row for each text, tab, break and (without length) equation.

    ``direct`` are those in a run right in the paragraph; ``feature`` is what protects them: the
    innermost element around them that an edit must not cross, else a range that is open there.
    """
    n = nodes(rows).where("para_id is not null")
    texts = n.where(~F.col("in_del")).where(F.col("name").isin("w:t", "w:tab", "w:br", "m:oMath"))
    shown = F.when(F.col("name") == "w:t", F.col("text")).when(F.col("name") == "w:tab", "\t").when(F.col("name") == "w:br", "\n")
    none = lambda kind: F.lit(None).cast(kind)
    texts = texts.select(*STORY, F.col("node_id").alias("at"), F.lit(0).alias("o"), none("string").alias("feature"), F.lit(0).alias("step"), "para_id", "name", "depth", "up", shown.alias("text"))

    # Ranges, over the story.
    events = _covered(rows).select(*STORY, "at", "o", "feature", "step", none("int").alias("para_id"), none("string").alias("name"), none("int").alias("depth"), none("string").alias("up"), none("string").alias("text"))
    upto = Window.partitionBy(*STORY).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    ranges = list(dict.fromkeys([*RANGES.values(), FIELD]))
    open_ = F.coalesce(*[F.when(F.sum(F.when(F.col("feature") == f, F.col("step")).otherwise(0)).over(upto) > 0, f) for f in ranges])
    texts = texts.unionByName(events).withColumn("range", open_).where("name is not null").drop("feature")

    # Elements around, over the paragraph.
    boxes = n.where(F.col("name").isin(*CONTAINERS)).select(*PARA, "node_id", "end_id", named(CONTAINERS).alias("feature"))
    blank = [none(k).alias(c) for c, k in (("range", "string"), ("name", "string"), ("depth", "int"), ("up", "string"), ("text", "string"))]
    begin = boxes.select(*PARA, F.col("node_id").alias("at"), F.lit(1).alias("o"), F.lit(1).alias("step"), "feature", *blank)
    end = boxes.select(*PARA, F.col("end_id").alias("at"), F.lit(2).alias("o"), F.lit(-1).alias("step"), none("string").alias("feature"), *blank)
    para = n.where("name = 'w:p'").select(*PARA, F.col("node_id").alias("at"), F.lit(0).alias("o"), F.lit(0).alias("step"), none("string").alias("feature"), *blank[:2], "depth", *blank[3:])
    every = texts.withColumn("feature", none("string")).unionByName(begin).unionByName(end).unionByName(para)
    order = ["at", "o"]
    upto = Window.partitionBy(*PARA).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("level", F.sum("step").over(upto)).withColumn("para_depth", F.max(F.when(F.col("name").isNull(), F.col("depth"))).over(Window.partitionBy(*PARA)))
    inside = F.last("feature", ignorenulls=True).over(Window.partitionBy(*PARA, "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    every = every.withColumn("box", F.when(F.col("level") > 0, inside)).where("name is not null")
    direct = (F.col("up") == "w:r") & (F.col("depth") == F.col("para_depth") + 2)
    placed = offsets(every.withColumn("node_id", F.col("at")), PARA, ["node_id"])
    return placed.select(*PARA, "node_id", "name", F.coalesce("text", F.lit("")).alias("text"), "start", "stop", direct.alias("direct"), F.coalesce("box", "range").alias("feature"))


def texts_of_paragraphs(pieces: DataFrame) -> DataFrame:
    """``doc_id, part, para_id, text`` of the pieces of ``text_nodes``."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "")
    return pieces.groupBy(*PARA).agg(joined.alias("text"))


def plan_replacement(rows: DataFrame, find: str, to: str, occurrence: int | str | None = None, wires: list[str] | None = None) -> DataFrame:
    """What replacing ``find`` would do to each main-story paragraph that holds it (or those of ``wires``): a row for each text node with its new text, or one row that says why not.

    ``matches`` counts the occurrences; ``occurrence`` names one, or ``"all"``.  ``code``: E4203
    for none, E1202 for several of which none is named, I0001 where nothing would change, E4305
    where a match crosses what is protected (named by ``feature``) or an equation, E4306 where it
    holds a tab, a break or text outside of the paragraph's own runs, or ``to`` a tab or line
    break; else ``ok``.  A match across runs puts ``to`` in the first and leaves their formats.
    """
    pieces = text_nodes(rows)
    target = blocks(rows).where("story = 'M' and kind = 'paragraph'").select("doc_id", "wire", "part", F.col("node_id").alias("para_id"))
    target = target.where(F.col("wire").isin(*wires)) if wires else target
    pieces = written(pieces.join(target.select(*PARA), PARA, "left_semi"), "pieces")  # read for texts, matches and edits
    found = matches(texts_of_paragraphs(pieces), PARA, find)
    count = found.groupBy(*PARA).agg(F.count("*").alias("matches"))
    chosen = found if occurrence == "all" else found.where(F.col("nth") == (occurrence or 1))
    cut = written(crossings(pieces, chosen, PARA, ["node_id", "name", "text", "direct", "feature"], F.col("name") == "m:oMath"), "crossings")
    first = lambda c: F.min_by("feature", F.when(c, F.struct("nth", "node_id")))
    plain = (F.col("name") == "w:t") & F.col("direct")
    crossed = F.col("feature").isNotNull() & ~F.col("inside")
    facts = cut.groupBy(*PARA).agg(first(crossed).alias("feature"), F.bool_or("inside").alias("equation"), F.bool_or(~F.col("inside") & ~plain).alias("mixed"))
    both = target.join(count, PARA, "left").join(facts, PARA, "left")
    n, whole = F.coalesce("matches", F.lit(0).cast("long")), occurrence == "all"
    code = F.when(n < (1 if whole else occurrence or 1), "E4203").when((n > 1) & F.lit(occurrence is None), "E1202").when(F.lit(find == to), "I0001")
    code = code.when(F.col("feature").isNotNull() | F.col("equation"), "E4305").when(F.col("mixed") | F.lit("\t" in to or "\n" in to), "E4306").otherwise("ok")
    feature = F.when(F.col("code") == "E4305", F.coalesce("feature", F.lit("equation")))
    said = both.withColumn("n", n).withColumn("code", code).where(F.lit(bool(wires)) | (F.col("n") > 0)).select(*PARA, "wire", F.col("n").alias("matches"), "code", feature.alias("feature"))

    # The first piece of a match takes the new text, the others lose theirs.
    lead = F.row_number().over(Window.partitionBy(*PARA, "nth").orderBy("node_id", "a"))
    edits = cut.where(~F.col("inside")).withColumn("to", F.when(lead == 1, F.lit(to)).otherwise(""))
    edits = edits.groupBy(*PARA, "node_id").agg(F.first("text").alias("old"), F.array_sort(F.collect_list(F.struct("a", "b", "to"))).alias("cuts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    part = lambda old, a, b: F.substring(old, (a + 1).cast("int"), (b - a).cast("int"))
    fold = F.aggregate("cuts", start, lambda s, c: F.struct(c["b"].alias("at"), F.concat(s["out"], part(F.col("old"), s["at"], c["a"]), c["to"]).alias("out")))
    new = edits.withColumn("done", fold).select(*PARA, "node_id", F.concat("done.out", part(F.col("old"), F.col("done.at"), F.length("old").cast("long"))).alias("text"))
    ok = said.where("code = 'ok'").select(*PARA).join(new, PARA)
    return said.join(ok, PARA, "left").select("doc_id", "wire", "part", "para_id", "matches", "code", "feature", "node_id", "text")


def _places(rows: DataFrame, pieces: DataFrame, markers: DataFrame) -> DataFrame:
    """``markers`` (``doc_id, part, node_id``) with ``k`` (the paragraphs begun so far in the story), ``at`` (the characters of that paragraph before the marker) and ``ended`` (whether it has ended)."""
    n = nodes(rows).where("name = 'w:p'").select(*STORY, "node_id", F.lit("p").alias("what"), "end_id", F.lit(0).cast("long").alias("size"))
    texts = pieces.select(*STORY, "node_id", F.lit("t").alias("what"), F.lit(None).cast("int").alias("end_id"), F.length("text").cast("long").alias("size"))
    here = markers.select(*STORY, "node_id", F.lit("m").alias("what"), F.lit(None).cast("int").alias("end_id"), F.lit(0).cast("long").alias("size")).distinct()
    w = Window.partitionBy(*STORY).orderBy("node_id", "what").rowsBetween(Window.unboundedPreceding, 0)
    every = n.unionByName(texts).unionByName(here)
    every = every.withColumns({"k": F.count_if(F.col("what") == "p").over(w), "upto": F.sum("size").over(w)})
    begun = F.last(F.when(F.col("what") == "p", F.struct("upto", "end_id")), ignorenulls=True).over(w)
    return every.withColumn("begun", begun).where("what = 'm'").select(*STORY, "node_id", "k", (F.col("upto") - F.coalesce("begun.upto", F.lit(0))).alias("at"), F.coalesce(F.col("begun.end_id") < F.col("node_id"), F.lit(True)).alias("ended"))


def bookmark_texts(rows: DataFrame) -> DataFrame:
    """``doc_id, part, bookmark, start_node, shape, text`` of each named bookmark with an end of its id: the visible text between, paragraphs on lines of their own.

    ``shape`` is ``same-paragraph`` (both ends right in one paragraph), ``paragraphs`` (in several,
    or beside them), ``cells`` (in different table cells, or in one and out of it), or
    ``reversed`` (the end comes first; no text).  A bookmark is cut out of the paragraphs from that
    of its start to that of its end, by their number, so a range meets only what it covers.
    """
    n = nodes(rows)
    start = n.where("name = 'w:bookmarkStart'").where(F.btrim(attr("w:name")) != "").select(*STORY, "node_id", attr("w:id").alias("id"), attr("w:name").alias("bookmark"), F.col("cell_id").alias("cell_a"), F.when(F.col("up") == "w:p", F.col("parent_id")).alias("in_a"))
    end = n.where("name = 'w:bookmarkEnd'").groupBy(*STORY, attr("w:id").alias("id")).agg(F.min_by(F.struct("node_id", "cell_id", F.when(F.col("up") == "w:p", F.col("parent_id")).alias("inside")), "node_id").alias("e"))
    pair = start.join(end, [*STORY, "id"]).select(*STORY, "bookmark", F.col("node_id").alias("s"), F.col("e.node_id").alias("e"), "cell_a", F.col("e.cell_id").alias("cell_b"), "in_a", F.col("e.inside").alias("in_b"))
    pieces = written(text_nodes(rows), "pieces")
    ends = _places(rows, pieces, pair.select(*STORY, F.explode(F.array("s", "e")).alias("node_id")))
    at = lambda side: ends.select(*STORY, F.col("node_id").alias(side), F.struct("k", "at", "ended").alias(f"{side}_at"))
    pair = pair.join(at("s"), [*STORY, "s"]).join(at("e"), [*STORY, "e"])
    shape = F.when(F.col("e") < F.col("s"), "reversed").when(F.col("in_a") == F.col("in_b"), "same-paragraph").when(~F.col("cell_a").eqNullSafe(F.col("cell_b")), "cells").otherwise("paragraphs")
    pair = pair.select(*STORY, "bookmark", F.col("s").alias("start_node"), shape.alias("shape"), (F.col("s_at.k") + F.col("s_at.ended").cast("int")).alias("first"), F.when(F.col("s_at.ended"), 0).otherwise(F.col("s_at.at")).alias("a"), F.col("e_at.k").alias("last"), F.when(~F.col("e_at.ended"), F.col("e_at.at")).alias("b"))
    k = F.count("*").over(Window.partitionBy(*STORY).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0))
    paras = n.where("name = 'w:p'").select(*STORY, "node_id", F.col("node_id").alias("para_id")).withColumn("k", k).drop("node_id")
    text = paras.join(texts_of_paragraphs(pieces), PARA, "left").select(*STORY, "k", F.coalesce("text", F.lit("")).alias("text"))
    each = pair.where("shape <> 'reversed' and first <= last").withColumn("k", F.explode(F.sequence("first", "last"))).join(text, [*STORY, "k"])
    low, high = F.when(F.col("k") == F.col("first"), F.col("a")).otherwise(0), F.when(F.col("k") == F.col("last"), F.coalesce("b", F.length("text").cast("long"))).otherwise(F.length("text").cast("long"))
    cut = each.withColumn("cut", F.substring("text", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")))
    made = cut.groupBy(*STORY, "start_node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "cut"))), lambda x: x["cut"]), "\n").alias("text"))
    return pair.join(made, [*STORY, "start_node"], "left").select(*STORY, "bookmark", "start_node", "shape", F.coalesce("text", F.lit("")).alias("text"))

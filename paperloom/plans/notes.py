"""What packages say about their targets: ids, the target of any element, annotations, and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import contains_any_case, truncated, wire
from paperloom.operators.notes import SLICE, gathered, tagged
from paperloom.plans.model import comment_threads, complex_fields, controls, equations, headings, sections, simple_fields
from paperloom.plans.packages import attr, blocks, bookmarks, cells, changes, comments, hyperlinks, images, nodes, parts, rels, stories, tables, targets
from paperloom.sources.tables import written

KEY = ["doc_id", "part", "node_id"]
#: The kinds of annotations, as columns.
KINDS = ["bookmarks", "control_ids", "control_tags", "control_aliases", "field_ids", "field_codes", "field_kinds", "field_types", "link_ids", "link_targets", "comment_ids", "comment_bodies", "comment_paras", "comment_parents", "comment_roots", "comment_durables", "comment_replies", "comment_resolved"]


def with_target(rows: DataFrame, elements: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``elements`` (``doc_id, part, node_id``) with ``target``: the wire id of the nearest target around each, else of the first one inside of it; null for neither.

    The first target inside is the next one in document order, if the element ends after it.
    ``known`` are the targets, where they are at hand.
    """
    n = nodes(rows).select(*KEY, "end_id", "block_id", "top_row", "top_cell", "comment_id")
    t = (targets(rows) if known is None else known).select(*KEY, "wire")
    placed = elements.select(*KEY).distinct().join(n, KEY).withColumn("owner", F.coalesce("top_cell", "top_row", "block_id", "comment_id"))
    around = placed.join(t.select("doc_id", "part", F.col("node_id").alias("owner"), F.col("wire").alias("around")), ["doc_id", "part", "owner"], "left")
    own = around.join(t.withColumnRenamed("wire", "self"), KEY, "left").select(*KEY, "end_id", F.coalesce("self", "around").alias("wire"), F.lit(0).alias("o"))
    ahead = t.select(*KEY, F.lit(None).cast("int").alias("end_id"), "wire", F.lit(1).alias("o"))
    w = Window.partitionBy("doc_id", "part").orderBy("node_id", F.desc("o")).rowsBetween(1, Window.unboundedFollowing)
    after = F.first(F.when(F.col("o") == 1, F.struct("node_id", "wire")), ignorenulls=True).over(w)
    found = own.unionByName(ahead).withColumn("after", after).where("o = 0")
    inside = F.when(F.col("after.node_id") <= F.col("end_id"), F.col("after.wire"))
    return elements.join(found.select(*KEY, F.coalesce("wire", inside).alias("target")), KEY, "left")


def with_id(rows: DataFrame, elements: DataFrame, letters: str) -> DataFrame:
    """``elements`` of stories with ``id``: the story, ``letters`` and their number in document order."""
    n = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("node_id")).cast("long")
    return elements.join(stories(rows), ["doc_id", "part"]).withColumn("id", F.concat("story", wire(f".{letters}", n)))


def fields(rows: DataFrame) -> DataFrame:
    """Simple and complex fields in one relation: ``kind``, code and what it says, by their place."""
    columns = ["doc_id", "part", "node_id", "code", "field", "dirty", "arguments", "switches", "bookmarks", "links", "refresh", "deterministic"]
    return simple_fields(rows).select(*columns, F.lit("simple").alias("kind")).unionByName(complex_fields(rows).select(*columns, F.lit("complex").alias("kind")))


def comment_places(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, part, node_id, comment_id, target``: every place where a comment is told of: its markers and body, where it is anchored and cited, and of an answer the places of the comment that it answers."""
    c = (changes(rows) if known is None else known).where(F.btrim("comment_id") != "").select(*KEY, "comment_id", "kind", "target", "anchor")
    body = c.where("kind = 'comment'").groupBy("doc_id", "comment_id").agg(F.min_by("target", "node_id").alias("body"), F.min("anchor").alias("anchored"))
    cited = c.where("kind = 'comment-reference'").groupBy("doc_id", "comment_id").agg(F.min_by("target", F.struct("part", "node_id")).alias("cited"))
    of = body.join(cited, ["doc_id", "comment_id"], "left")
    para = comments(rows).where(F.btrim("para") != "").groupBy("doc_id", "para").agg(F.min("comment_id").alias("up_id"))
    n = nodes(rows).where("name = 'w15:commentEx'").where(F.btrim(attr("w15:paraIdParent")) != "").select("doc_id", attr("w15:paraId").alias("child"), attr("w15:paraIdParent").alias("para"))
    child = comments(rows).select("doc_id", "comment_id", F.col("para").alias("child"))
    answers = n.join(para, ["doc_id", "para"]).join(child, ["doc_id", "child"]).select("doc_id", "comment_id", "up_id").distinct()
    above = answers.join(of.select("doc_id", F.col("comment_id").alias("up_id"), F.array("body", "anchored", "cited").alias("above")), ["doc_id", "up_id"]).select("doc_id", "comment_id", "above")
    both = c.join(of, ["doc_id", "comment_id"], "left").join(above, ["doc_id", "comment_id"], "left")
    every = F.concat(F.array("target", "anchored", "cited"), F.coalesce("above", F.array().cast("array<string>")))
    return both.select(*KEY, "comment_id", F.explode(F.array_distinct(every)).alias("target")).where("target is not null")


def target_annotations(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """``doc_id, target, slice`` and an array for each of ``KINDS``: all that is said about each target, by one grouping of one union."""
    n = nodes(rows)
    named = n.where("name = 'w:bookmarkStart'").where(F.btrim(attr("w:name")) != "").select(*KEY, attr("w:id").alias("key"), attr("w:name").alias("bookmark"))
    end = n.where("name = 'w:bookmarkEnd'").groupBy("doc_id", "part", attr("w:id").alias("key")).agg(F.min("node_id").alias("node_id"))
    marks = named.select(*KEY, "bookmark").unionByName(named.drop("node_id").join(end, ["doc_id", "part", "key"]).select(*KEY, "bookmark"))
    marks = marks.join(stories(rows), ["doc_id", "part"], "left_semi")
    control = with_id(rows, controls(rows).withColumnRenamed("id", "own"), "CC")
    field, link = with_id(rows, fields(rows), "F"), with_id(rows, hyperlinks(rows), "L")
    change = written(changes(rows), "changes")
    told, thread = comment_places(rows, change), comment_threads(rows)
    para = comments(rows).groupBy("doc_id", "comment_id").agg(F.min("para").alias("para"))
    body = change.where("kind = 'comment'").groupBy("doc_id", "comment_id").agg(F.min_by("target", "node_id").alias("body"))
    up = n.where("name = 'w15:commentEx'").groupBy("doc_id", attr("w15:paraId").alias("para")).agg(F.min(attr("w15:paraIdParent")).alias("parent"))
    facts = thread.select("doc_id", "comment_id", F.regexp_replace("thread", r"^[^|]*\|", "").alias("root"), "is_reply", "done", "durable_id").dropDuplicates(["doc_id", "comment_id"])
    about = told.join(facts, ["doc_id", "comment_id"], "left").join(para, ["doc_id", "comment_id"], "left").join(up, ["doc_id", "para"], "left").join(body, ["doc_id", "comment_id"], "left")
    key = ["doc_id"]
    known = written(targets(rows), "targets")
    at = lambda df: with_target(rows, df, known)
    if_ = lambda c: F.when(F.col(c), F.col("comment_id"))
    parts = [
        tagged(at(marks), "target", "node_id", key, bookmarks="bookmark"),
        tagged(at(control), "target", "node_id", key, control_ids="id", control_tags="tag", control_aliases="alias"),
        tagged(at(field), "target", "node_id", key, field_ids="id", field_codes="code", field_kinds="kind", field_types="field"),
        tagged(at(link), "target", "node_id", key, link_ids="id", link_targets=F.coalesce("uri", "anchor")),
        tagged(about, "target", "node_id", key, comment_ids="comment_id", comment_bodies="body", comment_paras="para", comment_parents="parent", comment_roots="root", comment_durables="durable_id", comment_replies=if_("is_reply"), comment_resolved=if_("done")),
    ]
    return gathered(parts, key, KINDS, size)


def find(rows: DataFrame, text: str, most: int = 4000, view: str = "final") -> DataFrame:
    """``doc_id, kind, wire, parent, place, text`` of paragraphs, then of cells by table, that hold ``text`` in any case; texts in at most ``most`` characters."""
    holds: Column = contains_any_case(F.col("text"), text)
    p = blocks(rows, view).where("kind = 'paragraph'").where(holds).select("doc_id", F.lit("paragraph").alias("kind"), "story", "wire", F.lit(None).cast("string").alias("parent"), "node_id", "text")
    c = cells(rows).where(holds).join(stories(rows), ["doc_id", "part"]).select("doc_id", F.lit("cell").alias("kind"), "story", "wire", F.col("table").alias("parent"), F.col("top_cell").alias("node_id"), "text")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("kind"), F.when(F.col("story") == "M", 0).when(F.col("story").startswith("H"), 1).otherwise(2), "story", "node_id"))
    return p.unionByName(c).withColumn("place", place.cast("long")).select("doc_id", "kind", "wire", "parent", "place", truncated(F.col("text"), most).alias("text"))


def context_of_cells(rows: DataFrame, wires: list[str], radius: int = 1) -> DataFrame:
    """The cells of ``wires`` and those of their rows up to ``radius`` physical places before and after: ``doc_id, of, offset, wire, text``."""
    c = cells(rows).select("doc_id", "part", "table", "row", "physical", "wire", "text")
    asked = c.where(F.col("wire").isin(*wires)).select("doc_id", "part", "table", "row", F.col("wire").alias("of"), F.col("physical").alias("at"), F.explode(F.sequence(F.col("physical") - radius, F.col("physical") + radius)).alias("physical"))
    return c.join(asked, ["doc_id", "part", "table", "row", "physical"]).select("doc_id", "of", (F.col("physical") - F.col("at")).cast("long").alias("offset"), "wire", "text")


def merge_groups(rows: DataFrame) -> DataFrame:
    """``doc_id, root, cell, place``: the cells of each vertical merge from the one that begins it, from 0."""
    c = cells(rows).where("v_root is not null").select("doc_id", "v_root", "wire", "row")
    place = F.row_number().over(Window.partitionBy("doc_id", "v_root").orderBy("row")) - 1
    return c.select("doc_id", F.col("v_root").alias("root"), F.col("wire").alias("cell"), place.cast("long").alias("place"))


#: The kinds of an outline in their order.
OUTLINE = ["heading", "table", "section", "image", "bookmark", "content-control", "field", "hyperlink", "equation"]


def outline(rows: DataFrame, most: int = 200) -> DataFrame:
    """``doc_id, rank, kind, id, target, label, detail, status, repeats``: what a document holds, by kind in the order of ``OUTLINE`` and in document order within a kind.

    ``id`` is the wire id, ``target`` what the element belongs to, ``status`` whether it can be
    edited, made anew, or is whole, and ``repeats`` whether another of its kind has its name.
    """
    known = written(targets(rows), "targets")
    at = lambda df: with_target(rows, df, known)
    none = F.lit(None).cast("string")

    def part(df: DataFrame, kind: str, id_: str, label: Column, detail: Column = none, status: Column = none, repeats: Column | None = None) -> DataFrame:
        target = F.col("target") if "target" in df.columns else none
        said = [truncated(label.cast("string"), most).alias("label"), detail.cast("string").alias("detail"), status.cast("string").alias("status"), (F.lit(False) if repeats is None else repeats).alias("repeats")]
        return df.select("doc_id", F.lit(OUTLINE.index(kind)).alias("o"), F.lit(kind).alias("kind"), "story", F.col("node_id").alias("at"), F.col(id_).alias("id"), target.alias("target"), *said)

    s, n = stories(rows), nodes(rows)
    of = lambda df: df.join(s, ["doc_id", "part"])
    table = blocks(rows).where("kind = 'table'").join(tables(rows).withColumnRenamed("table", "wire"), ["doc_id", "wire"])
    section = known.join(s, ["doc_id", "part"]).where(F.col("wire").rlike(r"\.S[0-9]+$")).join(n.where("name = 'w:sectPr'").select(*KEY), KEY)
    layout = sections(rows).join(n.where("name = 'w:sectPr'").where("up is null or up <> 'w:sectPrChange'").select(*KEY, F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("node_id")).cast("long").alias("ord")), ["doc_id", "part", "ord"])
    section = section.join(layout.select(*KEY, "columns", "orientation"), KEY, "left")
    placed = n.where("name = 'a:blip' and not in_del").select(*KEY, F.col("para_id"), attr("r:embed").alias("embed"))
    image = images(rows).select("doc_id", "part", "ord", "media", "layout", "alt")
    # Images are numbered as their placements that lead to a part are.
    kept = placed.join(rels(rows).where("mode = 'Internal'").select("doc_id", F.col("source").alias("part"), F.col("rel_id").alias("embed"), F.col("target").alias("media")), ["doc_id", "part", "embed"]).join(parts(rows).select("doc_id", F.col("part").alias("media")), ["doc_id", "media"], "left_semi")
    kept = kept.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("node_id")).cast("long")).select(*KEY, "ord")
    image = with_id(rows, image.join(kept, ["doc_id", "part", "ord"]), "I")
    mark = n.where("name = 'w:bookmarkStart'").where(F.btrim(attr("w:name")) != "").select(*KEY, attr("w:name").alias("bookmark"))
    mark = mark.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("node_id")).cast("long")).join(bookmarks(rows).select("doc_id", "part", "ord", "complete"), ["doc_id", "part", "ord"])
    mark = with_id(rows, mark, "B").withColumn("twice", F.count("*").over(Window.partitionBy("doc_id", "part", "bookmark")) > 1)
    control, field, link = with_id(rows, controls(rows).withColumnRenamed("id", "own"), "CC"), with_id(rows, fields(rows), "F"), with_id(rows, hyperlinks(rows), "L")
    math = of(equations(rows)).withColumn("id", F.concat("story", wire(".E", F.col("ord"))))
    every = [
        part(headings(rows), "heading", "wire", F.col("text"), F.col("level")),
        part(table, "table", "wire", F.coalesce("caption", "description"), F.concat_ws("x", "rows", "columns"), F.when(F.col("has_merged"), "merged")),
        part(section, "section", "wire", none, F.concat_ws(" ", "columns", "orientation")),
        part(at(image), "image", "id", F.col("media"), F.col("layout"), F.col("alt")),
        part(at(mark), "bookmark", "id", F.col("bookmark"), none, F.when(F.col("complete"), "complete").otherwise("open"), F.col("twice")),
        part(at(control), "content-control", "id", F.coalesce("alias", "tag"), control["kind"], F.col("edit_status"), F.col("tag_repeats") | F.col("alias_repeats")),
        part(at(field), "field", "id", F.col("code"), F.col("field"), F.col("refresh")),
        part(at(link), "hyperlink", "id", F.coalesce("uri", "anchor"), none, F.when(F.col("broken"), "broken")),
        part(at(math), "equation", "id", F.col("preview"), F.when(F.col("display"), "display").otherwise("inline")),
    ]
    story = F.when(F.col("story") == "M", 0).when(F.col("story").startswith("H"), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("o", story, "story", "at"))
    return reduce(DataFrame.unionByName, every).withColumn("rank", rank.cast("long")).select("doc_id", "rank", "kind", "id", "target", "label", "detail", "status", "repeats")

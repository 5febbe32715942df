"""Relations of shredded packages, by DataFrame functions only; every key starts with ``doc_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import on_off, valid_uri, wire
from paperloom.sources.packages import AROUND

NODE = ["doc_id", "part", "node_id", "end_id", "parent_id", "up", "sibling", "depth", "block_id", "top_row", "top_cell", *AROUND, "name", "type", "attrs", "text", "in_ins", "in_del"]
#: Elements that are review changes, with the name of their kind.
CHANGES = {
    "w:ins": "inserted-run",
    "w:del": "deleted-run",
    "w:moveFrom": "move-from-run",
    "w:moveTo": "move-to-run",
    "w:moveFromRangeStart": "move-from-range-start",
    "w:moveFromRangeEnd": "move-from-range-end",
    "w:moveToRangeStart": "move-to-range-start",
    "w:moveToRangeEnd": "move-to-range-end",
    "w:rPrChange": "run-properties-change",
    "w:pPrChange": "paragraph-properties-change",
    "w:tblPrChange": "table-properties-change",
    "w:trPrChange": "row-properties-change",
    "w:tcPrChange": "cell-properties-change",
    "w:sectPrChange": "section-properties-change",
    "w:cellIns": "cell-inserted",
    "w:cellDel": "cell-deleted",
    "w:cellMerge": "cell-merge-change",
    "w:customXmlInsRangeStart": "custom-xml-insert-range-start",
    "w:customXmlInsRangeEnd": "custom-xml-insert-range-end",
    "w:customXmlDelRangeStart": "custom-xml-delete-range-start",
    "w:customXmlDelRangeEnd": "custom-xml-delete-range-end",
    "w:commentRangeStart": "comment-range-start",
    "w:commentRangeEnd": "comment-range-end",
    "w:commentReference": "comment-reference",
    "w:comment": "comment",
}
#: What the element around a change is called.
PARENTS = {"w:body": "body", "w:comments": "comments", "w:comment": "comment", "w:p": "paragraph", "w:pPr": "paragraph-properties", "w:r": "run", "w:rPr": "run-properties", "w:tbl": "table", "w:tblPr": "table-properties", "w:tr": "row", "w:trPr": "row-properties", "w:tc": "cell", "w:tcPr": "cell-properties", "w:sectPr": "section-properties"}


def parts(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'part'").select("doc_id", "part", "name", F.col("type").alias("content_type"), "bytes")


def rels(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'rel'").select("doc_id", F.col("part").alias("source"), F.col("name").alias("rel_id"), "type", "target", "mode")


def nodes(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'node'").select(*NODE)


def diagnostics(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'diag'").select("doc_id", F.col("name").alias("code"), F.col("text").alias("message"))


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def named(pairs: dict[str, str], key: str = "name") -> Column:
    """The value that ``pairs`` has for a column; null for none."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[F.col(key)]


def children(n: DataFrame, name: str, alias: str, key: str = "node_id", attribute: str = "w:val") -> DataFrame:
    """An attribute of the first child of that name, by its parent."""
    return n.where(F.col("name") == name).groupBy("doc_id", "part", F.col("parent_id").alias(key)).agg(F.min_by(attr(attribute), "node_id").alias(alias))


def stories(rows: DataFrame) -> DataFrame:
    """``doc_id, story, part``: the main document, then headers and footers in the order of relationship ids; a shared part counts once."""
    r = rels(rows)
    main = r.where("source = '/' and type = 'officeDocument'").groupBy("doc_id").agg(F.min_by("target", "rel_id").alias("part"))
    around = r.join(main.withColumnRenamed("part", "source"), ["doc_id", "source"], "left_semi").where(F.col("type").isin("header", "footer") & (F.col("mode") == "Internal"))
    around = around.join(parts(rows).select("doc_id", F.col("part").alias("target")), ["doc_id", "target"], "left_semi")
    first = around.groupBy("doc_id", "type", F.col("target").alias("part")).agg(F.min("rel_id").alias("rel_id"))
    n = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("rel_id"))
    numbered = first.select("doc_id", F.concat(F.upper(F.substring("type", 1, 1)), F.format_string("%03d", n)).alias("story"), "part")
    return main.select("doc_id", F.lit("M").alias("story"), "part").unionByName(numbered)


def visible_text(view: str) -> Column:
    """The characters of a text element in a view, null for other elements (also for texts of equations and drawings)."""
    plain = F.when(F.col("name").isin("w:t", "w:delText"), F.col("text")).when(F.col("name") == "w:tab", "\t").when(F.col("name") == "w:br", "\n")
    if view == "final":
        return F.when(~F.col("in_del"), plain)
    if view == "original":
        return F.when(~F.col("in_ins"), plain)
    return F.when(F.col("in_ins"), F.concat(F.lit("[+"), plain, F.lit("+]"))).when(F.col("in_del"), F.concat(F.lit("[-"), plain, F.lit("-]"))).otherwise(plain)


def texts_of(n: DataFrame, key: str, view: str = "final") -> DataFrame:
    """``doc_id, part, <key>, text``: the visible text inside each element that the column ``key`` names, in document order."""
    shown = n.withColumn("shown", visible_text(view)).where(F.col("shown").isNotNull() & F.col(key).isNotNull())
    pieces = F.array_sort(F.collect_list(F.struct("node_id", "shown")))
    return shown.groupBy("doc_id", "part", key).agg(pieces.alias("pieces")).select("doc_id", "part", key, F.array_join(F.transform("pieces", lambda p: p["shown"]), "").alias("text"))


def paragraph_texts(rows: DataFrame, view: str = "final") -> DataFrame:
    """``doc_id, part, para_id, text`` of paragraphs with text in document order."""
    return texts_of(nodes(rows), "para_id", view)


def blocks(rows: DataFrame, view: str = "final") -> DataFrame:
    """A story's paragraphs and tables with ordinals given before the view filters: ``doc_id, story, kind, ord, wire, text, wrapper``."""
    tops = nodes(rows).where("node_id = block_id and name in ('w:p', 'w:tbl')").join(stories(rows), ["doc_id", "part"])
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "story", "name").orderBy("node_id")).cast("long")
    numbered = tops.withColumn("ord", ord_).withColumn("kind", F.when(F.col("name") == "w:p", "paragraph").otherwise("table")).withColumnRenamed("up", "wrapper")
    hidden = {"final": ["w:del", "w:moveFrom"], "original": ["w:ins", "w:moveTo"], "markup": []}[view]
    out = numbered.where(~F.col("wrapper").isin(*hidden) if hidden else F.lit(True)).drop("text", "para_id").withColumn("para_id", F.col("node_id"))
    full = F.concat(F.col("story"), F.when(F.col("kind") == "paragraph", ".P").otherwise(".T"), wire("", F.col("ord")))
    return out.join(paragraph_texts(rows, view), ["doc_id", "part", "para_id"], "left").select("doc_id", "story", "kind", "ord", full.alias("wire"), F.coalesce("text", F.lit("")).alias("text"), "wrapper", "part", "node_id", "end_id")


def runs(rows: DataFrame, view: str = "final") -> DataFrame:
    """Runs of every paragraph in order with their markup: ``kind`` (a revision, ``hyperlink`` or a comment's marker), revision, author, time, link and comment.

    A run stands right in its paragraph, or in a revision or link that does.  One without text
    in the view is left out unless it has markup.
    """
    n = nodes(rows)
    box = n.where(F.col("up") == "w:p").where(F.col("name").isin("w:ins", "w:del", "w:moveFrom", "w:moveTo", "w:hyperlink"))
    link = F.col("name") == "w:hyperlink"
    revision = lambda c: F.when(~link, c)
    box = box.select("doc_id", "part", F.col("node_id").alias("parent_id"), F.when(link, "hyperlink").otherwise(named(CHANGES)).alias("kind"), revision(attr("w:id")).alias("revision"), revision(attr("w:author")).alias("author"), revision(F.try_to_timestamp(attr("w:date"))).alias("ts"), F.when(link, attr("r:id")).alias("rel_id"), F.when(link, attr("w:anchor")).alias("anchor"))
    r = n.where("name = 'w:r'").select("doc_id", "part", "node_id", "parent_id", "para_id", "up").join(box, ["doc_id", "part", "parent_id"], "left").where("up = 'w:p' or kind is not null")
    cited = n.where("name = 'w:commentReference' and run_id is not null").groupBy("doc_id", "part", F.col("run_id").alias("node_id")).agg(F.min_by(attr("w:id"), "node_id").alias("cited"))
    text = texts_of(n, "run_id", view).withColumnRenamed("run_id", "node_id")
    both = r.join(cited, ["doc_id", "part", "node_id"], "left").join(text, ["doc_id", "part", "node_id"], "left")
    own = lambda c: F.when(F.col("cited").isNull(), F.col(c)).alias(c)
    both = both.select("doc_id", "part", "para_id", "node_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("cited").isNotNull(), "comment-reference").otherwise(F.col("kind")).alias("kind"), *[own(c) for c in ("revision", "author", "ts", "rel_id", "anchor")], F.col("cited").alias("comment_id"))
    both = both.where("text <> '' or kind is not null")
    marks = n.where(F.col("up") == "w:p").where(F.col("name").isin("w:commentRangeStart", "w:commentRangeEnd"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("revision", "string"), ("author", "string"), ("ts", "timestamp"), ("rel_id", "string"), ("anchor", "string"))]
    marks = marks.select("doc_id", "part", "para_id", "node_id", F.lit("").alias("text"), named(CHANGES).alias("kind"), *none, attr("w:id").alias("comment_id"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "part", "para_id").orderBy("node_id")).cast("long")
    return both.unionByName(marks).withColumn("ord", ord_)


def _counts(value: Column, least: int) -> Column:
    """A whole number of at least ``least``, or null."""
    number = value.try_cast("int")
    return F.when(number >= least, number)


def table_rows(rows: DataFrame) -> DataFrame:
    """Rows of a story's tables: ``table`` (its wire id), ``row``, grid columns before and after, flags."""
    n = nodes(rows)
    tables = blocks(rows, "markup").where("kind = 'table'").select("doc_id", "part", F.col("node_id").alias("block_id"), F.col("wire").alias("table"))
    tr = n.where("name = 'w:tr' and node_id = top_row").select("doc_id", "part", "block_id", "top_row").join(tables, ["doc_id", "part", "block_id"])
    tr = tr.withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "part", "block_id").orderBy("top_row")).cast("long"))
    of = lambda name, value: F.max(F.when(F.col("name") == name, value))
    flag = lambda name: F.coalesce(of(name, on_off(attr("w:val"), True)), F.lit(False))
    props = n.where("up = 'w:trPr' and row_id = top_row").groupBy("doc_id", "part", "top_row").agg(
        of("w:gridBefore", _counts(attr("w:val"), 0)).alias("before"), of("w:gridAfter", _counts(attr("w:val"), 0)).alias("after"),
        flag("w:tblHeader").alias("is_header"), flag("w:cantSplit").alias("cant_split"), F.coalesce(of("w:ins", F.lit(True)), F.lit(False)).alias("inserted"), F.coalesce(of("w:del", F.lit(True)), F.lit(False)).alias("deleted"),
    )
    no = F.lit(False)
    return tr.join(props, ["doc_id", "part", "top_row"], "left").select("doc_id", "part", "block_id", "table", "row", "top_row", F.coalesce("before", F.lit(0)).alias("grid_before"), F.coalesce("after", F.lit(0)).alias("grid_after"), *[F.coalesce(c, no).alias(c) for c in ("is_header", "cant_split", "inserted", "deleted")])


def _merged(cells_: DataFrame, rows_: DataFrame) -> DataFrame:
    """``cell_id, root, root_span``: the cell that a vertically continued cell goes on with: the last restart in its grid column with nothing else in between."""
    w = Window.partitionBy("doc_id", "part", "block_id", "at").orderBy("row")
    columns = lambda a, n: F.explode(F.sequence(a, a + n - 1)).alias("at")
    events = cells_.select("doc_id", "part", "block_id", "row", columns(F.col("column"), F.col("span")), F.col("v_merge").alias("what"), F.col("top_cell").alias("root"), F.col("column").alias("root_column"), F.col("span").alias("root_span"))
    width = cells_.groupBy("doc_id", "part", "block_id", "row").agg(F.max(F.col("column") + F.col("span") - 1).alias("last"))
    empty = [F.lit("empty").alias("what"), F.lit(None).cast("int").alias("root"), F.lit(None).cast("long").alias("root_column"), F.lit(None).cast("int").alias("root_span")]
    gone = rows_.where("grid_before > 0").select("doc_id", "part", "block_id", "row", columns(F.lit(1).cast("long"), F.col("grid_before")), *empty)
    after = rows_.where("grid_after > 0").join(width, ["doc_id", "part", "block_id", "row"]).select("doc_id", "part", "block_id", "row", columns(F.col("last") + 1, F.col("grid_after")), *empty)
    every = events.unionByName(gone).unionByName(after)
    state = F.last(F.when(~F.coalesce(F.col("what") == "continue", F.lit(False)), F.struct("what", "root", "root_column", "root_span")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = every.withColumn("state", state).where("what = 'continue' and at = root_column and state.what = 'restart'")
    return found.select("doc_id", "part", F.col("root").alias("top_cell"), F.col("state.root").alias("root"), F.col("state.root_column").alias("root_column"), F.col("state.root_span").alias("root_span"))


def cells(rows: DataFrame) -> DataFrame:
    """Cells of a story's tables by row and visual column (one more than the grid columns before and the spans to the left).

    ``v_root`` is the cell in which a vertical merge began, of the cells that go on with it too;
    null for a continuation that nothing began.  Texts are those of everything in the cell.
    """
    n = nodes(rows)
    rows_ = table_rows(rows)
    tc = n.where("name = 'w:tc' and node_id = top_cell").select("doc_id", "part", "top_row", "top_cell")
    of = lambda name, value: F.max(F.when(F.col("name") == name, value))
    props = n.where("up = 'w:tcPr' and cell_id = top_cell").groupBy("doc_id", "part", "top_cell").agg(of("w:gridSpan", _counts(attr("w:val"), 1)).alias("span"), of("w:vMerge", F.coalesce(attr("w:val"), F.lit("continue"))).alias("v_merge"))
    nested = n.where("name = 'w:tbl' and up = 'w:tc' and top_cell is not null").groupBy("doc_id", "part", "top_cell").agg(F.lit(True).alias("has_table"))
    all_ = tc.join(rows_, ["doc_id", "part", "top_row"]).join(props, ["doc_id", "part", "top_cell"], "left").withColumn("span", F.coalesce("span", F.lit(1)))
    w = Window.partitionBy("doc_id", "part", "top_row").orderBy("top_cell")
    left = F.coalesce(F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_ = all_.withColumn("column", (1 + F.col("grid_before") + left).cast("long")).withColumn("physical", F.row_number().over(w).cast("long"))
    all_ = all_.withColumn("wire", F.format_string("%s.R%02d.C%02d", "table", "row", "column"))
    merged = _merged(all_, rows_).drop("root_column", "root_span").join(all_.select("doc_id", "part", F.col("top_cell").alias("root"), F.col("wire").alias("root_wire")), ["doc_id", "part", "root"]).drop("root")
    placed = all_.join(texts_of(n, "top_cell"), ["doc_id", "part", "top_cell"], "left").join(nested, ["doc_id", "part", "top_cell"], "left").join(merged, ["doc_id", "part", "top_cell"], "left")
    root = F.when(F.col("v_merge") == "restart", F.col("wire")).otherwise(F.col("root_wire"))
    return placed.select("doc_id", "part", "table", "row", "column", "wire", "physical", (F.col("column") + F.col("span") - 1).alias("column_end"), "span", "v_merge", root.alias("v_root"), F.coalesce("has_table", F.lit(False)).alias("has_table"), F.coalesce("text", F.lit("")).alias("text"), "top_cell", "block_id")


def tables(rows: DataFrame) -> DataFrame:
    """Tables with rows, columns (of rows or of the declared grid, the greater), style, caption, description and flags."""
    n = nodes(rows)
    grid = n.where("name = 'w:gridCol' and up = 'w:tblGrid' and table_id = block_id").groupBy("doc_id", "part", "block_id").agg(F.count("*").alias("grid"))
    of = lambda name: F.min_by(attr("w:val"), F.when(F.col("name") == name, F.col("node_id")))
    style = n.where("up = 'w:tblPr' and table_id = block_id").groupBy("doc_id", "part", "block_id").agg(of("w:tblStyle").alias("style_id"), of("w:tblCaption").alias("caption"), of("w:tblDescription").alias("description"))
    r = table_rows(rows).groupBy("doc_id", "part", "block_id", "table").agg(F.count("*").alias("rows"), F.bool_or("is_header").alias("has_header"), F.bool_or((F.col("grid_before") > 0) | (F.col("grid_after") > 0)).alias("offset"))
    c = cells(rows).join(table_rows(rows).select("doc_id", "part", "block_id", "row", "grid_after"), ["doc_id", "part", "block_id", "row"]).groupBy("doc_id", "part", "block_id").agg(F.max(F.col("column_end") + F.col("grid_after")).alias("columns"), F.bool_or((F.col("span") > 1) | F.col("v_merge").isNotNull()).alias("merged"), F.bool_or("has_table").alias("has_nested"))
    both = r.join(c, ["doc_id", "part", "block_id"], "left").join(grid, ["doc_id", "part", "block_id"], "left").join(style, ["doc_id", "part", "block_id"], "left")
    no = F.lit(False)
    return both.select("doc_id", "table", "rows", F.greatest(F.coalesce("columns", F.lit(0)), F.coalesce("grid", F.lit(0))).alias("columns"), "grid", "style_id", "caption", "description", "has_header", (F.coalesce("merged", no) | F.col("offset")).alias("has_merged"), F.coalesce("has_nested", no).alias("has_nested"))


def styles(rows: DataFrame) -> DataFrame:
    """``doc_id, style_id, kind, style_name, based_on, next, link, is_default`` of each style, and the numbering set on it."""
    n = nodes(rows)
    s = n.where("name = 'w:style'").select("doc_id", "part", "node_id", attr("w:styleId").alias("style_id"), attr("w:type").alias("kind"), on_off(attr("w:default"), False).alias("is_default"))
    for name, alias in (("w:name", "style_name"), ("w:basedOn", "based_on"), ("w:next", "next"), ("w:link", "link")):
        s = s.join(children(n.where("up = 'w:style'"), name, alias), ["doc_id", "part", "node_id"], "left")
    ppr = n.where("name = 'w:pPr' and up = 'w:style'").select("doc_id", "part", F.col("node_id").alias("ppr"), F.col("parent_id").alias("node_id"))
    numbered = ppr.join(numbering(n), ["doc_id", "part", "ppr"]).drop("ppr")
    return s.join(numbered, ["doc_id", "part", "node_id"], "left").select("doc_id", "style_id", "kind", "style_name", "based_on", "next", "link", "is_default", "num_id", "num_level")


def numbering(n: DataFrame) -> DataFrame:
    """``ppr, num_id, num_level``: the numbering that paragraph properties set."""
    num = n.where("name = 'w:numPr' and up = 'w:pPr'").select("doc_id", "part", F.col("node_id").alias("num"), F.col("parent_id").alias("ppr"))
    inner = n.where("up = 'w:numPr'")
    both = num.join(children(inner, "w:numId", "num_id", "num"), ["doc_id", "part", "num"], "left").join(children(inner, "w:ilvl", "num_level", "num"), ["doc_id", "part", "num"], "left")
    return both.select("doc_id", "part", "ppr", "num_id", F.col("num_level").try_cast("int").alias("num_level"))


def bookmarks(rows: DataFrame) -> DataFrame:
    """Named bookmarks in order, each with the first end of its id; ``complete`` where there is one."""
    n = nodes(rows)
    start = n.where("name = 'w:bookmarkStart'").where(F.btrim(attr("w:name")) != "").select("doc_id", "part", "node_id", "para_id", attr("w:id").alias("id"), attr("w:name").alias("bookmark"))
    end = n.where("name = 'w:bookmarkEnd'").groupBy("doc_id", "part", attr("w:id").alias("id")).agg(F.min("node_id").alias("end_node"), F.min_by("para_id", "node_id").alias("end_para"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("node_id")).cast("long")
    return start.withColumn("ord", ord_).join(end, ["doc_id", "part", "id"], "left").select("doc_id", "part", "ord", "bookmark", "para_id", "end_para", F.col("end_node").isNotNull().alias("complete"))


def hyperlinks(rows: DataFrame) -> DataFrame:
    """Links with their target, its scheme and whether it is valid (null for no external one); ``broken`` where the relationship is missing, ``anchors`` how many bookmarks an anchor names, ``internal`` where it leads to a part."""
    n = nodes(rows)
    filled = lambda c: F.when(F.btrim(c) != "", c)
    links = n.where("name = 'w:hyperlink'").select("doc_id", "part", "node_id", "para_id", filled(attr("r:id")).alias("rel_id"), filled(attr("w:anchor")).alias("anchor"))
    r = rels(rows).select("doc_id", F.col("source").alias("part"), "rel_id", F.col("target").alias("uri"), F.col("type").alias("rel_type"), "mode")
    names = bookmarks(rows).groupBy("doc_id", "part", F.col("bookmark").alias("anchor")).agg(F.count("*").alias("anchors"))
    both = links.join(r, ["doc_id", "part", "rel_id"], "left").join(names, ["doc_id", "part", "anchor"], "left")
    linked = F.coalesce(F.col("rel_type") == "hyperlink", F.lit(False))
    outside = linked & (F.col("mode") == "External")
    return both.select("doc_id", "part", "node_id", "para_id", "uri", "anchor", F.when(outside, F.lower(F.regexp_extract("uri", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))).alias("scheme"), F.when(outside, valid_uri(F.col("uri"))).alias("valid"), (F.col("rel_id").isNotNull() & F.col("mode").isNull()).alias("broken"), (linked & (F.col("mode") == "Internal")).alias("internal"), F.coalesce("anchors", F.lit(0)).alias("anchors"))


def crop_percent(value: Column) -> Column:
    """A crop as a percentage: written with a sign, or in thousandths."""
    signed = F.regexp_replace(value, "%$", "").try_cast("decimal(18,3)")
    return F.when(value.endswith("%"), signed).when(value.try_cast("int").isNotNull(), (value.try_cast("int") / 1000).cast("decimal(18,3)"))


def images(rows: DataFrame) -> DataFrame:
    """Each placement of a picture with its media part, size, texts, wrapping and crop; placements without an internal part that exists, and deleted ones, drop out."""
    n = nodes(rows)
    blip = n.where("name = 'a:blip' and not in_del").select("doc_id", "part", "node_id", "parent_id", "drawing_id", "para_id", attr("r:embed").alias("rel_id"))
    r = rels(rows).where("mode = 'Internal'").select("doc_id", F.col("source").alias("part"), "rel_id", F.col("target").alias("media"))
    m = parts(rows).select("doc_id", F.col("part").alias("media"), "content_type", F.length("bytes").alias("size"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("node_id")).cast("long")
    placed = blip.join(r, ["doc_id", "part", "rel_id"]).join(m, ["doc_id", "media"]).withColumn("ord", ord_)
    layout = lambda c: n.where(F.col("drawing_id").isNotNull()).where(c)
    first = lambda name, cols: layout(F.col("name") == name).groupBy("doc_id", "part", "drawing_id").agg(*[F.min_by(c, "node_id").alias(a) for a, c in cols.items()])
    long_ = lambda a: attr(a).try_cast("long")
    frame = layout((F.col("up") == "w:drawing") & F.col("name").isin("wp:inline", "wp:anchor")).groupBy("doc_id", "part", "drawing_id").agg(F.min_by(F.regexp_replace("name", "^wp:", ""), "node_id").alias("layout"), F.min_by(on_off(attr("behindDoc"), False), "node_id").alias("behind"))
    wrap = layout(F.col("up").isin("wp:inline", "wp:anchor") & F.col("name").rlike("^wp:wrap")).groupBy("doc_id", "part", "drawing_id").agg(F.min_by(F.regexp_replace("name", "^wp:", ""), "node_id").alias("wrap"))
    key = ["doc_id", "part", "drawing_id"]
    out = placed.join(frame, key, "left").join(wrap, key, "left").join(first("wp:extent", {"width": long_("cx"), "height": long_("cy")}), key, "left").join(first("wp:docPr", {"picture": attr("name"), "alt": attr("descr"), "title": attr("title")}), key, "left")
    crop = n.where("name = 'a:srcRect' and up = 'pic:blipFill'").groupBy("doc_id", "part", "parent_id").agg(*[F.min_by(crop_percent(attr(side)), "node_id").alias(f"crop_{side}") for side in "ltrb"])
    return out.join(crop, ["doc_id", "part", "parent_id"], "left").select("doc_id", "part", "ord", "media", "content_type", "size", "para_id", F.coalesce("layout", F.lit("unknown")).alias("layout"), "width", "height", "picture", "alt", "title", "wrap", F.coalesce("behind", F.lit(False)).alias("behind"), "crop_l", "crop_t", "crop_r", "crop_b")


def targets(rows: DataFrame) -> DataFrame:
    """``doc_id, part, node_id, wire`` of every element that a change can be said to belong to: paragraphs, tables, their rows and cells, sections, comments."""
    n = nodes(rows)
    b = blocks(rows, "markup").select("doc_id", "part", "node_id", "wire")
    r = table_rows(rows).select("doc_id", "part", F.col("top_row").alias("node_id"), F.format_string("%s.R%02d", "table", "row").alias("wire"))
    c = cells(rows).select("doc_id", "part", F.col("top_cell").alias("node_id"), "wire")
    s = n.where("name = 'w:sectPr' and (node_id = block_id or up = 'w:pPr' and para_id = block_id)").join(stories(rows), ["doc_id", "part"])
    s = s.select("doc_id", "part", "node_id", F.concat(F.col("story"), F.lit(".S"), wire("", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("node_id")).cast("long"))).alias("wire"))
    notes = n.where("name = 'w:comment' and up = 'w:comments'").select("doc_id", "part", "node_id", F.concat(F.lit("C001.C"), wire("", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("node_id")).cast("long"))).alias("wire"))
    return b.unionByName(r).unionByName(c).unionByName(s).unionByName(notes)


def changes(rows: DataFrame) -> DataFrame:
    """Review changes with kind, author, UTC time, revision or comment id, what they stand in, and their target.

    The target is, in this order: the nearest modelled element around the change (``ancestor``);
    for the boundary of a range outside of any, the block beside it (``adjacent-range``: the one
    that the range goes on into, else the other); the place of the comment that it belongs to
    (``comment-anchor``); else none, with the nearest block as ``nearest``.
    """
    n = nodes(rows)
    comment = F.col("name").isin("w:commentRangeStart", "w:commentRangeEnd", "w:commentReference", "w:comment")
    kind = F.when((F.col("name") == "w:ins") & (F.col("up") == "w:trPr"), "row-inserted").when((F.col("name") == "w:del") & (F.col("up") == "w:trPr"), "row-deleted").otherwise(named(CHANGES))
    section = n.where("name = 'w:sectPr' and up = 'w:pPr' and para_id = block_id").select("doc_id", "part", F.col("node_id").alias("s"), F.col("parent_id").alias("ppr"))
    c = n.where(F.col("name").isin(*CHANGES)).withColumn("kind", kind)
    c = c.join(section.select("doc_id", "part", F.col("s").alias("parent_id"), F.lit(True).alias("in_section")), ["doc_id", "part", "parent_id"], "left")
    owner = F.coalesce(F.when(F.col("in_section"), F.col("parent_id")), "top_cell", "top_row", "block_id", "comment_id")
    c = c.withColumn("owner", owner).withColumn("note", F.when(comment, attr("w:id")))
    t = targets(rows)
    c = c.join(t.select("doc_id", "part", F.col("node_id").alias("owner"), "wire"), ["doc_id", "part", "owner"], "left")

    # The blocks before and after what stands outside of any, among the elements of the same parent.
    lost = c.where("wire is null").select("doc_id", "part", "node_id", "parent_id", "sibling", F.lit(None).cast("string").alias("wire"))
    ends = n.select("doc_id", "part", F.col("node_id").alias("parent_id"), F.col("end_id").alias("parent_end"))
    tops = n.where("node_id = block_id").select("doc_id", "part", "node_id", "parent_id", "sibling").join(t.select("doc_id", "part", "node_id", "wire"), ["doc_id", "part", "node_id"])
    every = lost.withColumn("top", F.lit(False)).unionByName(tops.withColumn("top", F.lit(True)))
    w = Window.partitionBy("doc_id", "part").orderBy("node_id")
    block = F.when(F.col("top"), F.struct("node_id", "wire", "parent_id", "sibling"))
    near = every.withColumn("b", F.last(block, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("a", F.first(block, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).where("not top")
    near = near.join(ends, ["doc_id", "part", "parent_id"], "left")
    inside_b, inside_a = F.col("b.node_id") > F.col("parent_id"), F.col("a.node_id") <= F.col("parent_end")
    steps = lambda side: F.when(F.col(f"{side}.parent_id") == F.col("parent_id"), F.abs(F.col("sibling") - F.col(f"{side}.sibling"))).otherwise(1)
    near = near.select("doc_id", "part", "node_id", F.when(inside_b, F.col("b.wire")).alias("before"), F.when(inside_a, F.col("a.wire")).alias("after"), F.when(inside_b, steps("b")).alias("far_b"), F.when(inside_a, steps("a")).alias("far_a"))
    c = c.join(near, ["doc_id", "part", "node_id"], "left")
    edge = F.col("name").rlike("Range(Start|End)$")
    beside = F.when(edge, F.when(F.col("name").endswith("End"), F.coalesce("before", "after")).otherwise(F.coalesce("after", "before")))
    nearest = F.when(F.col("before").isNull() | (F.col("far_a") < F.col("far_b")), F.coalesce("after", "before")).otherwise(F.col("before"))
    anchors = c.where(F.col("name").isin("w:commentRangeStart", "w:commentReference") & F.col("wire").isNotNull()).groupBy("doc_id", "note").agg(F.min_by("wire", F.struct(F.col("name") != "w:commentRangeStart", "part", "node_id")).alias("anchor"))
    c = c.withColumn("beside", F.when(F.col("wire").isNull(), beside)).join(anchors, ["doc_id", "note"], "left")
    source = F.when(F.col("wire").isNotNull(), "ancestor").when(F.col("beside").isNotNull(), "adjacent-range").when(F.col("anchor").isNotNull(), "comment-anchor").otherwise("none")
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("node_id")).cast("long")
    plain = lambda x: F.when(~comment, x)
    return c.withColumn("ord", ord_).select("doc_id", "part", "node_id", "para_id", "kind", F.coalesce(named(PARENTS, "up"), F.regexp_replace("up", "^[a-z0-9]+:", "")).alias("parent"), plain(attr("w:id")).alias("revision"), plain(attr("w:author")).alias("author"), plain(F.try_to_timestamp(attr("w:date"))).alias("ts"), F.col("note").alias("comment_id"), "ord", F.coalesce("wire", "beside").alias("target"), source.alias("target_source"), F.when(source == "none", nearest).alias("nearest"), F.when(comment, F.col("anchor")).alias("anchor"))


def comments(rows: DataFrame) -> DataFrame:
    """Comments with author, initials, time, the id of their last paragraph, and their text."""
    n = nodes(rows)
    c = n.where("name = 'w:comment'").select("doc_id", "part", "node_id", attr("w:id").alias("comment_id"), attr("w:author").alias("author"), attr("w:initials").alias("initials"), F.try_to_timestamp(attr("w:date")).alias("ts"))
    shown = n.where("name in ('w:t', 'w:delText') and comment_id is not null").groupBy("doc_id", "part", F.col("comment_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("k"), "text"))).alias("ts_"))
    last = n.where("name = 'w:p' and comment_id is not null").groupBy("doc_id", "part", F.col("comment_id").alias("node_id")).agg(F.max_by(F.struct(attr("w14:paraId").alias("para")), "node_id").alias("last"))
    key = ["doc_id", "part", "node_id"]
    both = c.join(shown, key, "left").join(last, key, "left")
    return both.select("doc_id", "part", "comment_id", "author", "initials", "ts", F.col("last.para").alias("para"), F.coalesce(F.array_join(F.transform("ts_", lambda x: x["text"]), ""), F.lit("")).alias("text"))

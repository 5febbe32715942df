"""Rules that packages must keep: each gives ``doc_id, code, part, target`` of what violates it, and ``validate`` all together.

Codes are fixed values.  Errors begin with E, warnings with W; E00xx come from opening a package.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.plans.packages import _merged, attr, bookmarks, cells, comments, crop_percent, diagnostics, hyperlinks, nodes, parts, rels, styles, table_rows

#: On and off in attributes; locks of content controls; page orientations.
ON_OFF = ["0", "1", "true", "false", "on", "off"]
LOCKS = ["unlocked", "sdtLocked", "contentLocked", "sdtContentLocked"]
ORIENTATIONS = ["portrait", "landscape"]
#: The root of the part that a relationship of the main document leads to.
ROOTS = {"header": "w:hdr", "footer": "w:ftr", "styles": "w:styles", "numbering": "w:numbering", "settings": "w:settings", "comments": "w:comments", "commentsExtended": "w15:commentsEx", "commentsIds": "w16cid:commentsIds", "footnotes": "w:footnotes", "endnotes": "w:endnotes"}
#: What a property revision must hold.
REVISED = {"w:pPrChange": "w:pPr", "w:tblPrChange": "w:tblPr", "w:trPrChange": "w:trPr", "w:tcPrChange": "w:tcPr", "w:sectPrChange": "w:sectPr"}


def _blank(c: Column) -> Column:
    return F.coalesce(F.btrim(c), F.lit("")) == ""


def _found(df: DataFrame, code: str, target: Column | str, part: Column | str = "part") -> DataFrame:
    return df.select("doc_id", F.lit(code).alias("code"), (F.col(part) if isinstance(part, str) else part).alias("part"), (F.col(target) if isinstance(target, str) else target).cast("string").alias("target"))


def _repeated(df: DataFrame, code: str, value: Column, *more: str) -> DataFrame:
    """A value that is there more than once in a part."""
    counted = df.withColumn("__v", value).where(~_blank(F.col("__v"))).groupBy("doc_id", "part", "__v", *more).agg(F.count("*").alias("k")).where("k > 1")
    return _found(counted, code, "__v")


def roots(rows: DataFrame) -> DataFrame:
    """E9102: a part whose root is not that of its role."""
    main = rels(rows).where("source = '/' and type = 'officeDocument'").groupBy("doc_id").agg(F.min_by("target", "rel_id").alias("part"))
    role = F.create_map(*[F.lit(x) for pair in ROOTS.items() for x in pair])
    around = rels(rows).where("mode = 'Internal'").join(main.withColumnRenamed("part", "source"), ["doc_id", "source"]).withColumn("root", role[F.col("type")]).where("root is not null")
    first = around.where(~F.col("type").isin("header", "footer")).groupBy("doc_id", "type", "root").agg(F.min_by("target", "rel_id").alias("part")).select("doc_id", "part", "root")
    expected = main.select("doc_id", "part", F.lit("w:document").alias("root")).unionByName(first).unionByName(around.where(F.col("type").isin("header", "footer")).select("doc_id", F.col("target").alias("part"), "root")).distinct()
    top = nodes(rows).where("node_id = 0").select("doc_id", "part", "name")
    return _found(top.join(expected, ["doc_id", "part"]).where("name <> root"), "E9102", "name")


def pairs(rows: DataFrame) -> DataFrame:
    """E9103: starts and ends of bookmarks and comment ranges that are not as many for an id."""
    ids = nodes(rows).where(F.col("name").isin("w:bookmarkStart", "w:bookmarkEnd", "w:commentRangeStart", "w:commentRangeEnd")).select("doc_id", "part", F.regexp_replace("name", "(Start|End)$", "").alias("range"), attr("w:id").alias("id"), F.col("name").endswith("Start").alias("opens"))
    uneven = ids.where(~_blank(F.col("id"))).groupBy("doc_id", "part", "range", "id").agg((F.count_if("opens") != F.count_if(~F.col("opens"))).alias("bad")).where("bad")
    return _found(uneven, "E9103", "id")


def fields(rows: DataFrame) -> DataFrame:
    """E9104: complex fields' markers out of balance, a separator twice, a marker of no known kind; E9112: instructions outside, text before the separator, flags that are neither on nor off."""
    n = nodes(rows).where(F.col("name").isin("w:fldChar", "w:instrText", "w:t"))
    kind = F.when(F.col("name") == "w:fldChar", F.coalesce(attr("w:fldCharType"), F.lit("")))
    step = F.when(kind == "begin", 1).when(kind == "end", -1).otherwise(0)
    order = Window.partitionBy("doc_id", "part").orderBy("node_id")
    level = n.withColumn("kind", kind).withColumn("step", step).withColumn("sum", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # An end without a begin does not count: the depth is the sum above its least value so far (or 0).
    level = level.withColumn("least", F.least(F.lit(0), F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("depth", F.col("sum") - F.col("least"))
    before = level.withColumn("was", F.coalesce(F.lag("depth").over(order), F.lit(0))).withColumn("open", F.when(F.col("kind") == "begin", F.col("depth")).when(F.col("kind") == "end", F.col("was")).otherwise(F.col("depth")))
    # A field is what shares a depth from one begin to the next.
    at = Window.partitionBy("doc_id", "part", "open").orderBy("node_id")
    one = before.withColumn("field", F.sum(F.when(F.col("kind") == "begin", 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc_id", "part", "open", "field").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("separated", F.coalesce(F.max(F.when(F.col("kind") == "separate", 1).otherwise(0)).over(inside), F.lit(0)) == 1)
    stray = one.where((F.col("kind") == "end") & (F.col("was") == 0) | (F.col("kind") == "separate") & ((F.col("depth") == 0) | F.col("separated")) | F.col("kind").isNotNull() & ~F.col("kind").isin("begin", "separate", "end"))
    unclosed = before.groupBy("doc_id", "part").agg(F.max_by("depth", "node_id").alias("open")).where("open > 0")
    early = one.where((F.col("name") == "w:instrText") & (F.col("depth") == 0) | (F.col("name") == "w:t") & (F.col("depth") > 0) & ~F.col("separated") & ~_blank(F.col("text")))
    flags = nodes(rows).where(F.col("name").isin("w:fldSimple", "w:fldChar"))
    wrong = [_found(flags.where(attr(a).isNotNull() & ~attr(a).isin(*ON_OFF)), "E9112", attr(a)) for a in ("w:dirty", "w:fldLock")]
    return reduce(DataFrame.unionByName, [_found(stray, "E9104", "kind"), _found(unclosed, "E9104", "open"), _found(early, "E9112", "name"), *wrong])


def drawings(rows: DataFrame) -> DataFrame:
    """E9105, E9113: pictures whose relationship is missing, no image, or leads to no image part; E9107: a drawing id twice in a part; E9109: an extent that is not positive; E9110: a crop out of bounds."""
    n = nodes(rows)
    blip = n.where(F.col("name").isin("a:blip", "asvg:svgBlip")).select("doc_id", "part", F.coalesce(attr("r:embed"), attr("r:link")).alias("rel_id")).where(~_blank(F.col("rel_id")))
    r = rels(rows).select("doc_id", F.col("source").alias("part"), "rel_id", F.col("type").alias("rel_type"), "mode", "target")
    media = parts(rows).select("doc_id", F.col("part").alias("target"), "content_type", F.lit(True).alias("there"))
    drawn = blip.join(r, ["doc_id", "part", "rel_id"], "left").join(media, ["doc_id", "target"], "left")
    bad = (F.col("rel_type") != "image") | (F.col("mode") == "Internal") & (F.col("there").isNull() | ~F.coalesce(F.lower("content_type").startswith("image/"), F.lit(False)))
    extent = n.where("name = 'wp:extent'").where(~F.coalesce((attr("cx").try_cast("long") > 0) & (attr("cy").try_cast("long") > 0), F.lit(False)))
    side = lambda s: F.when(_blank(attr(s)), F.lit(0).cast("decimal(18,3)")).otherwise(crop_percent(attr(s)))
    fine = reduce(Column.__and__, [side(s).between(0, 100) for s in "ltrb"]) & (side("l") + side("r") < 100) & (side("t") + side("b") < 100)
    crop = n.where("name = 'a:srcRect'").where(~F.coalesce(fine, F.lit(False)))
    found = [_found(drawn.where("mode is null"), "E9105", "rel_id"), _found(drawn.where(F.col("mode").isNotNull() & bad), "E9113", "rel_id"), _repeated(n.where("name = 'wp:docPr'"), "E9107", attr("id")), _found(extent, "E9109", "node_id"), _found(crop, "E9110", "node_id")]
    return reduce(DataFrame.unionByName, found)


def table_rules(rows: DataFrame) -> DataFrame:
    """E9106: tables without rows, rows without cells; E9114: grid numbers that are none, rows wider than the declared grid, vertical merges that nothing began or that do not fit what did."""
    n = nodes(rows)
    key = lambda name, c: n.where(F.col("up") == name).where(F.col("name") == c).select("doc_id", "part", F.col("parent_id").alias("node_id"))
    empty = n.where("name = 'w:tbl'").join(key("w:tbl", "w:tr"), ["doc_id", "part", "node_id"], "left_anti").unionByName(n.where("name = 'w:tr' and up = 'w:tbl'").join(key("w:tr", "w:tc"), ["doc_id", "part", "node_id"], "left_anti"))
    number = attr("w:val").try_cast("int")
    grid = n.where("up = 'w:trPr' and name in ('w:gridBefore', 'w:gridAfter')").where(~F.coalesce(number >= 0, F.lit(False))).unionByName(n.where("up = 'w:tcPr' and name = 'w:gridSpan'").where(~F.coalesce(number > 0, F.lit(False))))
    r, c = table_rows(rows), cells(rows)
    declared = n.where("name = 'w:gridCol' and up = 'w:tblGrid' and table_id = block_id").groupBy("doc_id", "part", "block_id").agg(F.count("*").alias("declared"))
    width = c.groupBy("doc_id", "part", "block_id", "row").agg(F.max("column_end").alias("last"))
    wide = r.join(width, ["doc_id", "part", "block_id", "row"], "left").join(declared, ["doc_id", "part", "block_id"]).where(F.coalesce("last", "grid_before") + F.col("grid_after") > F.col("declared"))
    merged = _merged(c, r).withColumn("begun", F.lit(True))
    loose = c.where("v_merge = 'continue'").join(merged, ["doc_id", "part", "top_cell"], "left").where("begun is null or root_column <> column or root_span <> span")
    return reduce(DataFrame.unionByName, [_found(empty, "E9106", "node_id"), _found(grid, "E9114", "node_id"), _found(wide, "E9114", F.concat("table", F.format_string(".R%02d", "row"))), _found(loose, "E9114", "wire")])


def comment_rules(rows: DataFrame) -> DataFrame:
    """E9108, E9122: extensions and durable ids that are missing, repeated, their own parent, or of no comment; E9111: comments and markers that do not fit."""
    n = nodes(rows)
    known = comments(rows).where(~_blank(F.col("para"))).select("doc_id", F.col("para").alias("id")).distinct()
    out = []
    for code, name, prefix in (("E9108", "w15:commentEx", "w15"), ("E9122", "w16cid:commentId", "w16cid")):
        ext = n.where(F.col("name") == name).select("doc_id", "part", "node_id", "attrs", attr(f"{prefix}:paraId").alias("id"))
        out += [_found(ext.where(_blank(F.col("id"))), code, "node_id"), _repeated(ext, code, F.col("id")), _found(ext.where(~_blank(F.col("id"))).select("doc_id", "part", "id").distinct().join(known, ["doc_id", "id"], "left_anti"), code, "id")]
    ext = n.where("name = 'w15:commentEx'").select("doc_id", "part", attr("w15:paraId").alias("self"), attr("w15:paraIdParent").alias("id")).where(~_blank(F.col("id")))
    ids = n.where("name = 'w16cid:commentId'")
    durable = attr("w16cid:durableId")
    out += [_found(ext.where("self = id"), "E9108", "id"), _found(ext.where("not coalesce(self = id, false)").join(known, ["doc_id", "id"], "left_anti"), "E9108", "id"), _found(ids.where(_blank(durable)), "E9122", "node_id"), _repeated(ids, "E9122", durable)]
    body = n.where("name = 'w:comment'").select("doc_id", "part", "node_id", attr("w:id").alias("id"))
    twice = body.where(~_blank(F.col("id"))).groupBy("doc_id", "id").agg(F.count("*").alias("k"), F.min("part").alias("part")).where("k > 1")
    mark = n.where(F.col("name").isin("w:commentRangeStart", "w:commentRangeEnd", "w:commentReference")).select("doc_id", "part", "node_id", attr("w:id").alias("id"), (F.col("name") == "w:commentReference").alias("cites"))
    none = F.lit(None).cast("string")
    ids = mark.where(~_blank(F.col("id"))).groupBy("doc_id", "id").agg(F.bool_or("cites").alias("cited"))
    out += [_found(body.where(_blank(F.col("id"))), "E9111", "node_id"), _found(twice, "E9111", "id"), _found(mark.where(_blank(F.col("id"))), "E9111", "node_id"), _found(ids.join(body.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti"), "E9111", "id", none), _found(ids.where("not cited"), "E9111", "id", none)]
    return reduce(DataFrame.unionByName, out)


def control_rules(rows: DataFrame) -> DataFrame:
    """E9115: ids that are no numbers or repeat, locks and marks of no known value."""
    n = nodes(rows)
    id_ = n.where("up = 'w:sdtPr' and name = 'w:id'").where(attr("w:val").isNotNull())
    lock = n.where("up = 'w:sdtPr' and name = 'w:lock'").where(attr("w:val").isNotNull() & ~attr("w:val").isin(*LOCKS))
    check = n.where("up = 'w:checkBox' and name = 'w:checked'").where(attr("w:val").isNotNull() & ~attr("w:val").isin(*ON_OFF))
    return reduce(DataFrame.unionByName, [_found(id_.where(attr("w:val").try_cast("int").isNull()), "E9115", attr("w:val")), _repeated(id_, "E9115", attr("w:val")), _found(lock, "E9115", attr("w:val")), _found(check, "E9115", attr("w:val"))])


def references(rows: DataFrame) -> DataFrame:
    """E9119: headers and footers named by a missing or wrong relationship; W9116, W9117: paragraph styles and numberings that are not defined (where any are)."""
    n = nodes(rows)
    main = rels(rows).where("source = '/' and type = 'officeDocument'").groupBy("doc_id").agg(F.min_by("target", "rel_id").alias("part"))
    named = n.where(F.col("name").isin("w:headerReference", "w:footerReference")).join(main, ["doc_id", "part"], "left_semi").select("doc_id", "part", "node_id", F.regexp_extract("name", "w:(header|footer)", 1).alias("wanted"), attr("r:id").alias("rel_id"))
    r = rels(rows).select("doc_id", F.col("source").alias("part"), "rel_id", F.col("type").alias("rel_type"))
    wrong = named.join(r, ["doc_id", "part", "rel_id"], "left").where(_blank(F.col("rel_id")) | F.col("rel_type").isNull() | (F.col("rel_type") != F.col("wanted")))
    s = styles(rows)
    have = n.where("name = 'w:styles' and node_id = 0").select("doc_id").distinct()
    used = n.where("name = 'w:pStyle'").select("doc_id", "part", attr("w:val").alias("style_id")).where(~_blank(F.col("style_id"))).distinct().join(have, "doc_id", "left_semi")
    unknown = used.join(s.where("kind = 'paragraph'").select("doc_id", "style_id"), ["doc_id", "style_id"], "left_anti")
    lists = n.where("name = 'w:numbering' and node_id = 0").select("doc_id", F.col("part").alias("list_part"))
    num = n.where("name = 'w:num'").select("doc_id", attr("w:numId").alias("num_id"))
    asked = n.where("name = 'w:numId' and up = 'w:numPr'").select("doc_id", "part", attr("w:val").alias("num_id")).where(~_blank(F.col("num_id")) & (F.col("num_id") != "0")).distinct().join(lists, "doc_id").where("part <> list_part")
    base = n.where("name = 'w:abstractNumId' and up = 'w:num'").select("doc_id", "part", attr("w:val").alias("abstract")).where(~_blank(F.col("abstract"))).distinct()
    gone = base.join(n.where("name = 'w:abstractNum'").select("doc_id", attr("w:abstractNumId").alias("abstract")), ["doc_id", "abstract"], "left_anti")
    return reduce(DataFrame.unionByName, [_found(wrong, "E9119", F.coalesce("rel_id", "wanted")), _found(unknown, "W9116", "style_id"), _found(asked.join(num, ["doc_id", "num_id"], "left_anti"), "W9117", "num_id"), _found(gone, "W9117", "abstract")])


def settings_and_sections(rows: DataFrame) -> DataFrame:
    """E9118: a setting that is neither on nor off; E9120: columns that are no positive number, orientations of no known value."""
    n = nodes(rows)
    update = n.where("name = 'w:updateFields'").where(attr("w:val").isNotNull() & ~attr("w:val").isin(*ON_OFF))
    columns = n.where("name = 'w:cols' and up = 'w:sectPr'").where(~_blank(attr("w:num")) & ~F.coalesce(attr("w:num").try_cast("int") > 0, F.lit(False)))
    turned = n.where("name = 'w:pgSz' and up = 'w:sectPr'").where(~_blank(attr("w:orient")) & ~attr("w:orient").isin(*ORIENTATIONS))
    return _found(update, "E9118", attr("w:val")).unionByName(_found(columns, "E9120", attr("w:num"))).unionByName(_found(turned, "E9120", attr("w:orient")))


def revisions(rows: DataFrame) -> DataFrame:
    """E9121: revisions without a valid id, author or date, property revisions without the old properties, deleted text outside of a deletion."""
    n = nodes(rows)
    marked = n.where(F.col("name").isin("w:ins", "w:del", *REVISED))
    wrong = {"id": ~F.coalesce(attr("w:id").try_cast("int") >= 0, F.lit(False)), "author": _blank(attr("w:author")), "date": F.try_to_timestamp(attr("w:date")).isNull()}
    out = [_found(marked.where(c), "E9121", F.concat_ws(":", "name", F.lit(what))) for what, c in wrong.items()]
    inner = n.select("doc_id", "part", F.col("parent_id").alias("node_id"), F.col("name").alias("old"))
    held = F.create_map(*[F.lit(x) for pair in REVISED.items() for x in pair])[F.col("name")]
    out.append(_found(marked.withColumn("old", held).where("old is not null").join(inner, ["doc_id", "part", "node_id", "old"], "left_anti"), "E9121", "name"))
    out.append(_found(n.where("name = 'w:delText' and del_id is null"), "E9121", "node_id"))
    return reduce(DataFrame.unionByName, out)


def names(rows: DataFrame) -> DataFrame:
    """W9109: bookmark names, and tags and aliases of content controls, that a selector could not tell apart."""
    n = nodes(rows)
    control = lambda name: n.where("up = 'w:sdtPr'").where(F.col("name") == name)
    return _repeated(bookmarks(rows), "W9109", F.col("bookmark")).unionByName(_repeated(control("w:tag"), "W9109", attr("w:val"))).unionByName(_repeated(control("w:alias"), "W9109", attr("w:val")))


def links(rows: DataFrame) -> DataFrame:
    """W1015: links whose relationship is missing; W1016: addresses that are not valid; W1017, W1018: anchors that name no bookmark, or several; W1023: links to parts."""
    h = hyperlinks(rows)
    some = F.col("anchor").isNotNull()
    return reduce(DataFrame.unionByName, [_found(h.where("broken"), "W1015", "node_id"), _found(h.where("not valid"), "W1016", "uri"), _found(h.where(some & (F.col("anchors") == 0)), "W1017", "anchor"), _found(h.where(some & (F.col("anchors") > 1)), "W1018", "anchor"), _found(h.where("internal"), "W1023", "uri")])


def dangling(rows: DataFrame) -> DataFrame:
    """E0007: internal relationships whose target is not in the package."""
    there = parts(rows).select("doc_id", F.col("part").alias("target"))
    return _found(rels(rows).where("mode = 'Internal'").join(there, ["doc_id", "target"], "left_anti"), "E0007", "target", "source")


def refused(rows: DataFrame) -> DataFrame:
    """What opening the package said."""
    return diagnostics(rows).select("doc_id", "code", F.lit(None).cast("string").alias("part"), F.col("message").alias("target"))


RULES = [roots, pairs, fields, drawings, table_rules, comment_rules, control_rules, references, settings_and_sections, revisions, names, links, dangling, refused]


def validate(rows: DataFrame) -> DataFrame:
    """``doc_id, code, part, target`` of every violated rule; ``rows`` should be ``shredded``, since every rule reads them."""
    return reduce(DataFrame.unionByName, [rule(rows) for rule in RULES])


def capped(violations: DataFrame, most: int = 500) -> DataFrame:
    """``doc_id, place, code, part, target`` of at most ``most`` violations of each package, by code, part and target.

    Where there are more, the last place tells how many were left out: E9199 if one of them is an
    error, else W9199.  A package's violations are counted by a window, so none is gathered.
    """
    of, order = Window.partitionBy("doc_id"), ["code", "part", "target"]
    ranked = violations.withColumns({"place": F.row_number().over(of.orderBy(*order)), "all": F.count("*").over(of), "worst": F.min(F.when(F.col("code").startswith("E"), "E").otherwise("W")).over(of.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    cap = max(1, most)
    kept = ranked.where((F.col("all") <= cap) | (F.col("place") <= cap))
    last = (F.col("all") > cap) & (F.col("place") == cap)
    left = F.concat((F.col("all") - cap + 1).cast("string"), F.lit(" of "), F.col("all").cast("string"))
    return kept.select("doc_id", F.col("place").cast("long").alias("place"), F.when(last, F.concat("worst", F.lit("9199"))).otherwise(F.col("code")).alias("code"), F.when(~last, F.col("part")).alias("part"), F.when(last, left).otherwise(F.col("target")).alias("target"))


def new_violations(after: DataFrame, before: DataFrame) -> DataFrame:
    """What ``after`` violates more often than ``before``, as multisets."""
    return after.exceptAll(before)

"""Field codes, annotations of targets, search, canonical markup and chains, against plain readings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from paperloom.operators.joins import ancestors
from paperloom.operators.lexing import field_facts, tokens
from paperloom.plans import notes as A
from paperloom.plans import model as M
from paperloom.plans import packages as P
from paperloom.sources.packages import shredded
from tests.test_packages import REL, W, p, package, small_plans  # noqa: F401


def lexed(code):
    out, now, quoted = [], "", False
    for c in code:
        if c == '"':
            quoted = not quoted
        elif c.isspace() and c not in "\x1c\x1d\x1e\x1f" and not quoted:
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def told(words):
    kind = ("FORMULA" if words[0].startswith("=") else words[0].upper()) if words else None
    rest, anchors, links, expects = words[1:], [], [], False
    for t in rest:
        if expects:
            anchors, expects = [*anchors, t], False
        elif t.lower() == "\\l":
            expects = True
        elif not t.startswith("\\"):
            links.append(t)
    plain = [t for t in rest if not t.startswith("\\")]
    some = lambda v: list(dict.fromkeys(x for x in v if x.strip()))
    reference = kind in ("REF", "PAGEREF", "NOTEREF")
    return kind, plain, list(dict.fromkeys(t.upper() for t in rest if t.startswith("\\"))), some(plain[:1]) if reference else some(anchors) if kind == "HYPERLINK" else [], some(links) if kind == "HYPERLINK" else []


def test_field_codes(spark):
    rng = random.Random(3)
    pieces = ["REF", "ref ", "HYPERLINK ", "=1+2", '"', '"', '"', " ", " ", "\t", " ", " ", "\\l", "\\L ", "\\h ", "a", "b c", "", "é\x1c"]
    codes = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(500)] + ['HYPERLINK \\l \\l x y "" " "', 'REF "a b"c \\h', ""]
    rows = spark.createDataFrame(list(enumerate(codes)), "k long, code string").withColumn("w", tokens(F.col("code")))
    got = {r["k"]: r for r in rows.select("k", "w", *[c.alias(n) for n, c in field_facts(F.col("w")).items()]).collect()}
    for k, code in enumerate(codes):
        words = lexed(code)
        assert got[k]["w"] == words, code
        assert (got[k]["field"], got[k]["arguments"], got[k]["switches"], got[k]["bookmarks"], got[k]["links"]) == told(words), code
    assert rows.where("k = 501").select(tokens(F.lit(None).cast("string"))).first()[0] is None


def made(spark, body, extra=None, rels=""):
    return shredded(spark.createDataFrame([(1, bytearray(package(body, rels, extra)))], "doc_id long, content binary"))


def test_annotations_of_targets(spark):
    body = (
        "<w:sdt><w:sdtPr><w:tag w:val='around'/></w:sdtPr><w:sdtContent>" + p("in a control") + "</w:sdtContent></w:sdt>"
        + "<w:ins>" + p("first inside") + "</w:ins><w:p><w:bookmarkStart w:id='1' w:name='mark'/><w:sdt><w:sdtPr><w:alias w:val='inner'/></w:sdtPr></w:sdt><w:fldSimple w:instr=' REF mark '/><w:hyperlink w:anchor='mark'/><w:hyperlink w:anchor='mark'/><w:commentRangeStart w:id='0'/></w:p>"
        + "<w:tbl><w:tr><w:tc><w:p><w:bookmarkEnd w:id='1'/><w:bookmarkStart w:id='2' w:name='b2'/><w:bookmarkEnd w:id='2'/><w:r><w:commentReference w:id='1'/></w:r></w:p></w:tc></w:tr></w:tbl><w:sdt><w:sdtPr><w:tag w:val='lost'/></w:sdtPr></w:sdt>"
    )
    extra = {
        "word/comments.xml": f"<w:comments {W}><w:comment w:id='0' w:author='Ann'><w:p w14:paraId='P1'/></w:comment><w:comment w:id='1' w:author='Bob'><w:p w14:paraId='P2'/></w:comment></w:comments>",
        "word/ex.xml": f"<w15:commentsEx {W}><w15:commentEx w15:paraId='P1' w15:done='1'/><w15:commentEx w15:paraId='P2' w15:paraIdParent='P1'/></w15:commentsEx>",
        "word/ids.xml": f"<w16cid:commentsIds {W}><w16cid:commentId w16cid:paraId='P2' w16cid:durableId='D2'/></w16cid:commentsIds>",
    }
    rows = made(spark, body, extra)
    found = A.target_annotations(rows)
    got = {r["target"]: {k: r[k] for k in A.KINDS if r[k]} for r in found.collect()}
    first = {"comment_ids": ["0", "1"], "comment_bodies": ["C001.C0001", "C001.C0002"], "comment_paras": ["P1", "P2"], "comment_parents": ["P1"], "comment_roots": ["P1"], "comment_durables": ["D2"], "comment_replies": ["1"], "comment_resolved": ["0"]}
    assert "M.P0001" not in got and "M.CC0001" not in str(got)  # what a block-level control holds is no target
    wrapper = A.with_target(rows, P.nodes(rows).where("name in ('w:ins', 'w:sdt')").select(*A.KEY, "name")).orderBy("node_id").collect()
    assert [(r["name"], r["target"]) for r in wrapper] == [("w:sdt", None), ("w:ins", "M.P0001"), ("w:sdt", "M.P0002"), ("w:sdt", None)]
    assert {k: sorted(v) if k.startswith("comment") else v for k, v in got["M.P0002"].items()} == {"bookmarks": ["mark"], "control_ids": ["M.CC0002"], "control_aliases": ["inner"], "field_ids": ["M.F0001"], "field_codes": ["REF mark"], "field_kinds": ["simple"], "field_types": ["REF"], "link_ids": ["M.L0001", "M.L0002"], "link_targets": ["mark"], **first}
    assert got["M.T0001.R01.C01"]["bookmarks"] == ["mark", "b2"] and got["M.T0001.R01.C01"]["comment_ids"] == ["1"] and "M.CC0003" not in str(got)
    sliced = A.target_annotations(rows, 8).where("target = 'M.P0002'").collect()
    assert len(sliced) > 1 and {v for r in sliced for v in r["link_ids"]} == {"M.L0001", "M.L0002"}


def test_grouping_is_one_exchange(spark):
    from paperloom.operators.notes import gathered, tagged

    rows = spark.createDataFrame([(1, 5, "a", " "), (1, 3, "b", "x"), (1, 3, "b", None), (None, 1, "z", "z"), (2, 99, "a", "y")], "target long, place long, one string, two string")
    both = gathered([tagged(rows, "target", "place", [], one="one", two="two"), tagged(rows, "target", "place", [], three="two")], [], ["one", "two", "three"], 50)
    assert sorted((r["target"], r["slice"], r["one"], r["two"], r["three"]) for r in both.collect()) == [("1", 0, ["b", "a"], ["x"], ["x"]), ("2", 1, ["a"], ["y"], ["y"])]
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_find_and_context_over_packages(spark):
    body = p("An Old tale") + "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(t)}</w:tc>" for t in ("gold", "x", "OLD y")) + "</w:tr></w:tbl><w:del>" + p("old, gone") + "</w:del>" + p("cold " * 10)
    rows = made(spark, body, {"word/header1.xml": f"<w:hdr {W}>{p('old head')}</w:hdr>"}, f'<Relationship Id="rId1" Type="{REL}/header" Target="header1.xml"/>')
    assert [(r.kind, r.wire, r.parent, r.text) for r in A.find(rows, "OLD", 12).orderBy("place").collect()] == [("paragraph", "M.P0001", None, "An Old tale"), ("paragraph", "M.P0003", None, "cold cold..."), ("paragraph", "H001.P0001", None, "old head"), ("cell", "M.T0001.R01.C01", "M.T0001", "gold"), ("cell", "M.T0001.R01.C03", "M.T0001", "OLD y")]
    assert sorted((r.offset, r.text) for r in A.context_of_cells(rows, ["M.T0001.R01.C02"]).collect()) == [(-1, "gold"), (0, "x"), (1, "OLD y")]


def test_canonical_hash(spark):
    forms = [
        "<m:oMath><m:r a='1' w:b='2'><m:t>x</m:t></m:r></m:oMath>",
        "<q:oMath xmlns:q='http://schemas.openxmlformats.org/officeDocument/2006/math'>\n  <q:r w:b='2' a='1'><q:t>x</q:t></q:r></q:oMath>",
        "<m:oMath><m:r a='1' w:b='2'/><m:t>x</m:t></m:oMath>",
        "<m:oMath><m:r a='1' w:b='2'><m:t>x</m:t><m:r/></m:r></m:oMath>",
        "<m:oMath><m:r a='1' w:b='2'><m:t>x</m:t></m:r><m:r/></m:oMath>",
        "<m:oMathPara><m:oMath><m:r a='1' w:b='2'><m:t> </m:t></m:r></m:oMath></m:oMathPara>",
    ]
    got = M.equations(made(spark, "<w:p>" + "".join(forms) + "</w:p><w:del><w:p><m:oMath/></w:p></w:del>")).orderBy("ord").collect()
    hashes = [r.hash for r in got]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 5 and [r.display for r in got] == [False] * 5 + [True] and [r.preview for r in got] == ["x"] * 5 + [" "]
    import hashlib

    m, w = ("{%s}" % u for u in ("http://schemas.openxmlformats.org/officeDocument/2006/math", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"))
    sized = lambda s: f"{len(s)}:{s}"
    plain = f"{sized(m + 'oMath')}[]1:0{sized(m + 'r')}[{sized('a')}{sized('1')}{sized('w:b')}{sized('2')}]1:1{sized(m + 't')}[]1:2{sized('x')}"
    assert hashes[0] == hashlib.sha256(plain.encode()).hexdigest() and w


def test_chains_of_any_length_and_circles(spark):
    rng = random.Random(1)
    up = {f"a{k}": f"a{k + 1}" for k in range(300)} | {f"c{k}": f"c{(k + 1) % 7}" for k in range(7)} | {"t0": "t1", "t1": "t2", "t2": "c3", "self": "self"}
    up |= {f"r{k}": f"r{rng.randint(0, 60)}" for k in range(60)}
    want = set()
    for node in up:
        at, seen, steps = node, {node}, 0
        while at in up and up[at] not in seen:
            at, steps = up[at], steps + 1
            seen.add(at)
            want.add((node, at, steps))
    got = ancestors(spark.createDataFrame(list(up.items()), "child string, parent string")).collect()
    assert {(r["node"], r["ancestor"], r["steps"]) for r in got} == want and len(got) == len(want)


def test_controls(spark):
    list_ = lambda tag, items: f"<w:{tag}>{''.join(f'<w:listItem w:displayText={chr(39)}{d}{chr(39)} w:value={chr(39)}{v}{chr(39)}/>' for d, v in items)}</w:{tag}>"
    sdt = lambda inner, content="": f"<w:sdt><w:sdtPr>{inner}</w:sdtPr><w:sdtContent>{content}</w:sdtContent></w:sdt>"
    item = sdt("<w15:repeatingSectionItem/>")
    body = "<w:p>" + "".join([
        sdt("<w:id w:val='7'/><w:tag w:val='t'/><w:text/><w:dataBinding w:xpath='/a' w:storeItemID='{1}' w:prefixMappings='x'/><w:showingPlcHdr/><w:placeholder><w:docPart w:val='ph'/></w:placeholder>"),
        sdt("<w:tag w:val='t'/><w:alias w:val='a'/><w:lock/>" + list_("dropDownList", [("A", "1"), ("B", "2")])),
        sdt("<w:lock w:val='unlocked'/>" + list_("comboBox", [("C", "3")])), sdt("<w:lock w:val='sdtLocked'/><w:checkBox><w:checked w:val='1'/></w:checkBox>"),
        sdt("<w:checkBox><w:checked/></w:checkBox>"), sdt("<w:date w:fullDate='2024-01-02'><w:dateFormat w:val='yyyy'/></w:date>"), sdt("<w:picture/><w:text/>"),
        sdt("<w15:repeatingSection w15:sectionTitle='rows'/>", item + item + sdt("<w:text/>", item)), "<w:sdt/>",
    ]) + "</w:p>"
    got = M.controls(made(spark, body)).orderBy("node_id").collect()
    assert [(r.kind, r.edit_status) for r in got if r.parent is None] == [("plain-text", "plain-text"), ("dropdown-list", "locked"), ("combo-box", "choice"), ("checkbox", "locked"), ("checkbox", "checkbox"), ("date", "date"), ("picture", "unsupported-picture"), ("repeating-section", "unsupported-repeating-section"), ("rich-text", "rich-text")]
    one, two = got[:2]
    assert (one.id, one.tag, one.xpath, one.store, one.prefixes, one.placeholder, one.shows_placeholder, one.tag_repeats, one.items) == ("7", "t", "/a", "{1}", "x", "ph", True, True, [])
    assert (two.alias, two.lock, two.alias_repeats, [tuple(i) for i in two.items]) == ("a", "locked", False, [("A", "1"), ("B", "2")])
    assert [tuple(i) for i in got[2].items] == [("C", "3")] and [r.checked for r in got[3:5]] == [True, None] and (got[5].date, got[5].date_format) == ("2024-01-02", "yyyy")
    section = next(r for r in got if r.kind == "repeating-section")
    assert (section.section_title, section.section_items) == ("rows", 2) and sum(r.parent == section.node_id for r in got) == 3


def test_outline(spark):
    body = (
        "<w:p><w:pPr><w:outlineLvl w:val='0'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>" + "<w:tbl><w:tblPr><w:tblCaption w:val='cap'/></w:tblPr><w:tr><w:tc>" + p("x") + "</w:tc><w:tc/></w:tr></w:tbl>"
        + "<w:p><w:bookmarkStart w:id='1' w:name='m'/><w:bookmarkEnd w:id='1'/><w:bookmarkStart w:id='2' w:name='m'/><w:sdt><w:sdtPr><w:alias w:val='al'/></w:sdtPr></w:sdt><w:fldSimple w:instr='PAGE'/><w:hyperlink r:id='none'/><w:del><m:oMath/></w:del><m:oMath><m:r><m:t>e</m:t></m:r></m:oMath>"
        + "<w:r><w:drawing><wp:inline><a:blip r:embed='rId5'/></wp:inline></w:drawing></w:r></w:p><w:sectPr/>"
    )
    rows = made(spark, body, {"word/a.png": b"x"}, f'<Relationship Id="rId5" Type="{REL}/image" Target="a.png"/>')
    got = [(r.kind, r.id, r.target, r.label, r.detail, r.status, r.repeats) for r in A.outline(rows).orderBy("rank").collect()]
    assert got == [
        ("heading", "M.P0001", None, "Head", "1", None, False), ("table", "M.T0001", None, "cap", "1x2", None, False), ("section", "M.S0001", None, None, "1 portrait", None, False), ("image", "M.I0001", "M.P0002", "/word/a.png", "inline", None, False),
        ("bookmark", "M.B0001", "M.P0002", "m", None, "complete", True), ("bookmark", "M.B0002", "M.P0002", "m", None, "open", True), ("content-control", "M.CC0001", "M.P0002", "al", "rich-text", "rich-text", False),
        ("field", "M.F0001", "M.P0002", "PAGE", "PAGE", "word-layout", False), ("hyperlink", "M.L0001", "M.P0002", None, None, "broken", False), ("equation", "M.E0002", "M.P0002", "e", "inline", None, False),
    ]


def test_violations_are_capped_for_each_package(spark):
    from paperloom.plans.rules import capped

    many = [(1, f"W910{k}", "/p", str(k)) for k in range(5)] + [(2, "E9105", "/p", "a"), (2, "W9116", "/p", "b"), (2, "W9117", "/p", "c"), (2, "W9117", "/p", "c"), (3, "E9101", None, None)]
    got = {}
    for r in capped(spark.createDataFrame(many, "doc_id long, code string, part string, target string"), 3).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.code, r.target))
    assert got == {1: [("W9100", "0"), ("W9101", "1"), ("W9199", "3 of 5")], 2: [("E9105", "a"), ("W9116", "b"), ("W9199", "2 of 4")], 3: [("E9101", None)]}
    assert [r.code for r in capped(spark.createDataFrame(many, "doc_id long, code string, part string, target string"), 0).where("doc_id = 2").collect()] == ["E9199"]

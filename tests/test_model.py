"""Derived relations and edits of packages."""

from __future__ import annotations

import pytest

from paperloom.operators.package_edits import apply_texts
from paperloom.plans import model as M
from paperloom.plans import packages as P
from paperloom.plans import rules as R
from paperloom.plans.offsets import plan_replacement
from paperloom.sources.packages import save, shred, shredded
from tests.test_packages import REL, W, p, package, small_plans  # noqa: F401

STYLES = f"<w:styles {W}><w:style w:type='paragraph' w:styleId='Top'><w:name w:val='Top'/><w:pPr><w:outlineLvl w:val='1'/></w:pPr></w:style><w:style w:type='paragraph' w:styleId='Sub'><w:name w:val='Sub'/><w:basedOn w:val='Top'/></w:style><w:style w:type='paragraph' w:styleId='A'><w:basedOn w:val='B'/></w:style><w:style w:type='paragraph' w:styleId='B'><w:basedOn w:val='A'/></w:style></w:styles>"
NUMBERING = f"<w:numbering {W}><w:abstractNum w:abstractNumId='0'><w:lvl w:ilvl='0'><w:start w:val='3'/><w:numFmt w:val='upperRoman'/><w:lvlText w:val='%1.'/></w:lvl><w:lvl w:ilvl='1'><w:numFmt w:val='lowerLetter'/><w:lvlText w:val='%1%2)'/></w:lvl></w:abstractNum><w:num w:numId='5'><w:abstractNumId w:val='0'/></w:num></w:numbering>"
COMMENTS = f"<w:comments {W}><w:comment w:id='0' w:author='Ann'><w:p w14:paraId='P1'><w:r><w:t>Why?</w:t></w:r></w:p></w:comment><w:comment w:id='1' w:author='Bob'><w:p w14:paraId='P2'><w:r><w:t>So.</w:t></w:r></w:p></w:comment></w:comments>"
EXTENDED = f"<w15:commentsEx {W}><w15:commentEx w15:paraId='P1' w15:done='1'/><w15:commentEx w15:paraId='P2' w15:paraIdParent='P1'/></w15:commentsEx>"
IDS = f"<w16cid:commentsIds {W}><w16cid:commentId w16cid:paraId='P2' w16cid:durableId='D2'/></w16cid:commentsIds>"


def styled(text: str, style: str = "", num: int | None = None) -> str:
    number = f"<w:numPr><w:ilvl w:val='{num}'/><w:numId w:val='5'/></w:numPr>" if num is not None else ""
    return f"<w:p><w:pPr>{f'<w:pStyle w:val={style!r}/>' if style else ''}{number}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


BODY = (
    styled("Head", "Sub") + styled("Loop", "A") + styled("Late", "Heading3") + styled("i", num=0) + styled("ii", num=1) + styled("iii", num=1) + styled("iv", num=0) + styled("v", num=1)
    + "<w:p><w:fldSimple w:instr=' REF  mark \\h '><w:r><w:t>x</w:t></w:r></w:fldSimple><w:sdt><w:sdtPr><w:tag w:val='out'/></w:sdtPr><w:sdt><w:sdtPr><w:alias w:val='in'/></w:sdtPr></w:sdt></w:sdt><m:oMath><m:r><m:t>a+b</m:t></m:r></m:oMath></w:p>"
    + "<w:p><w:r><w:t>red &amp; red</w:t></w:r><w:r><w:t> blue</w:t></w:r></w:p>" + "<w:p><w:r><w:t>bl</w:t></w:r><w:r><w:t>ue green</w:t></w:r></w:p>"
    + "<w:sectPr><w:pgSz w:w='11906' w:h='16838' w:orient='landscape'/><w:cols w:num='2'/></w:sectPr>"
)


@pytest.fixture(scope="module")
def rows(spark):
    one = package(BODY, "", {"word/styles.xml": STYLES, "word/numbering.xml": NUMBERING, "word/comments.xml": COMMENTS, "word/commentsExtended.xml": EXTENDED, "word/commentsIds.xml": IDS})
    return shredded(spark.createDataFrame([(1, bytearray(one)), (2, bytearray(package(p("plain"))))], "doc_id long, content binary"))


def test_headings_follow_chains(rows):
    assert {(r.text, r.level) for r in M.headings(rows).collect()} == {("Head", 2), ("Late", 3)}


def test_labels(rows):
    assert [r.label for r in M.list_labels(rows).orderBy("wire").collect()] == ["III.", "IIIa)", "IIIb)", "IV.", "IVa)"]


def test_sections_fields_controls_equations(rows):
    assert [(r.columns, r.orientation, r.width) for r in M.sections(rows).collect()] == [(2, "landscape", 11906)]
    assert [(r.field, r.bookmark) for r in M.simple_fields(rows).collect()] == [("REF", "mark")]
    outer, inner = M.controls(rows).orderBy("node_id").collect()
    assert (outer.tag, outer.parent, inner.alias, inner.parent) == ("out", None, "in", outer.node_id)
    assert [(r.preview, len(r.hash)) for r in M.equations(rows).collect()] == [("a+b", 64)]
    assert {(r.doc_id, r.code, r.feature, r.n) for r in M.feature_warnings(rows).collect()} == {(1, "W1011", "equation", 1), (1, "W1003", "field", 1), (1, "W1006", "content-control", 2)}


def test_threads(rows):
    got = {r.comment_id: (r.text, r.thread, r.is_reply, r.done) for r in M.comment_threads(rows).collect()}
    assert got == {"0": ("Why?", "1|P1", False, True), "1": ("So.", "1|P1", True, False)}
    assert {r.comment_id: r.durable_id for r in M.comment_threads(rows).collect()} == {"0": None, "1": "D2"}


def test_replacement(rows):
    code = lambda *a, **k: {r.wire: r.code for r in plan_replacement(rows, *a, **k).where("doc_id = 1").collect()}
    assert code("red", "x") == {"M.P0010": "E1202"} and code("red", "x", 3) == {"M.P0010": "E4203"}
    assert code("blue", "x") == {"M.P0010": "ok", "M.P0011": "ok"} and code("green", "green") == {"M.P0011": "I0001"}
    plan = plan_replacement(rows, "red", "<new>", 2).where("code = 'ok'")
    again = shred(save(apply_texts(rows, plan)))
    texts = {(r.doc_id, r.wire): r.text for r in P.blocks(again).collect()}
    assert texts[1, "M.P0010"] == "red & <new> blue" and texts[2, "M.P0001"] == "plain"
    old, new = ({(r.doc_id, r.part): bytes(r.bytes) for r in P.parts(x).collect()} for x in (rows, again))
    assert {k for k in old if old[k] != new[k]} == {(1, "/word/document.xml")}


def made(spark, body: str, extra: dict | None = None, rels: str = ""):
    return shredded(spark.createDataFrame([(1, bytearray(package(body, rels, extra)))], "doc_id long, content binary"))


def test_every_kind_of_change_has_its_name(spark):
    body = "<w:p>" + "".join(f"<{name} w:id='{k}'/>" for k, name in enumerate(P.CHANGES)) + "</w:p><w:tbl><w:tr><w:trPr><w:ins/></w:trPr><w:tc/></w:tr><w:tr><w:trPr><w:del/></w:trPr><w:tc/></w:tr></w:tbl>"
    got = [r.kind for r in P.changes(made(spark, body)).orderBy("ord").collect()]
    assert got == [*P.CHANGES.values(), "row-inserted", "row-deleted"] and len(P.CHANGES) == 25


def test_changes_find_their_targets(spark):
    body = (
        "<w:moveFromRangeStart w:id='1'/>" + p("one") + "<w:moveFromRangeEnd w:id='1'/><w:sdt><w:sdtContent><w:ins w:id='2'/></w:sdtContent></w:sdt>"
        + "<w:tbl><w:tr><w:trPr><w:del w:id='3'/></w:trPr><w:tc><w:p><w:ins w:id='4'/></w:p></w:tc></w:tr></w:tbl>"
        + "<w:p><w:pPr><w:sectPr><w:sectPrChange w:id='5'/></w:sectPr></w:pPr><w:commentRangeStart w:id='0'/><w:del w:id='6'/></w:p><w:customXmlDelRangeEnd w:id='7'/>"
    )
    notes = f"<w:comments {W}><w:comment w:id='0'><w:p/></w:comment></w:comments>"
    got = {(r.revision or r.comment_id, r.kind): (r.target, r.target_source, r.nearest) for r in P.changes(made(spark, body, {"word/comments.xml": notes})).collect()}
    assert got["1", "move-from-range-start"] == got["1", "move-from-range-end"] == ("M.P0001", "adjacent-range", None)
    assert got["2", "inserted-run"] == (None, "none", None)
    assert got["3", "row-deleted"][:2] == ("M.T0001.R01", "ancestor") and got["4", "inserted-run"][:2] == ("M.T0001.R01.C01", "ancestor")
    assert got["5", "section-properties-change"][:2] == ("M.S0001", "ancestor") and got["6", "deleted-run"][:2] == ("M.P0002", "ancestor")
    assert got["7", "custom-xml-delete-range-end"][:2] == ("M.P0002", "adjacent-range") and got["0", "comment"][0] == "C001.C0001"


def test_runs_carry_their_markup(spark):
    body = "<w:p><w:r><w:t>a</w:t></w:r><w:ins w:id='3' w:author='Bo' w:date='2024-01-01T00:00:00Z'><w:r><w:t>b</w:t></w:r></w:ins><w:hyperlink r:id='rId7' w:anchor='x'><w:r><w:t>c</w:t></w:r></w:hyperlink><w:commentRangeStart w:id='5'/><w:r><w:commentReference w:id='5'/></w:r><w:del w:id='4'><w:r><w:delText>d</w:delText></w:r></w:del><w:r/></w:p>"
    got = [(r.text, r.kind, r.revision, r.author, r.rel_id, r.anchor, r.comment_id) for r in P.runs(made(spark, body)).orderBy("ord").collect()]
    none = (None,) * 5
    assert got == [("a", None, *none), ("b", "inserted-run", "3", "Bo", None, None, None), ("c", "hyperlink", None, None, "rId7", "x", None), ("", "comment-range-start", *none[:4], "5"), ("", "comment-reference", *none[:4], "5"), ("", "deleted-run", "4", None, None, None, None)]


def test_only_text_of_the_word_namespace(spark):
    body = "<w:p><w:r><w:t>in</w:t></w:r><m:oMath><m:r><m:t>out</m:t></m:r></m:oMath><w:r><w:drawing><a:p><a:r><a:t>out</a:t></a:r></a:p></w:drawing></w:r></w:p>"
    assert [r.text for r in P.blocks(made(spark, body)).collect()] == ["in"]


def test_vertical_merges(spark):
    cell = lambda merge="", span=1: f"<w:tc><w:tcPr><w:gridSpan w:val='{span}'/>{f'<w:vMerge w:val={merge!r}/>' if merge else ''}</w:tcPr><w:p/></w:tc>"
    row = lambda *c: f"<w:tr>{''.join(c)}</w:tr>"
    body = "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid>" + row(cell("restart"), cell()) + row(cell("continue"), cell("continue")) + row(cell("continue"), cell()) + row(cell(), cell()) + row(cell("continue"), cell(), cell()) + row(cell("restart", 2)) + row(cell("continue"), cell()) + "</w:tbl>"
    rows = made(spark, body)
    got = {r.wire.removeprefix("M.T0001."): r.v_root and r.v_root.removeprefix("M.T0001.") for r in P.cells(rows).where("v_merge is not null").collect()}
    assert got == {"R01.C01": "R01.C01", "R02.C01": "R01.C01", "R02.C02": None, "R03.C01": "R01.C01", "R05.C01": None, "R06.C01": "R06.C01", "R07.C01": "R06.C01"}
    bad = sorted(r.target.removeprefix("M.T0001.") for r in R.table_rules(rows).collect())
    assert bad == ["R02.C02", "R05", "R05.C01", "R07.C01"]
    t = P.tables(rows).first()
    assert (t.rows, t.columns, t.grid, t.has_merged, t.has_nested) == (7, 3, 2, True, False)


def test_complex_fields_are_put_together(spark):
    mark = lambda kind: f"<w:r><w:fldChar w:fldCharType='{kind}'/></w:r>"
    said = lambda tag, text: f"<w:r><w:{tag}>{text}</w:{tag}></w:r>"
    body = "<w:p>" + mark("begin") + said("instrText", " IF ") + mark("begin") + said("instrText", "REF here") + mark("separate") + said("t", "7") + mark("end") + said("instrText", " = 7") + mark("separate") + said("t", "yes") + mark("end") + said("t", "x") + mark("begin") + said("instrText", "PAGE") + "</w:p>"
    rows = made(spark, body)
    got = {(r.depth, r.field, r.code, r.result, r.bookmark, r.complete) for r in M.complex_fields(rows).collect()}
    assert got == {(1, "IF", "IF = 7", "yes", None, True), (2, "REF", "REF here", "7", "here", True), (1, "PAGE", "PAGE", "", None, False)}
    assert [r.code for r in R.fields(rows).collect()] == ["E9104"]


def test_field_rules(spark):
    mark = lambda kind: f"<w:r><w:fldChar w:fldCharType='{kind}' w:dirty='maybe'/></w:r>"
    body = "<w:p>" + mark("end") + mark("begin") + mark("separate") + mark("separate") + mark("end") + mark("odd") + "<w:r><w:instrText>X</w:instrText></w:r>" + mark("begin") + "<w:r><w:t>early</w:t></w:r>" + mark("end") + "</w:p>"
    got = sorted((r.code, r.target) for r in R.fields(made(spark, body)).collect())
    assert got == sorted([("E9104", "end"), ("E9104", "separate"), ("E9104", "odd"), ("E9112", "w:instrText"), ("E9112", "w:t")] + [("E9112", "maybe")] * 8)


def test_numbering_by_style_and_overrides(spark):
    styles = f"<w:styles {W}><w:style w:type='paragraph' w:styleId='L'><w:pPr><w:numPr><w:ilvl w:val='1'/><w:numId w:val='5'/></w:numPr></w:pPr></w:style><w:style w:type='paragraph' w:styleId='L2'><w:basedOn w:val='L'/></w:style></w:styles>"
    lists = f"<w:numbering {W}><w:abstractNum w:abstractNumId='0'><w:lvl w:ilvl='0'><w:numFmt w:val='decimal'/><w:lvlText w:val='%1.'/></w:lvl><w:lvl w:ilvl='1'><w:numFmt w:val='decimal'/><w:lvlText w:val='%2'/></w:lvl></w:abstractNum><w:num w:numId='5'><w:abstractNumId w:val='0'/><w:lvlOverride w:ilvl='0'><w:startOverride w:val='3999'/><w:lvl w:ilvl='0'><w:numFmt w:val='upperRoman'/><w:lvlText w:val='(%1)'/></w:lvl></w:lvlOverride></w:num></w:numbering>"
    body = styled("a", "L2") + styled("b", "L", num=0) + styled("c", num=0) + "<w:p><w:pPr><w:pStyle w:val='L'/><w:numPr><w:numId w:val='0'/></w:numPr></w:pPr></w:p>"
    got = [(r.level, r.label) for r in M.list_labels(made(spark, body, {"word/styles.xml": styles, "word/numbering.xml": lists})).orderBy("wire").collect()]
    assert got == [(1, "1"), (0, "(MMMCMXCIX)"), (0, None)]


def test_long_chains(spark):
    styles = f"<w:styles {W}>" + "".join(f"<w:style w:type='paragraph' w:styleId='S{k}'>{f'<w:basedOn w:val={chr(39)}S{k - 1}{chr(39)}/>' if k else '<w:pPr><w:outlineLvl w:val=' + chr(39) + '2' + chr(39) + '/></w:pPr>'}</w:style>" for k in range(14)) + "</w:styles>"
    notes = f"<w:comments {W}>" + "".join(f"<w:comment w:id='{k}'><w:p w14:paraId='P{k}'/></w:comment>" for k in range(14)) + "</w:comments>"
    ext = f"<w15:commentsEx {W}>" + "".join(f"<w15:commentEx w15:paraId='P{k}' {f'w15:paraIdParent={chr(39)}P{k - 1}{chr(39)}' if k else ''}/>" for k in range(14)) + "</w15:commentsEx>"
    rows = made(spark, styled("deep", "S13"), {"word/styles.xml": styles, "word/comments.xml": notes, "word/commentsExtended.xml": ext})
    assert [(r.text, r.level) for r in M.headings(rows).collect()] == [("deep", 3)]
    assert {r.thread for r in M.comment_threads(rows).collect()} == {"1|P0"}


def test_features_have_their_codes(spark):
    v, c, d, g = "urn:schemas-microsoft-com:vml", "http://schemas.openxmlformats.org/drawingml/2006/chart", "http://schemas.openxmlformats.org/drawingml/2006/diagram", "http://schemas.microsoft.com/office/word/2010/wordprocessingGroup"
    shape = "http://schemas.microsoft.com/office/word/2010/wordprocessingShape"
    body = f"<w:p><w:ins/><w:hyperlink r:id='none'/><w:hyperlink r:id='rId1'/><w:hyperlink r:id='rId2'/><w:hyperlink w:anchor='no'/><w:hyperlink w:anchor='b'/><w:bookmarkStart w:name='b'/><w:bookmarkStart w:name='b'/><w:fldSimple/><w:commentReference/><w:sdt/><wp:anchor/><x:chart xmlns:x='{c}'/><x:any xmlns:x='{d}'/><m:oMath/><x:wsp xmlns:x='{shape}'/><w:altChunk/><a:blip r:link='x'/><x:shape xmlns:x='{v}'/><x:wgp xmlns:x='{g}'/><w:object/><w:pPr><w:sectPr/><w:pPrChange><w:pPr><w:numPr/></w:pPr></w:pPrChange></w:pPr></w:p>"
    lists = f"<w:numbering {W}><w:numPicBullet/><w:abstractNum><w:lvl><w:numFmt w:val='chicago'/></w:lvl></w:abstractNum></w:numbering>"
    rels = f'<Relationship Id="rId1" Type="{REL}/hyperlink" Target="ftp://x" TargetMode="External"/><Relationship Id="rId2" Type="{REL}/hyperlink" Target="other.xml"/><Relationship Id="rId3" Type="{REL}/image" Target="http://x/i.png" TargetMode="External"/>'
    got = {r.code: r.n for r in M.feature_warnings(made(spark, body, {"word/numbering.xml": lists, "word/other.xml": "<x/>"}, rels)).collect()}
    assert got == {code: {"W1001": 2, "W1002": 5, "W1005": 2}.get(code, 1) for code in M.FEATURES}


def test_rules_have_their_codes(spark):
    body = (
        "<w:p><w:commentRangeStart w:id='9'/><w:commentRangeEnd w:id='9'/><w:r><w:drawing><wp:inline><wp:extent cx='0' cy='1'/><wp:docPr id='4'/><wp:docPr id='4'/><pic:blipFill><a:blip r:embed='rId8'/><a:srcRect l='60000' r='50000'/></pic:blipFill><a:blip r:embed='rId1'/></wp:inline></w:drawing></w:r><w:moveFrom><w:r><w:delText>x</w:delText></w:r></w:moveFrom></w:p>"
        "<w:tbl/><w:sdt><w:sdtPr><w:id w:val='x'/><w:lock w:val='odd'/><w:tag w:val='t'/></w:sdtPr></w:sdt><w:sdt><w:sdtPr><w:tag w:val='t'/></w:sdtPr></w:sdt><w:p><w:pPr><w:pStyle w:val='Nope'/><w:numPr><w:numId w:val='77'/></w:numPr></w:pPr></w:p>"
        "<w:sectPr><w:headerReference r:id='rId1'/><w:cols w:num='0'/><w:pgSz w:orient='odd'/></w:sectPr>"
    )
    extra = {"word/styles.xml": f"<w:styles {W}/>", "word/numbering.xml": f"<w:numbering {W}><w:num w:numId='1'><w:abstractNumId w:val='3'/></w:num></w:numbering>", "word/settings.xml": f"<w:settings {W}><w:updateFields w:val='odd'/></w:settings>", "word/header1.xml": f"<w:ftr {W}/>", "word/comments.xml": f"<w:comments {W}><w:comment w:id='1'><w:p w14:paraId='A'/></w:comment><w:comment w:id='1'><w:p/></w:comment></w:comments>", "word/ex.xml": f"<w15:commentsEx {W}><w15:commentEx w15:paraId='A' w15:paraIdParent='A'/><w15:commentEx w15:paraId='B'/></w15:commentsEx>", "word/ids.xml": f"<w16cid:commentsIds {W}><w16cid:commentId w16cid:paraId='A'/></w16cid:commentsIds>"}
    rels = f'<Relationship Id="rId1" Type="{REL}/styles" Target="styles.xml"/><Relationship Id="rId2" Type="{REL}/header" Target="header1.xml"/>'
    got = {(r.code, r.target) for r in R.validate(made(spark, body, extra, rels)).collect()}
    assert {("E9102", "w:ftr"), ("E9105", "rId8"), ("E9113", "rId1"), ("E9107", "4"), ("E9115", "x"), ("E9115", "odd"), ("E9118", "odd"), ("E9119", "rId1"), ("E9120", "0"), ("E9120", "odd"), ("W9109", "t"), ("W9116", "Nope"), ("W9117", "77"), ("W9117", "3"), ("E9111", "9"), ("E9111", "1"), ("E9108", "A"), ("E9108", "B")} <= got
    assert {"E9106", "E9109", "E9110", "E9121", "E9122"} <= {c for c, _ in got}


def test_one_relation_of_paragraphs_context_and_selectors(rows):
    got = {r.wire: (r.style_id, r.heading, r.label, r.text) for r in M.paragraphs(rows).where("doc_id = 1").collect()}
    assert got["M.P0001"] == ("Sub", 2, None, "Head") and got["M.P0004"][2:] == ("III.", "i")
    assert [(r.offset, r.wire) for r in M.context(rows, ["M.P0002"]).where("doc_id = 1").orderBy("offset").collect()] == [(-1, "M.P0001"), (0, "M.P0002"), (1, "M.P0003")]
    assert {r.doc_id: (r.code, r.place) for r in M.select_heading(rows, "Head").collect()} == {1: ("ok", "M.P0001"), 2: ("E1201", None)}
    assert {r.doc_id: r.code for r in M.select_control(rows, "out").collect()} == {1: "ok", 2: "E1201"} and {r.doc_id: r.code for r in M.select_bookmark(rows, "x").collect()} == {1: "E1201", 2: "E1201"}
    assert {r.doc_id: r.parts for r in M.package_sizes(rows).collect()} == {1: 9, 2: 4}

"""Shredding, relations, rules and the way back, on packages made here."""

from __future__ import annotations

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.plans import packages as P
from paperloom.plans import rules as R
from paperloom.sources.packages import PREFIXES, Refused, package_rows, read_packages, resolve, safe_name, save, shred, shredded
from paperloom.streaming import watch_packages

#: The namespaces of the formats, as the library has them.
W = " ".join(f'xmlns:{prefix}="{uri}"' for uri, prefix in PREFIXES.items())
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: The content types of a minimal package.
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """Plans of many steps over a handful of rows: one partition, nothing compiled, nothing planned anew."""
    quick = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def package(body: str, rels: str = "", extra: dict[str, bytes | str] | None = None) -> bytes:
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("_rels/.rels", f'<Relationships {ns}><Relationship Id="rId1" Type="{REL}/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f"<Relationships {ns}>{rels}</Relationships>")
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


BODY = (
    p("One")
    + "<w:del w:id='7' w:author='Ann' w:date='2024-01-02T03:04:05Z'>" + p("Gone") + "</w:del>"
    + "<w:p><w:bookmarkStart w:id='1' w:name='mark'/><w:r><w:t>Two</w:t><w:tab/></w:r><w:ins w:id='8' w:author='Bob'><w:r><w:t>new</w:t></w:r></w:ins><w:bookmarkEnd w:id='1'/><w:hyperlink w:anchor='mark'><w:r><w:t>!</w:t></w:r></w:hyperlink><w:hyperlink r:id='rId9'/></w:p>"
    + "<w:tbl><w:tr><w:trPr><w:gridBefore w:val='1'/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"
    + "<w:p><w:r><w:drawing><wp:anchor behindDoc='1'><wp:extent cx='914400' cy='360000'/><wp:wrapSquare/><wp:docPr id='1' name='Pic' descr='alt'/><pic:blipFill><a:blip r:embed='rId5'/><a:srcRect l='25000' t='10%'/></pic:blipFill></wp:anchor></w:drawing></w:r></w:p>"
)


@pytest.fixture(scope="module")
def rows(spark):
    good = package(BODY, f'<Relationship Id="rId5" Type="{REL}/image" Target="media/i.png"/><Relationship Id="rId6" Type="{REL}/header" Target="header1.xml"/>', {"word/media/i.png": b"png", "word/header1.xml": f"<w:hdr {W}>{p('Head')}</w:hdr>"})
    bad = package("<w:p><w:bookmarkStart w:id='3' w:name='x'/><w:pPr><w:pStyle w:val='Nope'/></w:pPr><w:r><w:fldChar w:fldCharType='begin'/></w:r></w:p>", f'<Relationship Id="rId1" Type="{REL}/image" Target="media/none.png"/>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("word/document.xml", '<!DOCTYPE x [<!ENTITY e "boom">]><x>&e;</x>')
    docs = [(1, bytearray(good)), (2, bytearray(bad)), (3, bytearray(b"no zip")), (4, bytearray(out.getvalue())), (5, None)]
    return shredded(spark.createDataFrame(docs, "doc_id long, content binary"))


def test_blocks_keep_physical_ordinals(rows):
    got = {r.wire: r.text for r in P.blocks(rows).where("doc_id = 1").collect()}
    assert got == {"M.P0001": "One", "M.P0003": "Two\tnew!", "M.P0004": "", "M.T0001": "", "H001.P0001": "Head"}
    markup = {r.wire: r.text for r in P.blocks(rows, "markup").where("doc_id = 1 and story = 'M' and kind = 'paragraph'").collect()}
    assert markup["M.P0002"] == "[-Gone-]" and markup["M.P0003"] == "Two\t[+new+]!"


def test_cells_have_visual_columns(rows):
    assert [(r.wire, r.text) for r in P.cells(rows).orderBy("column").collect()] == [("M.T0001.R01.C02", "a"), ("M.T0001.R01.C04", "b")]


def test_changes_links_images_bookmarks(rows):
    assert [(r.kind, r.author) for r in P.changes(rows).where("doc_id = 1").orderBy("ord").collect()] == [("deleted-run", "Ann"), ("inserted-run", "Bob")]
    assert [(r.broken, r.anchors) for r in P.hyperlinks(rows).where("doc_id = 1").orderBy("node_id").collect()] == [(False, 1), (True, 0)]
    got = P.images(rows).collect()
    assert [(r.media, r.size, r.layout, r.width, r.height, r.alt, r.wrap, r.behind, float(r.crop_l), float(r.crop_t), r.crop_r) for r in got] == [("/word/media/i.png", 3, "anchor", 914400, 360000, "alt", "wrapSquare", True, 25.0, 10.0, None)]
    assert [(r.bookmark, r.complete) for r in P.bookmarks(rows).where("doc_id = 1").collect()] == [("mark", True)]


def test_rules(rows):
    got = {(r.doc_id, r.code) for r in R.validate(rows).collect()}
    assert {(2, "E9103"), (2, "E9104"), (2, "E0007"), (3, "E0001"), (4, "E0006"), (5, "E0001"), (1, "W1015")} <= got
    assert {c for d, c in got if d == 1 and c.startswith("E")} == {"E9121"}  # Bob's insertion has no date


def test_relations_of_written_rows_open_no_package(rows):
    for relation in (R.validate, P.cells, P.changes):
        assert "MapInPandas" not in relation(rows)._jdf.queryExecution().toString()


def test_round_trip(rows):
    again = shred(save(P.parts(rows).where("doc_id = 1")))
    columns = ["doc_id", "part", "bytes"]
    assert sorted(P.parts(again).select(columns).collect()) == sorted(P.parts(rows).where("doc_id = 1").select(columns).collect())


def test_names_and_targets():
    assert safe_name("word/a.xml") == "/word/a.xml"
    for name in ("", "/a", "a/../b", "c:\\x", "a//b"):
        with pytest.raises(Refused):
            safe_name(name)
    assert resolve("/word/document.xml", "../media/x.png") == "/media/x.png"
    with pytest.raises(Refused):
        resolve("/word/document.xml", "../../x")


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(package(p("Hi")))
    assert read_packages(spark, str(tmp_path / "in")).count() == 1
    for _ in range(2):  # a second run finds nothing new
        watch_packages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert [r.text for r in P.blocks(rows).collect()] == ["Hi"]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 400), st.binary(max_size=6))
def test_damaged_packages_say_so(noise, at, patch):
    whole = package(p("text"), extra={"word/x.xml": "<x/>" * 1})
    assert any(r["kind"] == "node" for r in package_rows(1, whole))
    for data in (noise, whole[:at], whole[:at] + patch + whole[at + len(patch) :], whole + noise):
        assert all(r["kind"] in ("part", "rel", "node", "diag") for r in package_rows(None, data))


def test_unknown_methods_and_locked_entries_are_refused():
    whole = package(p("text"))
    for offset, value in ((8, 99), (6, 1)):  # in the local header; in the directory two bytes further
        data = bytearray(whole)
        at = -1
        while (at := data.find(b"PK\x03\x04", at + 1)) >= 0:
            data[at + offset] = value
        at = -1
        while (at := data.find(b"PK\x01\x02", at + 1)) >= 0:
            data[at + offset + 2] = value
        assert [r["name"] for r in package_rows(1, bytes(data))] == ["E0001"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<x>" + "y" * 5000 + "</x>")
    data = bytearray(out.getvalue())
    data[60:70] = b"\xff" * 10
    assert [r["name"] for r in package_rows(1, bytes(data))] == ["E0001"]


def test_a_large_part_is_streamed():
    """What a task holds of a part of 12 MB is its bytes, for their own row, and batches: no list of its elements."""
    import tracemalloc

    from paperloom.sources.packages import BATCH, package_batches

    data = package("<w:p><w:r><w:t>some words</w:t></w:r></w:p>" * 280_000)
    tracemalloc.start()
    rows, most = 0, 0
    for batch in package_batches(1, data):
        rows, most = rows + batch.num_rows, max(most, batch.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 3 * 280_000 and most <= BATCH and peak < 60 << 20


def test_kinds_that_are_not_asked_for_are_not_made(spark):
    one, bad = package(p("x"), f'<Relationship Id="rId1" Type="{REL}/image" Target="a.png"/>'), package("<w:p>")
    rows = spark.createDataFrame([(1, bytearray(one)), (2, bytearray(bad)), (None, None)], "doc_id long, content binary")
    got = [(r.doc_id, r.kind, r.name) for r in shred(rows, ["rel"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "rel", "rId1"), (1, "rel", "rId1"), (2, "diag", "E0001"), (None, "diag", "E0001")], key=str)


def test_declared_sizes_are_checked_while_streaming():
    data = bytearray(package(p("x" * 5000)))
    at = data.rfind(b"PK\x01\x02", 0, data.rfind(b"word/document.xml"))
    data[at + 24 : at + 28] = (10).to_bytes(4, "little")  # the directory says that the part is shorter
    assert [r["name"] for r in package_rows(1, bytes(data))][0] in ("E0001", "E0002")

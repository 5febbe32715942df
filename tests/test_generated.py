"""Relations of generated packages against plain readings of the same markup, one element after the other."""

from __future__ import annotations

import random
import re
from collections import Counter
from xml.etree import ElementTree as ET

import pytest

from paperloom.operators.package_edits import replaced
from paperloom.plans import model as M
from paperloom.plans import packages as P
from paperloom.sources.packages import PREFIXES, Refused, parse, shredded
from tests.test_packages import REL, W, package, small_plans  # noqa: F401

NS = {prefix: uri for uri, prefix in PREFIXES.items()}
w = lambda name: f"{{{NS['w']}}}{name}"


def val(element, path):
    found = element.find("/".join(w(x) for x in path.split("/"))) if element is not None else None
    return None if found is None else found.get(w("val"))


def whole(text):
    return int(text) if text is not None and re.fullmatch("-?[0-9]+", text) else None


# --- List labels -------------------------------------------------------------------------------

FORMS = ["decimal", "decimalZero", "upperLetter", "lowerLetter", "upperRoman", "lowerRoman", "bullet", "none", "chicago", " ", None]
PATTERNS = ["%1.", "%1.%2", "%2)", "(%3/%1)", "%%1", "%01", "%0", "%12", "50%", "• ", "%1%2%3", "", " ", None, "%9x"]


def numbering(rng):
    level = lambda k: f"<w:lvl w:ilvl='{k}'>" + (f"<w:start w:val='{rng.choice([0, 1, 1, 5, 3998, 'x'])}'/>" if rng.random() < 0.7 else "") + "".join(f"<w:{tag} w:val='{v}'/>" for tag, v in (("numFmt", rng.choice(FORMS)), ("lvlText", rng.choice(PATTERNS))) if v is not None) + ("<w:isLgl/>" if rng.random() < 0.2 else "") + "</w:lvl>"
    abstract = "".join(f"<w:abstractNum w:abstractNumId='{a}'>{''.join(level(k) for k in range(4) if rng.random() < 0.9)}</w:abstractNum>" for a in range(2))
    over = lambda k: f"<w:lvlOverride w:ilvl='{k}'>" + (f"<w:startOverride w:val='{rng.randint(0, 9)}'/>" if rng.random() < 0.6 else "") + (level(k) if rng.random() < 0.4 else "") + "</w:lvlOverride>"
    nums = "".join(f"<w:num w:numId='{n}'><w:abstractNumId w:val='{n % 2}'/>{''.join(over(k) for k in range(4) if rng.random() < 0.4)}</w:num>" for n in range(1, 5))
    return f"<w:numbering {W}>{abstract}{nums}</w:numbering>"


def labelled(rng, n):
    item = lambda: f"<w:p><w:pPr><w:numPr><w:ilvl w:val='{rng.choice([0, 0, 1, 1, 2, 3])}'/><w:numId w:val='{rng.choice([1, 2, 3, 4, 7])}'/></w:numPr></w:pPr></w:p>"
    return "".join(f"<w:del>{item()}</w:del>" if rng.random() < 0.1 else f"<w:ins>{item()}</w:ins>" if rng.random() < 0.1 else item() for _ in range(n))


def roman(n):
    if not 0 < n < 4000:
        return None
    digit = lambda d, one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten][d]
    return "M" * (n // 1000) + digit(n // 100 % 10, "C", "D", "M") + digit(n // 10 % 10, "X", "L", "C") + digit(n % 10, "I", "V", "X")


def alphabet(n):
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out or None


def labels(body, lists, view):
    """The labels of a body's paragraphs that the view shows: counters by list, start values, resets and tokens as the format has them."""
    root = ET.fromstring(lists)
    define = lambda e: {"form": val(e, "numFmt"), "text": val(e, "lvlText"), "start": whole(val(e, "start")), "legal": e.find(w("isLgl")) is not None}
    levels = {(a.get(w("abstractNumId")), int(e.get(w("ilvl")))): define(e) for a in root.iter(w("abstractNum")) for e in a.findall(w("lvl"))}
    nums, over = {}, {}
    for n in root.findall(w("num")):
        nums[n.get(w("numId"))] = val(n, "abstractNumId")
        for o in n.findall(w("lvlOverride")):
            over[n.get(w("numId")), int(o.get(w("ilvl")))] = (whole(val(o, "startOverride")), define(o.find(w("lvl"))) if o.find(w("lvl")) is not None else None)

    def resolve(num, level):
        start, own = over.get((num, level), (None, None))
        d = dict(own or levels.get((nums.get(num), level)) or {"form": None, "text": None, "start": None, "legal": False})
        d["start"] = start if start is not None else d["start"]
        return d

    out, counters = [], {}
    for block in ET.fromstring(f"<w:body {W}>{body}</w:body>"):
        hidden = block.tag == {"final": w("del"), "original": w("ins")}[view]
        p = block if block.tag == w("p") else block[0]
        if hidden:
            continue
        num, level = val(p, "pPr/numPr/numId"), int(val(p, "pPr/numPr/ilvl"))
        d, c = resolve(num, level), counters.setdefault(num, {})
        c[level] = c[level] + 1 if level in c else d["start"] if d["start"] is not None else 1
        for k in [k for k in c if k > level]:
            del c[k]
        if not (d["form"] or "").strip() or not (d["text"] or "").strip():
            out.append(None)
            continue

        def token(m, num=num, d=d, c=c):
            k = int(m[1]) - 1
            if k not in c:
                return m[0]
            form, n = "decimal" if d["legal"] else resolve(num, k)["form"], c[k]
            shown = {"decimal": str(n), "decimalZero": f"0{n}" if 0 <= n < 10 else str(n), "upperLetter": alphabet(n), "lowerLetter": (alphabet(n) or "").lower() or None, "upperRoman": roman(n), "lowerRoman": (roman(n) or "").lower() or None}.get(form)
            return m[0] if shown is None else shown

        out.append("" if d["form"] == "none" else d["text"] if d["form"] == "bullet" else re.sub("%([0-9]+)", token, d["text"]))
    return out


def test_list_labels(spark):
    rng = random.Random(11)
    made = [(k, labelled(rng, 60), numbering(rng)) for k in range(12)]
    rows = shredded(spark.createDataFrame([(k, bytearray(package(body, "", {"word/numbering.xml": lists}))) for k, body, lists in made], "doc_id long, content binary"))
    for view in ("final", "original"):
        got: dict[int, list] = {}
        for r in M.list_labels(rows, view=view).orderBy("doc_id", "wire").collect():
            got.setdefault(r.doc_id, []).append(r.label)
        assert got == {k: labels(body, lists, view) for k, body, lists in made}
    assert sum(x is not None for k, b, n in made for x in labels(b, n, "final")) > 300


# --- Summaries of changes and threads ----------------------------------------------------------


def test_change_and_thread_summaries(spark):
    body = "<w:p><w:ins w:id='1' w:author='Ann'><w:r><w:t>x</w:t></w:r></w:ins><w:commentRangeStart w:id='0'/><w:r><w:t>y</w:t></w:r><w:commentRangeEnd w:id='0'/></w:p><w:p><w:del w:id='2' w:author=' '/></w:p>"
    extra = {"word/comments.xml": f"<w:comments {W}><w:comment w:id='0' w:author='Bob'><w:p/></w:comment></w:comments>", "word/header1.xml": f"<w:hdr {W}><w:p><w:ins w:id='3' w:author='Ann'/></w:p></w:hdr>", "word/loose.xml": f"<w:x {W}><w:ins w:id='4'/></w:x>"}
    rels = f'<Relationship Id="rId1" Type="{REL}/header" Target="header1.xml"/><Relationship Id="rId2" Type="{REL}/comments" Target="comments.xml"/>'
    rows = shredded(spark.createDataFrame([(1, bytearray(package(body, rels, extra)))], "doc_id long, content binary"))
    got = {(r.dimension, r.key, r.kind): r.n for r in M.change_summary(rows).collect()}
    main, head, notes, loose = ("main", "/word/document.xml"), ("header[1]", "/word/header1.xml"), ("comments[1]", "/word/comments.xml"), ("part:/word/loose.xml", "/word/loose.xml")
    facts = [(*main, "Ann", "M.P0001", "inserted-run"), (*main, "Bob", "M.P0001", "comment-range-start"), (*main, "Bob", "M.P0001", "comment-range-end"), (*main, "(none)", "M.P0002", "deleted-run"), (*head, "Ann", "H001.P0001", "inserted-run"), (*notes, "Bob", "M.P0001", "comment"), (*loose, "(none)", "(none)", "inserted-run")]
    want = Counter((d, f[i], f[4]) for f in facts for i, d in enumerate(["story", "part", "author", "target"]))
    assert got == want
    assert {(r.target, r.kind): (r.n, r.total) for r in M.target_summary(rows).collect() if r.target == "M.P0001"} == {("M.P0001", k): (1, 4) for k in ("inserted-run", "comment", "comment-range-start", "comment-range-end")}
    assert {(r.kind, r.n, r.total, r.anchor, r.author, r.is_reply) for r in M.thread_summary(rows).collect()} == {(k, 1, 3, "M.P0001", "Bob", False) for k in ("comment", "comment-range-start", "comment-range-end")}


# --- Selectors ---------------------------------------------------------------------------------


def test_selectors_of_the_main_story_and_their_candidates(spark):
    head = lambda text, level=0: f"<w:p><w:pPr><w:outlineLvl w:val='{level}'/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    control = lambda inner: f"<w:p><w:sdt><w:sdtPr>{inner}</w:sdtPr><w:sdtContent><w:r><w:t>in control</w:t></w:r></w:sdtContent></w:sdt></w:p>"
    body = head("Scope  of work") + head("Work plan", 1) + head("Work plan") + "<w:p><w:r><w:t>the plan of work</w:t></w:r><w:r><w:txbx><w:p><w:bookmarkStart w:id='1' w:name='deep'/></w:p></w:txbx></w:r></w:p>" + control("<w:tag w:val='a'/>") + control("<w:alias w:val='a'/>") + control("<w:alias w:val='b'/><w:tag w:val='b'/>") + "<w:sdt><w:sdtPr><w:tag w:val='outer'/></w:sdtPr><w:sdtContent><w:p/></w:sdtContent></w:sdt>"
    header = {"word/header1.xml": f"<w:hdr {W}>{head('Only above')}</w:hdr>"}
    rels = f'<Relationship Id="rId1" Type="{REL}/header" Target="header1.xml"/>'
    rows = shredded(spark.createDataFrame([(1, bytearray(package(body, rels, header))), (2, bytearray(package(head("Scope of work")))), (None, bytearray(package(head("x")))), (None, b"")], "doc_id long, content binary"))
    got = lambda df: {r.doc_id: (r.code, r.place, r.candidates) for r in df.collect()}
    assert got(M.select_heading(rows, "Scope of  work")) == {1: ("ok", "M.P0001", []), 2: ("ok", "M.P0001", []), None: (None, None, [])}
    assert got(M.select_heading(rows, "Work plan"))[1] == ("E1202", None, ["M.P0002", "M.P0003"])
    assert got(M.select_heading(rows, "Work plan", 2)) == {1: ("ok", "M.P0002", []), 2: ("E1201", None, ["M.P0001"]), None: (None, None, [])}
    assert got(M.select_heading(rows, "Only above"))[1] == ("E1201", None, ["M.P0001", "M.P0002", "M.P0003"])
    assert got(M.select_heading(rows, "work PLAN of"))[1] == ("E1201", None, ["M.P0001", "M.P0002", "M.P0003"])
    assert got(M.select_text(rows, "plan of"))[1] == ("ok", "M.P0004", []) and got(M.select_text(rows, "of work"))[2][:2] == ("ok", "M.P0001")
    assert got(M.select_text(rows, "plan of the"))[1] == ("E1201", None, ["M.P0004", "M.P0001", "M.P0002"])
    assert got(M.select_bookmark(rows, "deep")) == {1: ("ok", "M.P0004", []), 2: ("E1201", None, ["M.P0001"]), None: (None, None, [])}
    assert got(M.select_control(rows, "a"))[1] == ("E1202", None, ["M.P0005", "M.P0006"]) and got(M.select_control(rows, "b"))[1] == ("ok", "M.P0007", [])
    assert got(M.select_control(rows, "outer"))[1][0] == "E1201"


# --- Writing back ------------------------------------------------------------------------------


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "utf-16-be", "iso-8859-1"])
def test_write_back_keeps_every_other_byte(encoding):
    named = "utf-16" if encoding.startswith("utf-16") else encoding
    mark = "﻿" if encoding == "utf-16-be" else ""
    xml = lambda a, b, c="": f'{mark}<?xml version="1.0" encoding="{named}"?>\r\n<w:p {W}><!-- > --><w:t w:x="a>b"\n  >{a}</w:t ><w:t xml:space="preserve">{b}</w:t>{c or "<w:t w:y=\'/>\' />"}é<![CDATA[>]]></w:p>'
    old = xml("old &amp; <!-- x -->", "two").encode(encoding)
    assert replaced(old, {}) == old
    assert replaced(old, {1: "new", 2: " b "}) == xml("new", " b ").encode(encoding)
    spaced = replaced(old, {1: " <n> ", 3: "€"}).decode(encoding)
    assert "<w:t w:x=\"a>b\"\n   xml:space=\"preserve\"> &lt;n&gt; </w:t >" in spaced
    texts = [n["text"] for n in parse(replaced(old, {1: " <n> ", 3: "€"}))]
    assert texts[1:] == [" <n> ", "two", "€"] and texts[0] == "é>"


def test_write_back_refuses_document_types():
    with pytest.raises(Refused):
        replaced(b"<!DOCTYPE a []><a>x</a>", {0: "y"})


def test_write_back_of_random_parts():
    rng = random.Random(2)
    for _ in range(200):
        pieces = [rng.choice(["<w:t>{}</w:t>", "<w:t a='>'>{}</w:t>", "<w:r/>{}", "<!-- < -->{}", "<w:t/>", "<w:b><w:t\t>{}</w:t></w:b>"]).format(rng.choice(["", "x", "&lt;", "é "])) for _ in range(rng.randint(0, 9))]
        data = f"<w:p {W}>{''.join(pieces)}</w:p>".encode()
        before = parse(data)
        edits = {n["node_id"]: rng.choice(["", "y", " z", "<&>"]) for n in before if n["name"] == "w:t" and rng.random() < 0.5}
        after = parse(replaced(data, edits))
        assert [(n["name"], edits.get(n["node_id"], n["text"])) for n in before] == [(n["name"], n["text"]) for n in after]

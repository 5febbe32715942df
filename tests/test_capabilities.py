"""The table of capabilities against a plain reading of random paragraphs."""

from __future__ import annotations

import random
from xml.etree import ElementTree as ET

import pytest

from paperloom.plans import capabilities as C
from paperloom.sources.packages import shredded
from tests.test_offsets import content, name
from tests.test_packages import W, package, small_plans  # noqa: F401


def story(rng):
    formats = ["", "<w:rPr><w:b/></w:rPr>", "<w:rPr><w:b w:val='1' w:x='2'/></w:rPr>", "<w:rPr><w:b w:x='2' w:val='1'/></w:rPr>", "<w:rPr/>"]
    run = lambda: f"<w:r>{rng.choice(formats[: rng.choice([1, 5])])}{rng.choice(['<w:t>a</w:t>', '<w:t>b</w:t>', '<w:tab/>', '<w:sym/>', ''])}</w:r>"
    para = lambda: "<w:p>" + ("<w:pPr><w:sectPr/></w:pPr>" if rng.random() < 0.1 else "") + "".join(content(rng) if rng.random() < 0.15 else run() for _ in range(rng.randint(0, 3))) + "</w:p>"
    paras = [para() for _ in range(10)]
    field = "<w:r><w:fldChar w:fldCharType='{}'/></w:r>"
    pairs = [("<w:bookmarkStart w:id='x'/>", "<w:bookmarkEnd w:id='x'/>"), ("<w:commentRangeStart w:id='y'/>", "<w:commentRangeEnd w:id='y'/>"), (field.format("begin"), field.format("end"))]
    for start, end in rng.sample(pairs, rng.randint(0, 3)):  # ends in one paragraph, or in two
        a, b = sorted(rng.choices(range(10), k=2))
        paras[b] = paras[b].removesuffix("</w:p>") + end + "</w:p>"
        paras[a] = "<w:p>" + start + paras[a].removeprefix("<w:p>")
    return "".join(paras)


def reading(markup, mode):
    body = ET.fromstring(f"<w:body {W}>{markup}</w:body>")
    every = list(body.iter())
    count = lambda tag, key, within=None: sum(e.tag == name(tag) and e.get(name("w:id")) == key for e in (every if within is None else within.iter()))
    fields = lambda root: sum({"begin": 1, "end": -1}.get(e.get(name("w:fldCharType")), 0) for e in root.iter(name("w:fldChar")))
    out = {}
    for k, p in enumerate(body.findall(name("w:p"))):
        inner, up = [e for e in p.iter() if e is not p], {c: x for x in p.iter() for c in x}
        gone = lambda e: any(a in (name("w:del"), name("w:moveFrom")) for a in (x.tag for x in above(e)))  # noqa: B023, E731

        def above(e, up=up):
            while e in up:
                e = up[e]
                yield e

        runs = p.findall(name("w:r"))
        facts = {"any": ""}
        protected = [C.PROTECTED[q] for e in inner for q in C.PROTECTED if e.tag == name(q)]
        odd = [c.tag.split("}")[1] for r in runs for c in r if c.tag not in [name(x) for x in C.PLAIN]]
        sign = lambda e: None if e is None else (e.tag, sorted(e.attrib.items()), [sign(c) for c in e])  # noqa: B023, E731
        signs = [repr(sign(r.find(name("w:rPr")))) for r in runs if any(c.tag in (name("w:t"), name("w:tab"), name("w:br")) for c in r)]
        facts |= {"protected": protected[0]} if protected else {}
        facts |= {"run-content": odd[0]} if odd else {}
        facts |= {"mixed-formats": "mixed"} if len(set(signs)) > 1 else {}
        facts |= {"section": "section"} if p.find(f"{name('w:pPr')}/{name('w:sectPr')}") is not None else {}
        facts |= {"breaks": "breaks"} if any(e.tag in (name("w:tab"), name("w:br")) and not gone(e) for e in inner) else {}
        for label, tags in (("bookmark", ("w:bookmarkStart", "w:bookmarkEnd")), ("comment range", ("w:commentRangeStart", "w:commentRangeEnd"))):
            for own, other in (tags, tags[::-1]):
                for e in inner:
                    key = e.get(name("w:id"))
                    if e.tag == name(own) and key and key.strip() and count(own, key) == count(other, key) == 1 and not count(other, key, p):
                        facts.setdefault("orphan", f"{label} {key}")
        if fields(body) == 0 and fields(p):
            facts.setdefault("orphan", "complex field boundary")
        for operation in C.DECISIONS:
            rules = sorted((d for d in C.decisions() if d[0] == operation and d[1] == mode and d[3] in facts), key=lambda d: d[2])
            out[f"M.P{k + 1:04}", operation] = (rules[0][4], rules[0][3], facts[rules[0][3]] or None)
    return out


@pytest.mark.parametrize("mode", ["off", "require"])
def test_capabilities(spark, mode):
    rng = random.Random(6)
    markup = {k: story(rng) for k in range(25)}
    rows = shredded(spark.createDataFrame([(k, bytearray(package(m))) for k, m in markup.items()], "doc_id long, content binary"))
    got = {(r.doc_id, r.wire, r.operation): (r.verdict, r.reason, r.detail) for r in C.capabilities(rows, mode).collect()}
    want = {(k, *key): v for k, m in markup.items() for key, v in reading(m, mode).items()}
    assert got == want and {v[1] for v in want.values()} >= {"protected", "orphan", "breaks", "any", "section"} | ({"run-content", "mixed-formats"} if mode == "require" else set())

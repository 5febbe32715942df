"""Offsets, matches across runs, protection and bookmark texts against plain readings of random paragraphs."""

from __future__ import annotations

import random
from xml.etree import ElementTree as ET

import pytest

from paperloom.operators.package_edits import apply_texts
from paperloom.plans import offsets as O
from paperloom.plans.packages import blocks
from paperloom.sources.packages import PREFIXES, save, shred, shredded
from tests.test_packages import W, package, small_plans  # noqa: F401

NS = {prefix: uri for uri, prefix in PREFIXES.items()}
name = lambda qualified: "{%s}%s" % (NS[qualified.split(":")[0]], qualified.split(":")[1])
CONTAINER = {name(k): v for k, v in O.CONTAINERS.items()}
START, END = ({name(k + side): v for k, v in O.RANGES.items()} for side in ("Start", "End"))
FLD, ID, KIND, TEXTS = name("w:fldChar"), name("w:id"), name("w:fldCharType"), {name("w:t"): None, name("w:tab"): "\t", name("w:br"): "\n"}


def run(rng):
    return "<w:r>" + "".join(rng.choice([f"<w:t>{rng.choice(['ab', 'a', 'b', 'bab', 'aab ', 'c'])}</w:t>"] * 6 + ["<w:tab/>", "<w:br/>", "<w:t/>"]) for _ in range(rng.randint(0, 3))) + "</w:r>"


def content(rng, depth=0):
    kinds = ["run"] * 6 + (["box"] * 2 if depth < 2 else []) + ["range", "field", "math"]
    kind = rng.choice(kinds)
    if kind == "run":
        return run(rng)
    if kind == "math":
        return "<m:oMath><m:r><m:t>x</m:t></m:r></m:oMath>"
    if kind == "range":
        base = rng.choice(["w:bookmark", "w:commentRange", "w:customXmlInsRange"])
        return f"<{base}{rng.choice(['Start', 'End'])} w:id='{rng.randint(0, 5)}'/>"
    if kind == "field":
        return f"<w:r><w:fldChar w:fldCharType='{rng.choice(['begin', 'separate', 'end'])}'/></w:r>"
    box = rng.choice(["w:ins", "w:del", "w:hyperlink", "w:sdt", "w:smartTag", "w:moveFrom"])
    return f"<{box}>{''.join(content(rng, depth + 1) for _ in range(rng.randint(0, 3)))}</{box}>"


def body(rng):
    between = lambda: f"<w:bookmark{rng.choice(['Start', 'End'])} w:id='{rng.randint(0, 5)}'/>" if rng.random() < 0.15 else ""
    return "".join(between() + "<w:p>" + "".join(content(rng) for _ in range(rng.randint(0, 7))) + "</w:p>" for _ in range(8))


class Reading:
    """The story as the format's rules have it: one walk for all that is open, one for each paragraph."""

    def __init__(self, markup):
        self.root = ET.fromstring(f"<w:document {W}><w:body>{markup}</w:body></w:document>")
        self.up = {c: p for p in self.root.iter() for c in p}
        self.order = list(self.root.iter())
        self.ranges, self.fields = [], []
        for e in self.order:
            if e.tag in START or e.tag in END:
                if e.get(ID) is not None:
                    self.ranges.append(((START.get(e.tag) or END.get(e.tag), e.get(ID)), 1 if e.tag in START else -1, e))
            elif e.tag == FLD and e.get(KIND) in ("begin", "end"):
                self.fields.append((1 if e.get(KIND) == "begin" else -1, e))

    def hidden(self, e):
        return any(a.tag in (name("w:del"), name("w:moveFrom")) for a in self.above(e))

    def above(self, e):
        while e in self.up:
            e = self.up[e]
            yield e

    def entering(self, p):
        at, now, depth = self.order.index(p), {}, 0
        for key, step, e in self.ranges:
            if self.order.index(e) < at and not self.hidden(e):
                now[key] = max(0, now.get(key, 0) + step)
        for step, e in self.fields:
            if self.order.index(e) < at and not self.hidden(e):
                depth = max(0, depth + step)
        once = lambda key: sorted(s for k, s, _ in self.ranges if k == key) == [-1, 1]
        return {k: v for k, v in now.items() if v and once(k)}, depth if sum(s for s, _ in self.fields) == 0 else 0

    def paragraph(self, p):
        """``(text, characters, intervals, equations)``: each character with its element, place, and whether it may be edited; protected intervals as (start, end)."""
        chars, spans, equations = [], [], []
        opened, depth = self.entering(p)
        queue, stack = {k: [0] * v for k, v in opened.items()}, [0] * depth
        for e in p.iter():
            if e is p or self.hidden(e):
                continue
            if e.tag == name("m:oMath"):
                equations.append(len(chars))
            elif e.tag in START and e.get(ID) is not None:
                queue.setdefault((START[e.tag], e.get(ID)), []).append(len(chars))
            elif e.tag in END and e.get(ID) is not None:
                q = queue.get((END[e.tag], e.get(ID)))
                spans.append((q.pop(0) if q else 0, len(chars)))
            elif e.tag == FLD and e.get(KIND) == "begin":
                stack.append(len(chars))
            elif e.tag == FLD and e.get(KIND) == "end":
                spans.append((stack.pop() if stack else 0, len(chars)))
            elif e.tag in TEXTS:
                around = [a for a in self.above(e)]
                inside = around[: around.index(p)]
                box = next((CONTAINER[a.tag] for a in inside if a.tag in CONTAINER), None)
                direct = self.up[e].tag == name("w:r") and self.up[self.up[e]] is p
                for k, c in enumerate(TEXTS[e.tag] or e.text or ""):
                    chars.append((c, e, k, box, direct, e.tag == name("w:t")))
        spans += [(s, len(chars)) for q in queue.values() for s in q] + [(s, len(chars)) for s in stack]
        return "".join(c[0] for c in chars), chars, spans, equations

    def plan(self, p, find, to, occurrence):
        text, chars, spans, equations = self.paragraph(p)
        found, at = [], text.find(find)
        while at >= 0:
            found.append(at)
            at = text.find(find, at + len(find))
        n = len(found)
        if n < (occurrence if isinstance(occurrence, int) else 1):
            return "E4203", n, None
        if n > 1 and occurrence is None:
            return "E1202", n, None
        chosen = found if occurrence == "all" else [found[(occurrence or 1) - 1]]
        if find == to:
            return "I0001", n, None
        size = len(find)
        covered = [c for s in chosen for c in chars[s : s + size]]
        if any(c[3] for c in covered) or any(a < b and s < b and a < s + size for s in chosen for a, b in spans) or any(s < q < s + size for s in chosen for q in equations):
            return "E4305", n, None
        if not all(c[4] and c[5] for c in covered):
            return "E4306", n, None
        new = {}
        for s in reversed(chosen):
            first = True
            for c in chars[s : s + size]:
                t = new.setdefault(c[1], list(c[1].text))
                t[c[2]] = to if first else ""
                first = False
        return "ok", n, {self.order.index(e): "".join(t) for e, t in new.items()}


@pytest.fixture(scope="module")
def stories(spark):
    rng = random.Random(21)
    markup = {k: body(rng) for k in range(40)}
    rows = shredded(spark.createDataFrame([(k, bytearray(package(m))) for k, m in markup.items()], "doc_id long, content binary"))
    return rows, {k: Reading(m) for k, m in markup.items()}


def test_texts_and_protection(stories):
    rows, readings = stories
    got = {}
    for r in O.text_nodes(rows).where("stop > start").orderBy("start").collect():
        got.setdefault((r.doc_id, r.para_id), []).extend((c, r.direct, r.feature is not None) for c in r.text)
    want = {}
    for k, reading in readings.items():
        for p in reading.root.iter(name("w:p")):
            _, chars, spans, _ = reading.paragraph(p)
            if chars:
                want[k, reading.order.index(p)] = [(c[0], c[4], bool(c[3]) or any(a <= i < b for a, b in spans)) for i, c in enumerate(chars)]
    assert got == want and sum(f for v in want.values() for _, _, f in v) > 300


@pytest.mark.parametrize(("find", "to", "occurrence"), [("ab", "X", "all"), ("ba", "Y&", None), ("a", "", 2), ("b", "b", 1)])
def test_plans_equal_a_plain_reading(stories, find, to, occurrence):
    rows, readings = stories
    got = {}
    for r in O.plan_replacement(rows, find, to, occurrence).collect():
        code, n, edits = got.setdefault((r.doc_id, r.para_id), (r.code, r.matches, {}))
        if r.node_id is not None:
            edits[r.node_id] = r.text
    want, codes = {}, set()
    for k, reading in readings.items():
        for p in reading.root.iter(name("w:p")):
            code, n, edits = reading.plan(p, find, to, occurrence)
            if n:
                want[k, reading.order.index(p)] = (code, n, edits or {})
                codes.add(code)
    assert got == want and len(codes) >= (1 if find == to else 3)


def test_matches_across_runs_are_written_back(spark):
    markup = "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>one t</w:t></w:r><w:r><w:t>w</w:t></w:r><w:r><w:t>o three two</w:t></w:r></w:p>"
    rows = shredded(spark.createDataFrame([(1, bytearray(package(markup)))], "doc_id long, content binary"))
    plan = O.plan_replacement(rows, "two", " 2 ", "all").where("code = 'ok'")
    again = shred(save(apply_texts(rows, plan)))
    assert [r.text for r in blocks(again).collect()] == ["one  2  three  2 "]
    assert {r.code for r in O.plan_replacement(rows, "nine", "x", wires=["M.P0001"]).collect()} == {"E4203"}


# --- Bookmarks ---------------------------------------------------------------------------------


def marked(rng):
    mark = lambda: f"<w:bookmark{rng.choice(['Start', 'End'])} w:id='{rng.randint(0, 9)}' w:name='b{rng.randint(0, 99)}'/>" if rng.random() < 0.3 else ""
    para = lambda: "<w:p>" + "".join(mark() + (run(rng) if rng.random() < 0.8 else f"<w:del>{run(rng)}</w:del>") for _ in range(rng.randint(0, 4))) + mark() + "</w:p>"
    table = lambda: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{mark()}{para()}{mark()}</w:tc>" for _ in range(2)) + "</w:tr>" for _ in range(2)) + "</w:tbl>"
    return "".join(mark() + (para() if rng.random() < 0.75 else table()) for _ in range(6))


def bookmark_texts(markup):
    """From each start, walk on to the end of its id: the visible characters, and a line for each paragraph that is begun on the way."""
    reading = Reading(markup)
    order, out = reading.order, []
    for i, s in enumerate(order):
        if s.tag != name("w:bookmarkStart"):
            continue
        e = next((x for x in order if x.tag == name("w:bookmarkEnd") and x.get(ID) == s.get(ID)), None)
        if e is None:
            continue
        j = order.index(e)
        of = lambda x, tag: next((a for a in reading.above(x) if a.tag == name(tag)), None)
        same = reading.up[s].tag == name("w:p") and reading.up[s] is reading.up[e]
        shape = "reversed" if j < i else "same-paragraph" if same else "cells" if of(s, "w:tc") is not of(e, "w:tc") else "paragraphs"
        lines = [""] if of(s, "w:p") is not None else []
        for x in order[i + 1 : j] if j > i else []:
            if x.tag == name("w:p"):
                lines.append("")
            elif x.tag in TEXTS and not reading.hidden(x):
                lines[-1] += TEXTS[x.tag] or x.text or ""
        out.append((i, s.get(name("w:name")), shape, "\n".join(lines) if j > i else ""))
    return out


def test_bookmark_texts(spark):
    rng = random.Random(5)
    markup = {k: marked(rng) for k in range(40)}
    rows = shredded(spark.createDataFrame([(k, bytearray(package(m))) for k, m in markup.items()], "doc_id long, content binary"))
    got = sorted((r.doc_id, r.start_node, r.bookmark, r.shape, r.text) for r in O.bookmark_texts(rows).collect())
    want = sorted((k, *b) for k, m in markup.items() for b in bookmark_texts(m))
    assert got == want and {w[3] for w in want} == {"reversed", "same-paragraph", "cells", "paragraphs"} and sum("\n" in w[4] for w in want) > 20

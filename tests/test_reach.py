"""Reachability of parts against a walk."""

from __future__ import annotations

import random

from paperloom.plans import reach
from paperloom.plans.packages import parts
from paperloom.sources.packages import save, shred, shredded
from tests.test_packages import REL, package, small_plans  # noqa: F401


def test_reached_parts_and_media(spark):
    rng = random.Random(8)
    ns = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    rows, want, use = [], set(), {}
    for doc in range(12):
        names = [f"/word/p{k}.xml" for k in range(8)] + [f"/word/media/m{k}.png" for k in range(4)]
        edges = {"/": ["/word/document.xml"], "/word/document.xml": rng.sample(names, 2)} | {n: [rng.choice([*names, "/word/lost.xml"]) for _ in range(rng.randint(0, 3))] for n in names[:8]}
        link = lambda targets: "".join(f'<Relationship Id="r{k}" Type="{REL}/any" Target="{t}"/>' for k, t in enumerate(targets))
        extra = {n[1:]: "<x/>" for n in names[:8]} | {n[1:]: b"img" for n in names[8:]} | {f"word/_rels/{n[6:]}.rels": f"<Relationships {ns}>{link(t)}</Relationships>" for n, t in edges.items() if n.startswith("/word/p")}
        rows.append((doc, bytearray(package("", link(edges["/word/document.xml"]), extra))))
        steps, front, k = {}, ["/"], 0
        while front:
            k += 1
            front = sorted({t for n in front for t in edges.get(n, []) if t in [*names, "/word/document.xml"] and t not in steps})
            steps |= dict.fromkeys(front, k)
        want |= {(doc, n, s) for n, s in steps.items()}
        use |= {(doc, m): sum(m in set(t) for n, t in edges.items() if n in steps) for m in names[8:]}
    found = shredded(spark.createDataFrame(rows, "doc_id long, content binary"))
    assert {tuple(r) for r in reach.reached(found).select("doc_id", "part", "steps").collect()} == want
    got = {(r.doc_id, r.part): (r.users, r.shared, r.orphaned) for r in reach.media_use(found).collect()}
    assert got == {k: (n, n > 1, n == 0) for k, n in use.items()} and len({n > 0 for n in use.values()}) == 2
    again = shred(save(reach.pruned(found)))
    assert parts(again).where("part like '/word/media/%'").count() == sum(n > 0 for n in use.values())

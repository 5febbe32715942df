"""Vectors and components against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from paperloom.llm import vectors
from paperloom.llm.components import roots


def brute(rows):
    x = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, tree = {}, {i: i for i, _, _ in rows}

    def top(a):
        while tree[a] != a:
            a = tree[a]
        return a

    for i, a, p in x:
        for j, b, q in x:
            if i != j and p == q and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i] = links.get(i, 0) + 1
                tree[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (links.get(i, 0), top(i), top(i) == i) for i, _, _ in rows}


@pytest.mark.parametrize(("chunk", "slot", "block"), [(1024, 4096, 1 << 22), (5, 20, 7), (1024, 3, 1 << 22)])
def test_links_components(spark, chunk, slot, block, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    monkeypatch.setattr(vectors, "SLOT", (slot, slot * 8))
    monkeypatch.setattr(vectors.runs, "__defaults__", (block,))
    monkeypatch.setattr(vectors, "CELL", 5)
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.12).tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(5)] + [(400, None, 0), (401, [0.0] * 8, 0), (402, [None] + [1.0] * 7, 0), (403, [float("nan")] * 8, 0), (404, [float("inf")] * 8, 0), (405, rows[0][1], None), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (410, rows[0][1] + [0.0], 0), (411, rows[0][1] + [0.01], 0), (412, [*rows[0][1][:2]], 0), (413, [*rows[0][1][:2], 0.0], 0), (408, [1e30] * 8, 1), (409, [1e-30] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rep", "2 as v")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    with np.errstate(over="ignore"):
        assert got == brute([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows])


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.001], 0)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False)]


def test_empty_and_only_invalid(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(1, None, 1)], schema)).collect()] == [(1, 0, 1, True)]


def test_traversal_in_rising_order():
    rng = np.random.default_rng(0)
    first, second = rng.random((20, 9)), rng.random((20, 7))
    q, i, j = vectors.traversed(first, second, 0.6)
    assert set(zip(q.tolist(), i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(first[:, :, None] + second[:, None] <= 0.6)), strict=True))
    for k in range(20):
        sums = (first[q, i] + second[q, j])[q == k].tolist()
        assert sums == sorted(sums)


def test_slots_hold_runs_of_cells():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, 35)
    slot = vectors.slots_of(counts, rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), 20)
    sizes = np.bincount(slot, counts)
    assert len(slot) == 35 and sizes.max() < 20 + 9 and sizes.sum() == counts.sum()


def test_runs_are_the_visited_cells_and_no_more():
    rng = np.random.default_rng(2)
    stored = np.sort(rng.integers(0, 30, 200))
    asked = [np.unique(rng.integers(0, 35, rng.integers(0, 9))) for _ in range(50)]
    seen = [(r, c) for of, run in vectors.runs(asked, stored, 64) for r in of.tolist() for c in range(run.start, run.stop)]
    assert len(seen) == len(set(seen)) and set(seen) == {(r, c) for r, a in enumerate(asked) for c in range(200) if stored[c] in a}


def test_compared_pairs_and_copies_at_400_000_vectors(spark):
    """Jittered vectors of the table: what is compared is what the visited cells hold, and vectors are copied to few slots."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null").collect()
    base = np.array([r.embedding for r in rows if len(r.embedding) == 64], dtype=float)
    base, n, rng = base[np.isfinite(base).all(1)], 400_000, np.random.default_rng(0)
    x = np.concatenate([base + rng.normal(size=base.shape) * np.abs(base).mean() / 2 for _ in range(n // len(base) + 1)])[:n]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = int(np.sqrt(n / vectors.CELL))
    sample = x[rng.choice(n, 10_000, replace=False)]
    codes = vectors.kmeans(sample[:, :32], k), vectors.kmeans(sample[:, 32:], k)
    cell = np.concatenate([vectors.margins(x[a : a + 8192, :32], codes[0])[0] * k + vectors.margins(x[a : a + 8192, 32:], codes[1])[0] for a in range(0, n, 8192)])
    counts = np.bincount(cell, minlength=k * k)
    slot_of = vectors.slots_of(counts, *codes, int(n / vectors.SLOTS))
    some = x[rng.choice(n, 1000, replace=False)]
    _, q, slot, _, cells = vectors.visits(some, codes, counts > 0, slot_of, 0.04)
    every = vectors.traversed(vectors.margins(some[:, :32], codes[0])[1], vectors.margins(some[:, 32:], codes[1])[1], 0.04)
    compared, visited, copies = counts[cells].sum() / 1000, counts[every[1] * k + every[2]].sum() / 1000, len(q) / 1000 - 1
    print(f"compared {compared:.0f} a vector, visited {visited:.0f}, copies {copies:.2f}")
    assert compared <= visited < 0.03 * n and copies < 5


def test_recall_is_one_on_many_vectors(spark):
    """All links of 3,000 vectors around 300 centres, by brute force in blocks."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(300, 16))[rng.integers(0, 300, 3000)] + rng.normal(size=(3000, 16)) * 0.13).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    got = vectors.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()
    assert want.sum() > 3000 and [r.n_links for r in sorted(got)] == want.tolist()


def test_forest():
    forest, rng = vectors.Forest(40), np.random.default_rng(3)
    edges = [(int(a), np.unique(rng.integers(0, 40, 3))) for a in rng.integers(0, 40, 12)]
    for a, others in edges:
        forest.join(a, others)
    group = lambda pairs: {frozenset(b for b in range(40) if reach(pairs, a, b)) for a in range(40)}

    def reach(pairs, a, b):
        seen = {a}
        while True:
            more = {y for p in pairs for x, y in (p, p[::-1]) if x in seen} - seen
            if not more:
                return b in seen
            seen |= more

    assert group(forest.links) == group([(a, int(b)) for a, o in edges for b in o]) and len(forest.links) == 40 - len(group(forest.links))


def test_the_grid_is_used_and_more_so_as_it_grows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.stack([r.embedding for r in rows.where("embedding is not null").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share = []
    for k in (8, 56):
        one, two = vectors.kmeans(x[:, :32], k), vectors.kmeans(x[:, 32:], k)
        q, _, _ = vectors.traversed(vectors.margins(x[:, :32], one)[1], vectors.margins(x[:, 32:], two)[1], 0.04)
        share.append(len(q) / len(x) / k**2)
    assert share[1] < share[0] / 3


def test_roots_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200), (200, 201)]
    got = {}
    for r in roots(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(61)), list(range(100, 140)), [200, 201]]
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0

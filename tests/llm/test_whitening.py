"""Whitening against a full eigendecomposition."""

from __future__ import annotations

import numpy as np
import pytest

from paperloom.llm.whitening import fit_whitening, op13_embedding_whitening, whiten, whole_vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def plain(vectors, k):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    u = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(u), u.sum(0)
    c = ((n * u - s) / n).astype(float)
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return n, [int(((n * r - s) ** 2).sum()) for r in x], ((n * x - s) / n).astype(float) @ w / np.sqrt(e), e / np.trace(c.T @ c / n)


def check(got, ids, vectors, k):
    n, deviation, white, explained = plain(vectors, k)
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(rows) == len(got) == len(ids) * k
    sign = np.sign([rows[ids[0], j + 1]["whitened"] * white[0, j] for j in range(k)])
    for i, v in enumerate(ids):
        for j in range(k):
            r = rows[v, j + 1]
            assert r["n"] == n and int(r["deviation"]) == deviation[i]
            assert r["whitened"] == pytest.approx(sign[j] * white[i, j], abs=1e-7) and r["explained"] == pytest.approx(explained[j], rel=1e-9)
            assert r["identity_error"] < 1e-9


def test_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(op13_embedding_whitening(spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 16)


def test_few_passes_settle_a_steep_spectrum(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 40)) * np.r_[4.0 ** -np.arange(3) * 900, np.full(37, 0.02)]
    fit = whole_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)).select("x").distinct()
    steep = fit_whitening(fit, 40, 3, 10)
    assert not steep.expanded and 1 < steep.passes <= 8
    flat = fit_whitening(fit, 40, 16, 10)
    assert flat.expanded and flat.passes < 8
    assert np.allclose(flat.values[:3], steep.values, rtol=1e-12) and np.allclose(abs(flat.vectors[:, :3].T @ steep.vectors), np.eye(3), atol=1e-10)


def test_copies_are_fitted_once_and_order_does_not_matter(spark):
    rng = np.random.default_rng(5)
    x = [v.tolist() for v in rng.standard_normal((30, 5))]
    rows = [(i, v) for i, v in enumerate(x)] + [(100 + i, x[0]) for i in range(200)]
    got = whiten(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    check(got, [r[0] for r in rows], [r[1] for r in rows], 5)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(6)
    x = [v.tolist() for v in rng.standard_normal((20, 3))]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan")] * 3), (93, [float("inf"), 0.0, 0.0]), (94, []), (95, [1e300, 0.0, 0.0]), (96, [1.0, 2.0])]
    rows = spark.createDataFrame([*enumerate(x), *bad], SCHEMA).selectExpr("*", "1 as x", "2 as n", "3 as v", "4 as component")
    check(whiten(rows).collect(), list(range(20)), x, 3)
    repeated = whiten(spark.createDataFrame([(None, x[0]), (7, x[1]), (7, x[1]), (7, x[2])], SCHEMA)).collect()
    assert sorted(str(r["vec_id"]) for r in repeated if r["component"] == 1) == ["7", "7", "7", "None"]
    assert {r["component"] for r in repeated} == {1, 2}
    for none in ([], bad[:5], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten(spark.createDataFrame(none, SCHEMA)).collect() == []


def test_deviations_beyond_64_bits_are_exact(spark):
    x = [[1e15, -3.0], [-1e15, 5.0], [0.0, 7e14]]
    got = whiten(spark.createDataFrame(list(enumerate(x)), SCHEMA)).where("component = 1").collect()
    _, deviation, _, _ = plain(x, 1)
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(enumerate(deviation)) and max(deviation) > 2**63

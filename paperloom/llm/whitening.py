"""Whitened principal components of embeddings by a randomised range finder.

Vectors become whole numbers, so sums over all rows are exact, and rows are centred before they
are multiplied: ``n * x - S`` in whole numbers, then divided.  A random block of ``COMPONENTS +
OVERSAMPLING`` directions is multiplied with the covariance in passes over all centred rows; no
pass builds the covariance, each gives the block ``V Q`` as sums over Spark tasks.  Rayleigh-Ritz
on the block gives components and their residuals for no further pass.  Where the residuals stay
too large for the gaps between eigenvalues, or where their ratio shows that the passes left
cannot help, the block is expanded to the full dimension, for which one pass is exact.

To the driver come blocks of ``dimension x directions`` numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import table, written

COMPONENTS = 16
OVERSAMPLING = 10
#: Passes over all rows before the block is expanded, at most.
PASSES = 8
#: A component is settled where its residual is this share of the gap to the next eigenvalue, which bounds its error.
SETTLED = 1e-11
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on are no whole number that fits; their rows count as not finite.
LARGEST = 2.0**55


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, x``: the vectors of ``rows`` in whole numbers; null ones, empty ones and those with a null, non-finite or too large entry are left out."""
    v = F.col("embedding").cast("array<double>")
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fits)
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(x)`` (``size`` numbers) over blocks ``x`` of rows: added up in each task, then by a grouping of single entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += of(_matrix(batch.column(0).slice(at, 4096)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    got = rows.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


@dataclass
class Whitening:
    """``n`` distinct vectors with sums ``n * floor + rest``; ``values`` fall, ``vectors`` has a component in each column."""

    n: int
    floor: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0
    expanded: bool = False
    passes: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``; the whole part is taken off before anything is rounded."""
        return (x - self.floor) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of ``(n * x - S) ** 2`` of each row, exact; decimals."""
        off = x - self.floor
        most = int(self.n) * (int(np.abs(off).max(initial=0)) + 1)
        if most**2 * x.shape[1] < 2**63:
            d = self.n * off - self.rest
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        d = self.n * off.astype(object) - self.rest.astype(object)
        return pa.array((d * d).sum(1).tolist(), pa.decimal128(38, 0))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # so few that their sum fits 64 bits
                x = _matrix(batch.column(0).slice(at, 128))
                n += len(x)
                high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([*total, n], pa.decimal128(38, 0))], names=["i", "v"])

    got = {r["i"]: int(r["v"]) for r in fit.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return got.get(d, 0), [got.get(i, 0) for i in range(d)]


def fit_whitening(fit: DataFrame, dimension: int, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> Whitening:
    """The components of the distinct vectors ``x`` of ``fit``, all of ``dimension`` entries; those of eigenvalues that are zero to rounding are left out."""
    d = dimension
    n, total = _sums(fit, d)
    if not n:
        return Whitening(0, np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros(0), np.zeros((d, 0)), 0.0)
    model = Whitening(n, np.array([t // n for t in total], np.int64), np.array([t % n for t in total], np.int64), np.zeros(0), np.zeros((d, 0)), 0.0)
    size = min(d, components + oversampling)
    wanted = min(components, d)
    basis = np.linalg.qr(np.random.default_rng(13).standard_normal((d, size)))[0]
    while True:
        q = basis

        def block(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = model.centred(x)
            return np.append(c.T @ (c @ q), (c * c).sum())

        got = summed(fit, d * q.shape[1] + 1, block) / n
        y, model.trace = got[:-1].reshape(d, -1), float(got[-1])
        model.passes += 1
        small = q.T @ y
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        model.values, model.vectors = e, q @ w
        if q.shape[1] == d:
            break
        residual = np.linalg.norm(y @ w - model.vectors * e, axis=0)
        gap = np.minimum(np.abs(np.diff(e, prepend=np.inf)), np.abs(np.diff(e, append=0.0)))
        off = float((residual / np.maximum(gap, np.finfo(float).tiny))[:wanted].max()) / SETTLED
        if off <= 1:
            break
        left, ratio = passes - model.passes, max(e[-1], 0) / max(e[wanted - 1], np.finfo(float).tiny)
        if left <= 0 or model.passes > 1 and np.log(off) + left * np.log(max(ratio, 1e-300)) > 0:
            basis, model.expanded = np.linalg.qr(y, mode="complete")[0], True
        else:
            basis = np.linalg.qr(y)[0]
    some = model.values[:wanted] > d * np.finfo(float).eps * max(model.values[0], 0) if d else np.zeros(0, bool)
    k = int(np.cumprod(some).sum())
    model.values, model.vectors = model.values[:k], model.vectors[:, :k]
    if k:

        def moments(x: np.ndarray) -> np.ndarray:
            z = model.whitened(x)
            return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

        got = summed(fit, k * k + k, moments) / n
        mean = got[k * k :]
        model.identity_error = float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector of ``rows`` (``vec_id, embedding``) and component.

    Rows without a vector, and vectors that are empty or hold a null, non-finite or too large
    entry, give no row, nor do vectors of another length than the commonest (of equally common
    ones the longest), which share no covariance with it.  Equal vectors are fitted once; rows
    that repeat an id are rows of their own, and a null id stays null.  There are as many
    components as eigenvalues above rounding, ``components`` at most: none, and so no row, where
    all vectors are equal or the table is empty.  Other columns are ignored.
    """
    valid = written(whole_vectors(rows), "whole")
    length = valid.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = length["d"] if length else 0
    own = valid.where(F.size("x") == d)
    model = fit_whitening(written(own.select("x").distinct(), "fit"), d, components, oversampling, passes) if d else Whitening(0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 1024):
                part = batch.slice(at, 1024)
                x, each = _matrix(part.column(1)), pa.array(np.repeat(np.arange(part.num_rows), k))
                m = len(each)
                tiled = lambda v: pa.array(np.tile(v, part.num_rows))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), tiled(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(m, model.n)), model.deviations(x).take(each), pa.array(model.whitened(x).ravel()), tiled(model.values / model.trace), pa.array(np.full(m, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector of ``embeddings``; a deviation beyond 64 bits is an error rather than a wrong number."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))

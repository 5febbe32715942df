"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are split into two halves, each with a codebook of its own, trained by k-means on a
bounded sample (``SAMPLE`` vectors).  A vector lies in the cell of the product grid that its two
nearest codes name.  A query walks the cells in rising order of the least distance that a vector
in the cell can have (multi-sequence traversal), and stops where that passes the distance of the
threshold: the recall aimed at is 1, since no link lies beyond.

Cells are only where work is shared out: neighbouring ones share a slot, and a query is sent once
to each slot in which it visits a cell, together with the cells that it visits there, and only to
its own and later slots, since a link is seen from both its ends.  In a slot the stored vectors
lie cell by cell, and a query is compared, in double precision, with the runs of its cells alone.
So the slots' size decides how often a vector is copied, and not what is compared.  Equal vectors
are one entry with a count; slots with more than ``CHUNK`` queries, or twice as many entries as a
slot should have (a cell is never cut), are dealt out to several tasks.

Vectors of another length than the commonest are indexed by as many of their entries as that has
(or padded with zeros), whose distances bound theirs from below, and are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import table, written
from paperloom.llm.components import roots

COSINE = 0.98
#: Vectors that the codebooks are trained on, at most; ``SAMPLE_CODE`` for each code.
SAMPLE = 32768
SAMPLE_CODE = 64
#: Vectors of a cell, on average, that the size of the codebooks aims at, and their size: beyond, cells grow.
CELL = 16
CODES = (4, 2048)
#: Slots aimed at; but no slot has fewer vectors than the first bound, nor more numbers than the second.
SLOTS = 8
SLOT = (4096, 1 << 22)
#: Queries that a task of a slot takes.
CHUNK = 32768
#: Products that are held at once.
BLOCK = 1 << 22


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` centres at most; the first ones are rows of ``x`` far from those before."""
    rng = np.random.default_rng(11)
    centres = [x[0]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.max() > 1e-12:
        centres.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    for _ in range(rounds):
        own = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1) if len(x) * len(c) * x.shape[1] < 1e7 else (-2 * x @ c.T + (c**2).sum(1)).argmin(1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].mean(0)
    return c


def margins(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each row, and for each code the squared distance, at least, to vectors whose nearest it is."""
    d = (x**2).sum(1)[:, None] - 2 * x @ codes.T + (codes**2).sum(1)
    own = d.argmin(1)
    apart = np.sqrt(((codes[:, None] - codes[None]) ** 2).sum(2))[own]
    gap = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / np.where(apart > 0, 2 * apart, 1)
    return own, gap**2


def traversed(first: np.ndarray, second: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, i, j)`` of the cells whose two margins sum up to ``reach`` at most, those of a query in rising order.

    Both margins of a query (a row of ``first`` and of ``second``) are sequences of their own: for
    each step along the first, the second is followed as far as what is left of ``reach``.
    """
    q, i = np.nonzero(first <= reach)
    k, j = np.nonzero(second[q] <= (reach - first[q, i])[:, None])
    q, i = q[k], i[k]
    order = np.lexsort((first[q, i] + second[q, j], q))
    return q[order], i[order], j[order]


def chain(codes: np.ndarray) -> np.ndarray:
    """The rank of each code in an order in which neighbours are near: each is followed by the nearest that is left."""
    rank, at = np.zeros(len(codes), dtype=np.int64), 0
    left = np.ones(len(codes), dtype=bool)
    for n in range(len(codes)):
        rank[at], left[at] = n, False
        if left.any():
            rest = np.flatnonzero(left)
            at = int(rest[((codes[rest] - codes[at]) ** 2).sum(1).argmin()])
    return rank


def slots_of(counts: np.ndarray, one: np.ndarray, two: np.ndarray, slot: int) -> np.ndarray:
    """The slot of each cell: runs of cells with about ``slot`` vectors along the first codes and, there and back, the second ones."""
    a, b = np.divmod(np.arange(len(one) * len(two)), len(two))
    rank, inner = chain(one)[a], chain(two)[b]
    order = np.lexsort((np.where(rank % 2, -inner, inner), rank))
    out = np.zeros(len(order), dtype=np.int32)
    out[order] = (np.cumsum(counts[order]) - counts[order]) // slot
    return out


def valid_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: rows that can link; single precision stays as it is until it is computed with."""
    v = _plain(rows)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite & some).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


def _plain(rows: DataFrame) -> Column:
    single = isinstance(rows.schema["embedding"].dataType, T.ArrayType) and isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType)
    return F.col("embedding").cast("array<float>" if single else "array<double>")


def _whole(v: pa.Array) -> np.ndarray:
    """Vectors of one length in double precision."""
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def points(v: pa.Array, dimension: int) -> np.ndarray:
    """The unit vectors of rows of any lengths in ``dimension`` entries: cut, or padded with zeros."""
    sizes = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(v), dimension))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = _unit(_whole(v.take(pa.array(rows))))
        out[rows, : min(size, dimension)] = x[:, :dimension]
    return out


def codebooks(entries: DataFrame, dimension: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of either half, from the entries of ``dimension`` whose hash is least."""
    k = int(min(max(math.sqrt(total / CELL), CODES[0]), CODES[1]))
    rows = entries.where(F.size("v") == dimension).select(F.xxhash64("v").alias("h"), "v").orderBy("h").limit(min(SAMPLE, SAMPLE_CODE * k)).toArrow()
    x = _unit(_whole(rows["v"].combine_chunks()))
    half = max(1, dimension // 2)
    return kmeans(x[:, :half], k), kmeans(x[:, half:], k) if half < dimension else np.zeros((1, 0))


def visits(x: np.ndarray, codes: tuple[np.ndarray, np.ndarray], filled: np.ndarray, slot_of: np.ndarray, reach: float) -> tuple[np.ndarray, ...]:
    """``own`` cells of the rows of ``x``, and by row and slot, from that of the own cell on, ``(row, slot, stops, cells)``: the cells visited there, those of the k-th row and slot up to ``stops[k]``."""
    (one, two), half = codes, codes[0].shape[1]
    (i, m), (j, n) = margins(x[:, :half], one), margins(x[:, half:], two)
    own = i * len(two) + j
    q, a, b = traversed(m, n, reach)
    cell = a * len(two) + b
    keep = filled[cell] & (slot_of[cell] >= slot_of[own][q])
    q, cell = q[keep], cell[keep]
    order = np.lexsort((cell, slot_of[cell], q))
    q, cell = q[order], cell[order]
    slot = slot_of[cell]
    last = np.flatnonzero(np.append((np.diff(q) != 0) | (np.diff(slot) != 0), True)) if len(q) else np.zeros(0, np.int64)
    return own, q[last], slot[last], last + 1, cell


def runs(asked: list[np.ndarray], stored: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, slice]]:
    """``(rows of asked, run of stored)`` to be compared: ``asked`` are the cells that each row visits, ``stored`` the cell of each stored vector, ascending."""
    if not len(stored):
        return
    rows = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    cell = np.concatenate(asked) if len(asked) else np.zeros(0, np.int64)
    order = np.argsort(cell, kind="stable")
    rows, cell = rows[order], cell[order]
    which, first = np.unique(cell, return_index=True)
    begin, end = np.searchsorted(stored, which), np.searchsorted(stored, which, side="right")
    for k, at in enumerate(np.append(first, len(cell))[:-1]):
        if begin[k] < end[k]:
            of = rows[at : first[k + 1] if k + 1 < len(first) else len(cell)]
            step = max(1, most // (end[k] - begin[k]))
            for start in range(0, len(of), step):
                yield of[start : start + step], slice(begin[k], end[k])


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``rows`` (``vec_id, label, embedding``).

    Vectors link with others of their label at ``cosine`` or more.  A vector that is null, zero,
    or holds null or non-finite values links with nothing, nor does one without label or id, nor
    vectors of different lengths; such a row is kept as its own component.  Repeated rows are
    vectors of their own with the same id, and rows that repeat an id with other vectors too.
    Other columns are ignored; an empty table gives no row.
    """
    rows = rows.select("vec_id", "label", "embedding")
    same = valid_vectors(rows).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    entries = written(same.withColumn("entry", F.monotonically_increasing_id()), "entries")
    common = entries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    reach = 2 - 2 * cosine + 1e-9
    if common is None:
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    total = entries.count()
    counts, links = _linked(entries, codebooks(entries, common["d"], total), reach, cosine, total)
    top = roots(links).join(entries.select(F.col("entry").alias("node"), "rep"), "node")
    least = written(top.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    component = top.join(least, "root").select(F.col("node").alias("entry"), "component_id")
    summed = counts.groupBy("entry").agg(F.sum("n").alias("n"))
    known = written(entries.join(summed, "entry", "left").join(component, "entry", "left").select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "rep").alias("c")), "known")
    keyed = rows.withColumn("v", F.when(F.col("vec_id").isNotNull(), _plain(rows)))
    both = keyed.join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    vec, c = F.col("vec_id").cast("long"), F.coalesce("c", F.col("vec_id").cast("long"))
    return both.select(vec.alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(vec == c, F.lit(True)).alias("kept"))


def _linked(entries: DataFrame, codes: tuple[np.ndarray, np.ndarray], reach: float, cosine: float, total: int) -> tuple[DataFrame, DataFrame]:
    """``entry, n`` (linked copies, by slot) and the ``a, b`` of spanning links."""
    one, two = codes
    dimension, width = one.shape[1] + two.shape[1], len(two)
    kind = entries.schema["v"].dataType.simpleString()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = points(batch.column(0).slice(at, 1024), dimension)
                near = [((c**2).sum(1) - 2 * y @ c.T).argmin(1) for y, c in ((x[:, : one.shape[1]], one), (x[:, one.shape[1] :], two))]
                yield pa.RecordBatch.from_arrays([pa.array(near[0] * width + near[1], pa.int32())], names=["cell"])

    counts = np.zeros(len(one) * width, dtype=np.int64)
    got = entries.select("v").mapInArrow(home, "cell int").groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # a row for each cell at most
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    slot = int(max(SLOT[0], min(total / SLOTS, SLOT[1] / dimension)))
    slot_of, filled = slots_of(counts, one, two, slot), counts > 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own, q, slots, stops, cells = visits(points(part.column(3), dimension), codes, filled, slot_of, reach)
                home_slot = slot_of[own]
                row = np.concatenate([np.arange(len(own)), q])
                role = np.concatenate([np.zeros(len(own), np.int32), np.where(slots == home_slot[q], 1, 2).astype(np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.arange(len(own) + 1), len(own) + stops]), pa.int32()), pa.array(np.concatenate([own, cells]), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(np.concatenate([home_slot, slots]), pa.int32()), pa.array(role), lists], names=["label", "entry", "copies", "v", "slot", "role", "cells"])

    # Role 0 is stored in its slot, 1 asks in its own slot, 2 in another one.
    label = entries.schema["label"].dataType.simpleString()
    wide = entries.select("label", "entry", "copies", "v").repartition(max(8, math.ceil(total / 4096)), "entry")
    placed = written(wide.mapInArrow(place, f"label {label}, entry long, copies long, v {kind}, slot int, role int, cells array<int>").withColumn("length", F.size("v")), "placed")
    key = ["label", "length", "slot"]
    chunks = placed.groupBy(*key).agg(F.ceil(F.count_if(F.col("role") == 0) / (2 * slot)).alias("stored"), F.ceil(F.count_if(F.col("role") > 0) / CHUNK).alias("asked")).where("stored > 0")
    dealt = placed.join(written(chunks, "chunks"), key)
    h, stored_here = F.xxhash64("entry"), F.col("role") == 0
    others = F.sequence(F.lit(0).cast("long"), F.when(stored_here, F.greatest("asked", F.lit(1).cast("long"))).otherwise(F.col("stored")) - 1)
    dealt = dealt.withColumn("other", F.explode(others))
    dealt = dealt.withColumn("s", F.when(stored_here, F.pmod(h, F.col("stored"))).otherwise(F.col("other"))).withColumn("a", F.when(stored_here, F.col("other")).otherwise(F.pmod(h, F.col("asked"))))

    def verify(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        stored, asked = rows[rows["role"] == 0], rows[rows["role"] > 0]
        if not len(stored) or not len(asked):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("entry", "n", "to")})
        cell = np.concatenate(stored["cells"].to_numpy())
        order = np.argsort(cell, kind="stable")
        stored, cell = stored.iloc[order], cell[order]
        x, y = _unit(np.stack(asked["v"].to_numpy()).astype(np.float64)), _unit(np.stack(stored["v"].to_numpy()).astype(np.float64))
        p, q, weight, ask_weight = asked["entry"].to_numpy(), stored["entry"].to_numpy(), stored["copies"].to_numpy(), asked["copies"].to_numpy()
        far = asked["role"].to_numpy() == 2  # what asks from another slot is not asked for by what is stored here
        total, back = np.zeros(len(p), np.int64), np.zeros(len(q), np.int64)
        forest = Forest(len(p) + len(q))
        for of, run in runs(asked["cells"].to_list(), cell):
            near = x[of] @ y[run].T >= cosine
            near &= p[of][:, None] != q[run]
            hit = np.flatnonzero(near.any(1))
            if len(hit):
                near, of = near[hit], of[hit]
                total[of] += near @ weight[run]
                back[run] += np.where(far[of], ask_weight[of], 0) @ near
                for row, links in zip(of.tolist(), near, strict=True):
                    forest.join(row, len(p) + run.start + np.flatnonzero(links))
        both = np.concatenate([p, q])
        out = [pd.DataFrame({"entry": e[n > 0], "n": n[n > 0], "to": e[n > 0]}) for e, n in ((p, total), (q, back))]
        u, w = both[np.array(forest.links, dtype=np.int64).reshape(-1, 2)].T
        return pd.concat([*out, pd.DataFrame({"entry": u, "n": 0, "to": w})[u != w]], ignore_index=True)

    found = written(dealt.select(*key, "s", "a", "entry", "copies", "v", "role", "cells").groupBy(*key, "s", "a").applyInPandas(verify, "entry long, n long, to long"), "near")
    return found.select("entry", "n"), found.where("entry <> to").select(F.col("entry").alias("a"), F.col("to").alias("b"))


class Forest:
    """Which nodes are linked so far; ``links`` are those that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def tops(self, nodes: np.ndarray) -> np.ndarray:
        top = self.up[nodes]
        while (self.up[top] != top).any():
            top = self.up[top]
        self.up[nodes] = top
        return top

    def join(self, node: int, others: np.ndarray) -> None:
        """Link ``node`` with each of ``others``."""
        top, first = np.unique(self.tops(others), return_index=True)
        mine = int(self.tops(np.array([node]))[0])
        for t, k in zip(top.tolist(), first.tolist(), strict=True):
            if t != mine:
                self.up[t] = mine
                self.links.append((node, int(others[k])))


def op5_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector of ``embeddings``."""
    return near_vectors(table(spark, sf_dir, "embeddings"))

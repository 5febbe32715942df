"""N-gram Jaccard self-join of whole texts by prefix trees.

A document's set holds its distinct shingles of ``WIDTH`` words as 64-bit hashes, and similarity is
that of the hashes.  Equal sets are one class: its 64-bit name is part of a 128-bit BLAKE2 digest of
the whole set, and should two digests share a name, all are named anew.  All sets are kept in one
global order: shingles that a count sketch of the whole corpus calls common come last, and within
a level the hash decides.  Two sets that link must share ``SHARED`` of the first
``n - ceil(0.8 n) + SHARED`` shingles of either, or all but a fifth of sets too small for that.

1. Only shingles met in two such prefixes of similar length go on.  A shingle of ``FEW`` classes
   at most gives their pairs; such a pair needs ``SHARED`` shingles, or it shares one with more
   classes.  Each of these brings its classes together, if they have as many shingles as a link
   needs, with a parity bitmap that bounds how much two sets differ; a set of ``SHORT`` shingles
   at most comes with their lower halves instead, which tell how much two such sets differ.  A
   group yields a spanning forest of its surely similar sets and every doubtful pair between its
   trees; of two short sets no pair is doubtful.  A shingle whose counter exceeds ``BLOCK``, so
   that it may have more classes, is dealt by its classes too, counted exactly, and goes on in
   pairs of blocks, so no task meets more than ``BLOCK`` rows of a shingle, whatever the mean.
2. The pairs are verified by their sets: the sets to compare with one set stand in a prefix tree
   in global order.  The walk shares the overlap of a common path, and leaves a subtree when
   what has not matched exceeds what the lengths allow.
   What is joined grows with the corpus, so these joins are merges of sorted rows at any size.
3. Links make components.  If a forest pair turns out not to link, the groups that hold it are
   gone through pair by pair, so no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import release, table, written
from paperloom.llm.components import roots

WIDTH = 5
#: Least similarity, as a percentage.
PERCENT = 80
#: The corpus sketch has a counter for ``2 ** SKETCH_DOCUMENTS`` documents, but between ``2 **`` these.
SKETCH_BITS = (17, 20)
SKETCH_DOCUMENTS = 5
#: Parts into which the classes of a shingle that may be hot are dealt.
SALTS = 64
#: Shingles that two linking sets share at least, in prefixes that are longer by one less.
SHARED = 4
#: Least bits of a parity bitmap; a set of n shingles has the next power of two from 2 n.
BITMAP_BITS = 1024
#: Shingles of a set that is compared by their lower halves; larger ones have bitmaps.
SHORT = 128
#: Pairs that a task holds before it gives them out.
HELD = 100_000
#: Classes of a group that are compared in one task; larger groups are split into pairs of blocks.
BLOCK = 4096
#: Classes of a shingle whose pairs are given by name; a row in such a group gives (FEW - 1) / 2 pairs at most.
FEW = 8
#: Bytes of texts whose shingles are made at once; a longer text is alone.
TEXT_BYTES = 1 << 20
#: Sets of a prefix tree, and shingles of all its sets.
TREE = 512
TREE_SHINGLES = 1 << 18
#: 64-bit words of the filter on documents whose sets are needed, as a power of two: 16 bits a document, but between these.
FILTER_WORDS = (10, 19)
#: Classes that a task remembers as given out.
REMEMBERED = 1 << 20
#: Groups that a class names, the least ones, so that a pair of several groups is given once.
FIRSTS = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _FINAL
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; empty for null and for texts without words."""
    data = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    first = int(offsets[0])
    raw = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)[first : int(offsets[-1])]
    offsets = offsets - first
    empty = np.zeros(0, dtype=np.uint64)
    if not len(raw):
        return [empty] * len(data)
    up, down = _powers(len(raw) + 1)
    inside = ~_SPACE[raw]
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[offsets] = True
    starts = np.flatnonzero(inside & (begins[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (begins[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[raw] * up[: len(raw)], dtype=np.uint64)])
    words = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX)
    stops = np.searchsorted(starts, offsets[1:])
    grams = np.zeros(0, dtype=np.uint64)
    if len(words) >= width:
        grams = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            grams = grams * _MIX + words[k : len(words) - width + 1 + k]
        grams = _mixed(grams)
    out, a = [], 0
    for b in stops.tolist():
        if b - a >= width:
            g = np.sort(grams[a : b - width + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            z = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                z = z * _MIX + words[k : k + 1]
            out.append(_mixed(z))
        else:
            out.append(empty)
        a = b
    return out


def digest_of(grams: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a digest of a set (sorted), the same for equal sets."""
    return struct.unpack("<qq", hashlib.blake2b(grams.tobytes(), digest_size=16).digest())


def class_of(grams: np.ndarray, seed: int = 0) -> int:
    """The name of a set's class."""
    one, two = digest_of(grams)
    return one if not seed else struct.unpack("<q", hashlib.blake2b(struct.pack("<qqq", one, two, seed), digest_size=8).digest())[0]


def mark(grams: np.ndarray) -> bytes:
    """The lower halves of a short set's shingles, or the bitmap of a larger set."""
    return (grams & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() if len(grams) <= SHORT else bitmap(grams)


def bitmap(grams: np.ndarray) -> bytes:
    bits = max(BITMAP_BITS, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(one: bytes, size: int) -> np.ndarray:
    """A bitmap folded to ``size`` bytes."""
    x = np.frombuffer(one, dtype=np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _counter(grams: np.ndarray, counters: int) -> np.ndarray:
    return (grams >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def ordered(grams: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set in global order: the sketch's level in the upper six bits, then the hash."""
    at = _counter(grams, len(level))
    return np.sort((level[at].astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6)))


def _chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most 512 rows, in which the column ``text`` has at most ``TEXT_BYTES`` or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(max(int(np.searchsorted(ends, before + TEXT_BYTES, side="right")), at + 1), at + 512)
            yield batch.slice(at, stop - at)
            at = stop


def _classes(docs: DataFrame, counters: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, cid, check, bitmap`` of each document, and the sketch's ``at, count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, dtype=np.int64)
        for part in _chunks(batches, 1):
            sets = shingle_sets(part.column(1))
            counts += np.bincount(_counter(np.concatenate(sets), counters), minlength=counters)
            yield rows(part.column(0), [len(s) for s in sets], [class_of(s, seed) if len(s) else None for s in sets], [digest_of(s)[1] if len(s) else None for s in sets], [mark(s) if len(s) else None for s in sets], [None] * len(sets))
        yield rows(pa.array([None], pa.int64()), [None], [None], [None], [None], [counts.astype("<i8").tobytes()])
        release()

    def rows(doc: pa.Array, *rest: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc, *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))], names=["doc_id", "n", "cid", "check", "bitmap", "sketch"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0).to_pylist():
                n = np.frombuffer(one, dtype="<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["at", "count"])

    found = written(docs.mapInArrow(run, "doc_id long, n int, cid long, check long, bitmap binary, sketch binary"), "shingled")
    sketch = found.where("sketch is not null").select("sketch").mapInArrow(spread, "at int, count long").groupBy("at").agg(F.sum("count").alias("count"))
    return found.where("sketch is null").select("doc_id", "n", "cid", "check", "bitmap"), sketch


def _levels(sketch: DataFrame, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """How many times, as a power of two, a counter is above the mean (the order's upper key), and whether its shingles may be in more than ``BLOCK`` classes."""
    got, counts = sketch.toArrow(), np.zeros(counters, dtype=np.int64)  # as many rows as counters
    counts[got["at"].to_numpy()] = got["count"].to_numpy()
    mean = max(counts.mean(), 1.0)
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / mean)), 0, 62).astype(np.uint8), counts > BLOCK


def _prefixes(docs: DataFrame, level: np.ndarray, hot: np.ndarray, seed: int) -> DataFrame:
    """``key, n, cid``: the shingles of each class's prefix, once from each task that meets the class; ``n`` is negative for shingles that may be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for part in _chunks(batches, 0):
            keys, names, sizes = [], [], []
            for s in shingle_sets(part.column(0)):
                cid = class_of(s, seed)
                if len(s) and cid not in given:
                    if len(given) >= REMEMBERED:
                        given.clear()
                    given.add(cid)
                    n = len(s)
                    take = min(n, n - -(-PERCENT * n // 100) + SHARED)
                    at = _counter(s, len(level))
                    key = (level[at].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                    first = np.argsort(key, kind="stable")[:take]
                    keys.append(key[first])
                    names.append(np.full(take, cid, dtype=np.int64))
                    sizes.append(np.where(hot[at[first]], -n, n).astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(names))], names=["key", "n", "cid"])
        given.clear()
        release()

    return docs.select("text").mapInArrow(run, "key long, n int, cid long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole runs of the first column, which is sorted."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if held and not cut and held[-1][0][-1] == now[0][-1]:
            held.append(now)
            continue
        pieces = [*held, [x[:cut] for x in now]] if cut else held
        if pieces:
            yield tuple(np.concatenate(x) for x in zip(*pieces, strict=True))
        held = [[x[cut:] for x in now]]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _met(few: int):  # noqa: ANN202
    """Of ``key, n, cid`` in this order the rows that share a key with another class of similar length.

    ``grp`` is the group that compares them, or null in a row of a key of few classes.  Those of
    the latter are followed by its pairs: ``cid, other`` and the shingles ``need`` that they must share.
    Rows of a key that may be hot pass as they are, with their ``hot`` key.
    """

    def out(grp: np.ndarray | None, cid: np.ndarray, other: np.ndarray | None = None, need: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
        columns = [(grp, pa.int64()), (cid, pa.int64()), (other, pa.int64()), (need, pa.int32()), (hot, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.nulls(len(cid), t) if x is None else pa.array(x, t) for x, t in columns], names=["grp", "cid", "other", "need", "hot"])

    def cold(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column(1).to_numpy() < 0
            if many.any():
                x = batch.filter(pa.array(many))
                passed.append(out(None, x.column(2).to_numpy(), hot=x.column(0).to_numpy()))
                batch = batch.filter(pa.array(~many))
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for key, n, cid in _runs(cold(batches, passed)):
            yield from passed
            passed.clear()
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1]) | (n[1:] != n[:-1])])
            key, n, cid = key[new], n[new].astype(np.int64), cid[new]
            near = (key[1:] == key[:-1]) & (n[1:] * PERCENT <= n[:-1] * 100)
            keep = np.concatenate([near, [False]]) | np.concatenate([[False], near])
            key, cid, n = key[keep], cid[keep], n[keep]
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            group = _mixed(key.view(np.uint64)).view(np.int64)
            size = np.repeat(sizes, sizes)
            large = size > BLOCK
            yield out(None, cid[large], hot=key[large])
            single = (size > few) & ~large
            yield out(group[single], cid[single])
            alone = size <= few
            yield out(None, cid[alone])
            key_, cid_, n_ = key[alone], cid[alone], n[alone]
            for k in range(1, few):
                i = np.flatnonzero((key_[k:] == key_[:-k]) & (n_[k:] * PERCENT <= n_[:-k] * 100) & (cid_[k:] != cid_[:-k]))
                a, b = cid_[i], cid_[i + k]
                yield out(None, np.minimum(a, b), np.maximum(a, b), np.minimum(-(-PERCENT * n_[i + k] // 100), SHARED))
        yield from passed

    return run


def _blocks_of_hot(every: DataFrame) -> DataFrame:
    """``grp, cid`` of the shingles that may be hot: one group up to ``BLOCK`` classes, else one for each pair of blocks."""
    hot = every.where("hot is not null").select("hot", "cid")
    heavy = written(hot.groupBy("hot").agg(F.count("*").alias("m")).where("m > 1").select("hot", F.ceil(F.col("m") / BLOCK).alias("blocks")), "heavy")
    dealt = hot.join(heavy, "hot").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("hot", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "cid")


def _short_differ(halves: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How much short sets differ by the lower halves of their shingles: never more than the sets themselves."""
    out = np.zeros(len(i), dtype=np.int64)
    none = np.uint64(1 << 32) + np.arange(2 * SHORT, dtype=np.uint64)  # beyond the end of either set, equal to nothing
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        width = int(max(n[a].max(), n[b].max()))
        k = np.arange(width)
        left = np.where(k < n[a][:, None], halves[a, :width], none[:width])
        right = np.where(k < n[b][:, None], halves[b, :width], none[SHORT : SHORT + width])
        x = np.sort(np.concatenate([left, right], axis=1), axis=1)
        out[at : at + 4096] = n[a] + n[b] - 2 * (x[:, 1:] == x[:, :-1]).sum(1)
    return out


def _differ(small: np.ndarray, maps: np.ndarray, n: np.ndarray, halves: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair a lower bound of how much the sets differ, and whether they surely link.

    A set bit is an odd number of differing shingles.  The estimate corrects for those that met
    in one bit; five standard deviations and three further meetings must still be within the limit.
    Two short sets surely link where their lower halves do.
    """
    both = n[i] + n[j]
    bits = np.full(len(i), BITMAP_BITS)
    differ = np.bitwise_count(small[i] ^ small[j]).sum(1, dtype=np.int64)
    for k in np.flatnonzero((100 - PERCENT) * both >= (100 + PERCENT) * differ).tolist():
        if n[i[k]] <= SHORT or n[j[k]] <= SHORT:
            continue
        size = min(len(maps[i[k]]), len(maps[j[k]]))
        if size * 8 > BITMAP_BITS:
            bits[k], differ[k] = size * 8, int(np.bitwise_count(folded(maps[i[k]], size) ^ folded(maps[j[k]], size)).sum())
    share = np.maximum(1 - 2 * differ / bits, 1e-3)
    likely = -bits / 2 * np.log(share)
    spread = np.sqrt(np.maximum(bits / 4 * (1 - share**2) - likely * share**2, 0)) / share
    sure = (100 - PERCENT) * both >= (100 + PERCENT) * (likely + 5 * spread + 6)
    short = np.flatnonzero((n[i] <= SHORT) & (n[j] <= SHORT) & ((100 - PERCENT) * both >= (100 + PERCENT) * differ))
    if len(short):
        differ[short] = _short_differ(halves, n, i[short], j[short])
        sure[short] = (100 - PERCENT) * both[short] >= (100 + PERCENT) * differ[short]
    return differ, sure


def _similar(whole: bool):  # noqa: ANN202
    """From ``grp, n, cid, bitmap, firsts`` in this order the pairs ``a, b`` that may link; ``sure`` marks forest pairs. ``whole``: every pair, no forests.

    A first pass over the pairs of a group grows the forest of sure pairs, a second one gives the
    doubtful pairs between its trees.  ``firsts`` are a class's least groups: a pair that both
    name an earlier group for is given there, where it is a pair as well or stands in one tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, bool]] = set()
        for grp, n, cid, maps, firsts in _runs(batches):
            n = n.astype(np.int64)
            halves = np.zeros((len(grp), SHORT), dtype=np.uint64)
            for k in np.flatnonzero(n <= SHORT).tolist():
                halves[k, : n[k]] = np.frombuffer(maps[k], dtype="<u4")
            small = np.stack([folded(bitmap(halves[k, : n[k]]) if n[k] <= SHORT else m, BITMAP_BITS // 8) for k, m in enumerate(maps)])
            least = np.full((len(grp), FIRSTS), np.iinfo(np.int64).max)
            for k, f in enumerate(firsts):
                least[k, : len(f)] = f
            top = np.arange(len(grp))  # a row's tree
            for forest in (False,) if whole else (True, False):
                live, k = np.arange(len(grp) - 1), 1
                while len(live):
                    live = live[live + k < len(grp)]
                    live = live[(grp[live] == grp[live + k]) & (n[live + k] * PERCENT <= n[live] * 100)]
                    open_ = live[(top[live] != top[live + k]) & (cid[live] != cid[live + k])]
                    for at in range(0, len(open_), 1 << 16):
                        i = open_[at : at + (1 << 16)]
                        j = i + k
                        both = n[i] + n[j]
                        differ, sure = _differ(small, maps, n, halves, i, j)
                        take = sure if forest else (100 - PERCENT) * both >= (100 + PERCENT) * differ
                        i, j = i[take], j[take]
                        before = ((least[i][:, :, None] == least[j][:, None, :]) & (least[i] < grp[i][:, None])[:, :, None]).any((1, 2))
                        for x, y, given in zip(i.tolist(), j.tolist(), before.tolist(), strict=True):
                            if top[x] != top[y]:
                                if not given:
                                    p, q = sorted((int(cid[x]), int(cid[y])))
                                    seen.add((p, q, forest))
                                    if len(seen) >= HELD:
                                        yield _pairs(seen)
                                        seen = set()
                                if forest:
                                    part = top[np.searchsorted(grp, grp[y]) : np.searchsorted(grp, grp[y], side="right")]
                                    part[part == top[y]] = top[x]
                    k += 1
        if seen:
            yield _pairs(seen)
        seen = set()
        release()

    return run


def _pairs(seen: set) -> pa.RecordBatch:
    a, b, sure = zip(*seen, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])


def tree_links(one: np.ndarray, others: list[np.ndarray]) -> list[bool]:
    """Which of ``others`` link with ``one``; all are in global order.

    The sets in lexicographic order are the leaves of their prefix tree from left to right; what
    two neighbours share is their common path, whose overlap is counted once.  A path whose
    tokens miss ``one`` more often than the longest set's length allows ends the subtree below.
    """
    n = len(one)
    order = sorted(range(len(others)), key=lambda i: others[i].astype(">u8").tobytes())
    linked = [False] * len(others)
    most = max((len(o) for o in others), default=0)
    spare = ((100 * most) - PERCENT * n) // (100 + PERCENT)  # misses that the longest set could bear
    path, hits, dead = np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), None
    for i in order:
        o = others[i]
        m = min(len(path), len(o))
        differ = np.flatnonzero(path[:m] != o[:m])
        common = int(differ[0]) if len(differ) else m
        if dead is not None and common >= dead:
            continue
        tail = o[common:]
        at = np.searchsorted(one, tail)
        found = (at < n) & (one[np.minimum(at, n - 1)] == tail)
        hits = np.concatenate([hits[: common + 1], hits[common] + np.cumsum(found)])
        path = o
        missed = np.arange(len(hits)) - hits > spare
        dead = int(np.argmax(missed)) if missed[-1] else None
        both = int(hits[-1])
        linked[i] = 100 * both >= PERCENT * (n + len(o) - both)
    return linked


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, level: np.ndarray, seed: int) -> DataFrame:
    """``a, b, linked`` of each pair, by the sets of the classes' first documents."""
    pairs = pairs.select("a", "b")
    sizes = pairs.join(classes.select(F.col("cid").alias("b"), "n"), "b").groupBy("a").agg(F.ceil(F.greatest(F.count("*") / TREE, F.sum("n") / TREE_SHINGLES)).alias("m"))
    dealt = pairs.join(written(sizes, "sizes"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("m")).alias("part"), "b")
    member = written(dealt.select("a", "part", F.col("b").alias("cid")).unionByName(dealt.select("a", "part", F.col("a").alias("cid")).distinct()), "members")
    needed = written(member.select("cid").distinct().join(classes.select("cid", "rep"), "cid"), "needed")
    low, high = FILTER_WORDS
    width = min(high, max(low, (needed.count() // 4).bit_length()))
    h, bit = F.xxhash64("rep"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(rep), {58 - width}) & 63 as int))")
    words = needed.groupBy(F.shiftrightunsigned(h, 64 - width).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()  # as many rows as words
    bits = np.zeros(1 << width, dtype=np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    bits = bits.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 1):
            hashed = part.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            wanted = (bits[(hashed >> np.uint64(64 - width)).astype(np.int64)] >> ((hashed >> np.uint64(58 - width)) & np.uint64(63))) & np.uint64(1) == 1
            part = part.filter(pa.array(wanted))
            sets = shingle_sets(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([class_of(s, seed) if len(s) else None for s in sets], pa.int64()), pa.array([ordered(s, level).tobytes() for s in sets], pa.binary())], names=["rep", "cid", "grams"])
        release()

    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = texts.mapInArrow(run, "rep long, cid long, grams binary").join(needed.hint("merge"), ["cid", "rep"]).select("cid", "grams")
    grams = member.hint("merge").join(sets, "cid")

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("cid")
        hub = rows["cid"] == key[0]
        rest = rows[~hub]
        one = np.frombuffer(rows[hub]["grams"].iloc[0], dtype=np.uint64)
        linked = tree_links(one, [np.frombuffer(g, dtype=np.uint64) for g in rest["grams"]])
        return pd.DataFrame({"a": key[0], "b": rest["cid"].to_numpy(), "linked": linked})

    return written(grams.select("a", "part", "cid", "grams").groupBy("a", "part").applyInPandas(walk, "a long, b long, linked boolean"), "verified")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs``.

    Two documents link when the Jaccard similarity of their shingle sets is at least ``PERCENT``.
    A null text and a text without words have no shingles and are components of their own, as is
    a row whose ``doc_id`` is null (its component is null, and it links nothing).  Rows that
    repeat an id are documents of that id.  Other columns are ignored; an empty table gives no
    row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low, high = SKETCH_BITS
    counters = 1 << min(high, max(low, (docs.count() >> SKETCH_DOCUMENTS).bit_length()))
    for seed in itertools.count():
        shingled, sketch = _classes(docs, counters, seed)
        named = shingled.where("cid is not null and doc_id is not null")
        each = named.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), (F.min("check") == F.max("check")).alias("one"))
        classes = written(each, "classes")
        if classes.where("not one").isEmpty():
            break
    level, hot = _levels(sketch, counters)
    prefixes = _prefixes(docs.where("doc_id is not null"), level, hot, seed).repartition("key", F.when(F.col("n") < 0, F.pmod("cid", F.lit(SALTS))).otherwise(0)).sortWithinPartitions("key", "n", "cid")
    every = written(prefixes.mapInArrow(_met(FEW), "grp long, cid long, other long, need int, hot long"), "met")
    met = every.where("grp is not null").select("grp", "cid")
    if not every.where("hot is not null").isEmpty():
        met = written(met.unionByName(_blocks_of_hot(every)), "groups")
    few = every.where("other is not null").groupBy(F.col("cid").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("m"), F.first("need").alias("need"))
    few = few.where("m >= need").select("a", "b", F.lit(False).alias("sure"))

    lone = every.where("other is null and grp is null and hot is null").select(F.lit(None).cast("long").alias("grp"), "cid")
    many = every.where("hot is not null").groupBy("cid").agg(F.count("*").alias("hot"))
    groups = lone.unionByName(met).groupBy("cid").agg(F.count_if(F.col("grp").isNull()).alias("alone"), F.slice(F.sort_array(F.collect_set("grp")), 1, FIRSTS).alias("firsts"), F.count("grp").alias("groups")).where("groups > 0")
    groups = groups.join(many, "cid", "left")
    enough = F.col("alone") + F.col("groups") + F.coalesce("hot", F.lit(0)) >= F.least(F.lit(SHARED), F.ceil(F.col("n") * PERCENT / 100))
    known = written(classes.join(groups.hint("merge"), "cid").where(enough).select("cid", "n", "bitmap", "firsts"), "known")

    def pairs(members: DataFrame, whole: bool, more: DataFrame | None = None) -> DataFrame:
        there = members.join(known.hint("merge"), "cid").select("grp", "n", "cid", "bitmap", "firsts").repartition("grp").sortWithinPartitions("grp", "n", "cid")
        found = there.mapInArrow(_similar(whole), "a long, b long, sure boolean")
        found = found if more is None else found.unionByName(more)
        return written(found.groupBy("a", "b").agg(F.max("sure").alias("sure")), "pairs")

    first = pairs(met, False, few)
    verified = _verified(first, classes, docs, level, seed)
    links = verified.where("linked").select("a", "b")
    wrong = written(verified.where("not linked").join(first.where("sure"), ["a", "b"], "left_semi"), "wrong")
    if not wrong.isEmpty():
        near = roots(first.select("a", "b"))
        bad = near.join(wrong.select(F.col("a").alias("node")), "node", "left_semi").select("root").distinct()
        ends = near.join(bad, "root", "left_semi").select(F.col("node").alias("cid"))
        groups = met.join(ends, "cid", "left_semi").select("grp").distinct()
        again = pairs(met.join(groups, "grp", "left_semi"), True).join(verified, ["a", "b"], "left_anti")
        links = links.unionByName(_verified(again, classes, docs, level, seed).where("linked").select("a", "b"))
    top = roots(links).select(F.col("node").alias("cid"), "root")
    rooted = written(classes.select("cid", "rep").join(top, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), "rep"), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    found = written(rooted.join(least, "root").select("cid", "component_id"), "found")
    return shingled.join(found.hint("merge"), "cid", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the least of its component: one document of each.

    Of rows that repeat both id and text one stays; rows that repeat an id with different texts
    stay if the id is their component's.  Rows with a null id stay, all of them; an empty table
    gives no row.
    """
    later = similar_documents(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__later")).distinct()
    key = F.col("doc_id").cast("long")
    kept = docs.join(written(later, "later"), key == F.col("__later"), "left_anti")
    repeated = written(docs.groupBy(key.alias("__twice")).agg(F.count("*").alias("n")).where("n > 1 and __twice is not null").select("__twice"), "repeated")
    if repeated.isEmpty():
        return kept
    twice = key == F.col("__twice")
    once = kept.join(repeated, twice, "left_semi").withColumn("__id", key).dropDuplicates(["__id", "text"]).drop("__id")
    return kept.join(repeated, twice, "left_anti").unionByName(once)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    return similar_documents(table(spark, sf_dir, "documents"))

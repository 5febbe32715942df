"""Best-fit packing of tokenised documents into fixed-length sequences.

``token_pieces`` turns documents into pieces of at most ``capacity`` ids; ``pack`` places rows
with a ``length`` into bins by best-two-fit.  Bins are filled inside groups of rows dealt by a
hash of their key, so the work is spread over the cluster and no group grows with the data; a
group of some thousands of pieces leaves well under one bin in a thousand unfilled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import release, table
from paperloom.llm.tokens import ByteBpe, closed, default_vocabulary, together

CAPACITY = 2048
#: Documents that share a packing group, on average.
GROUP_DOCUMENTS = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of each document: its ids, then ``separator``; only longer ones are cut.

    The cut pieces have ``capacity`` ids but for the first, which takes what is left over.
    A null or empty text is its separator alone; a null ``doc_id`` stays null; repeated rows are
    separate documents.  Other columns of ``docs`` are ignored.
    """
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path)
        for part in (x for batch in batches for x in together(batch, 1)):
            ids, bounds = closed(*bpe.encode_all(part.column(1)), separator)
            wide = memoryview(ids.astype("<u4")).cast("B")
            rows: list[tuple] = []
            for doc, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                first = (b - a) - (math.ceil((b - a) / capacity) - 1) * capacity
                at = a
                for k, stop in enumerate(range(a + first, b + 1, capacity)):
                    rows.append((doc, k, at - a, stop - at, zlib.crc32(wide[4 * at : 4 * stop])))
                    at = stop
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        bpe.forget()  # the worker lives on beside the work of later stages
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(bin, offset)`` of each item, and the number of bins.

    Each bin is opened with the longest item that is left and filled greedily with the longest
    that still fits.  If that leaves a gap, the bin's smallest item is exchanged, once, for the two
    unpacked items that fill the gap, as it is with that item gone, most tightly; only a
    tighter fill is taken.
    """
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacity + 1)
    first = np.concatenate([[0], np.cumsum(left)[:-1]])  # the items of a length stand together in ``order``
    below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))  # the longest length with items that is not above
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def renew(length: int) -> None:
        if left[length] in (0, 1):  # it came or went: the answers up to the next length with items change
            stop = length + 1
            while stop <= capacity and not left[stop]:
                stop += 1
            below[length:stop] = length if left[length] else below[length - 1] if length else 0

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            renew(length)

    k = 0
    while below[capacity]:
        held = [int(below[capacity])]
        take(held[0])
        gap = capacity - held[0]
        while gap and (best := int(below[gap])):
            held.append(best)
            take(best)
            gap -= best
        if gap and len(held) > 1:
            wide = gap + held[-1]  # what fits greedily comes in falling order: the last one is the smallest
            ones = np.flatnonzero(left[1 : wide + 1]) + 1
            if len(ones):
                twos = below[wide - ones]
                twos = np.where((twos == ones) & (left[ones] < 2), below[np.maximum(ones - 1, 0)], twos)
                fill = np.where(twos > 0, ones + twos, 0)
                at = int(np.argmax(fill))
                if fill[at] > held[-1]:
                    back = held.pop()
                    left[back] += 1
                    if left[back] == 1:
                        renew(back)
                    for x in (int(ones[at]), int(twos[at])):
                        held.append(x)
                        take(x)
        at = 0
        for x in held:
            item = order[first[x]]
            first[x] += 1
            bins[item], offsets[item] = k, at
            at += x
        k += 1
    return bins, offsets, k


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, gapless from 0.

    ``length`` must be from 1 to ``capacity``.  Rows are dealt by all that they hold and by their
    place in their partition, so neither a frequent or null id nor rows alike in everything, of
    which there may be millions, are a group of their own; the latter may trade places.
    """
    out = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    kept = [f.name for f in out]

    def place(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*key, *[c for c in kept if c not in key]], kind="stable", ignore_index=True)
        bins, offsets, _ = best_two_fit(rows["length"].to_numpy(np.int64), capacity)
        return rows[kept].assign(sequence_id=bins + (int(key_[0]) << 40), offset=offsets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"
    dealt = pieces.select(*kept, F.pmod(F.xxhash64(*kept, F.monotonically_increasing_id()), F.lit(groups)).alias("__group"))
    return dealt.groupBy("__group").applyInPandas(place, schema)


def groups_for(docs: DataFrame) -> int:
    return max(1, math.ceil(docs.count() / GROUP_DOCUMENTS))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every document of ``docs``.

    A null or empty text is its separator alone, a null id stays null, repeated rows are packed
    each, a text of any length is cut and never shortened; an empty table gives no row.
    """
    return pack(token_pieces(docs, capacity, separator, vocabulary), groups_for(docs), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents"))

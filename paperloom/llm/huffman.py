"""Token ids on disk in a canonical, length-limited Huffman code.

File format: a Parquet table of independent blocks, one or more per range of ``doc_id``, and a
code table beside it.  A block has its place (``bucket``, ``block``, ``first_token``), its
documents (``doc_ids``, ``doc_tokens``), for each run of ``LANE`` ids of a document the bits
that it takes (``lane_bits``, unsigned 16 bits; the running sums are the checkpoints), and the
``payload``, in which each document starts on a byte.  ``<path>/code`` has ``id, bits`` for each
id that occurs; codes are canonical, so lengths are all that decoding needs.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import shared_path, table, written
from paperloom.llm.tokens import ByteBpe, binaries, closed, default_vocabulary, together

#: Longest code; 2 ** MAX_BITS must be at least the number of different ids.
MAX_BITS = 16
#: Ids between two checkpoints.
LANE = 64
#: Ids of a block, at most, unless it is a single longer document.
BLOCK_TOKENS = 1 << 17
#: Ids of a range of documents, on average, and ranges at most: beyond, ranges grow instead.
RANGE_TOKENS = 1 << 22
MOST_RANGES = 1 << 15
IDS = 1 << 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``max_bits`` for the ids with a count, by package-merge; 0 for the others.

    Ties go to the smaller id, so that equal counts always give the same code.
    """
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(ids) > 1 << max_bits:
        raise ValueError(f"{len(ids)} ids do not fit codes of {max_bits} bits")
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    leaves = sorted((int(counts[i]), 0, int(i)) for i in ids)
    weights = np.array([w for w, _, _ in leaves], dtype=np.float64)
    # A level's list is merged from the leaves and from pairs of the level below.  What counts
    # in the end is how many of each list's first items are leaves.
    marks, now = [], weights
    levels = []
    for _ in range(max_bits):
        levels.append(now)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        marks.append(order < len(weights))
        now = both[order]
    marks = [np.ones(len(weights), dtype=bool), *marks[:-1]]
    need, got = 2 * len(weights) - 2, np.zeros(len(weights), dtype=np.int64)
    for is_leaf in reversed(marks):
        taken = int(is_leaf[:need].sum())
        got[:taken] += 1
        need = 2 * (need - taken)
    for (_, _, i), n in zip(leaves, got, strict=True):
        lengths[i] = n
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: in order of length, then id."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint32), 0, 0
    ids = np.flatnonzero(lengths)
    for i in ids[np.lexsort((ids, lengths[ids]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each value of the next ``max_bits`` bits."""
    symbol, bits, codes = np.zeros(1 << max_bits, dtype=np.uint16), np.zeros(1 << max_bits, dtype=np.uint8), canonical(lengths)
    for i in np.flatnonzero(lengths):
        free = max_bits - int(lengths[i])
        at = int(codes[i]) << free
        symbol[at : at + (1 << free)] = i
        bits[at : at + (1 << free)] = lengths[i]
    return symbol, bits


def encode(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """``(payload, lane_bits)`` of each document."""
    sizes = np.array([len(d) for d in docs])
    if not sizes.sum():
        return [(b"", b"")] * len(docs)
    ids = np.concatenate(docs)
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    stops = np.cumsum(sizes)
    before = np.concatenate([[0], ends])
    doc_bits = before[stops] - before[stops - sizes]
    doc_bytes = (doc_bits + 7) // 8
    doc_at = np.concatenate([[0], np.cumsum(doc_bytes)])
    at = ends - n + np.repeat(doc_at[:-1] * 8 - before[stops - sizes], sizes)
    byte = at >> 3
    value = codes[ids].astype(np.int64) << (24 - n - (at & 7))
    starts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    value, byte = np.bitwise_or.reduceat(value, starts), byte[starts]
    out = np.zeros(int(doc_at[-1]) + 3, dtype=np.uint8)
    for k in range(3):
        out[byte + k] |= (value >> (16 - 8 * k) & 255).astype(np.uint8)
    whole = out.tobytes()
    result = []
    for d in range(len(docs)):
        a, b = int(stops[d] - sizes[d]), int(stops[d])
        lanes = np.add.reduceat(n[a:b], np.arange(0, b - a, LANE)).astype("<u2").tobytes() if b > a else b""
        result.append((whole[int(doc_at[d]) : int(doc_at[d + 1])], lanes))
    return result


def decode(payload: bytes, doc_tokens: np.ndarray, lane_bits: np.ndarray, symbol: np.ndarray, bits: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """The ids of a block: all lanes take a step at a time."""
    total = int(doc_tokens.sum())
    out = np.zeros(total, dtype=np.uint16)
    if not total:
        return out
    lanes = (doc_tokens + LANE - 1) // LANE
    doc_of = np.repeat(np.arange(len(doc_tokens)), lanes)
    bit_before = np.concatenate([[0], np.cumsum(lane_bits.astype(np.int64))])
    lane_stop = np.cumsum(lanes)
    doc_bits = bit_before[lane_stop] - bit_before[lane_stop - lanes]
    doc_at = np.concatenate([[0], np.cumsum((doc_bits + 7) // 8)])[:-1] * 8
    at = bit_before[:-1] + (doc_at - bit_before[lane_stop - lanes])[doc_of]
    k = np.arange(len(doc_of)) - (lane_stop - lanes)[doc_of]
    place = (np.cumsum(doc_tokens) - doc_tokens)[doc_of] + k * LANE
    left = np.minimum(LANE, doc_tokens[doc_of] - k * LANE)
    raw = np.frombuffer(payload + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    order = np.argsort(-left, kind="stable")
    at, place, left = at[order], place[order], left[order]
    for step in range(LANE):
        live = int(np.searchsorted(-left, -step, side="left"))
        if not live:
            break
        p = at[:live]
        seen = (window[p >> 3] >> (24 - max_bits - (p & 7)).astype(np.uint32)) & np.uint32((1 << max_bits) - 1)
        out[place[:live] + step] = symbol[seen]
        at[:live] = p + bits[seen]
    return out


def _tokenised(docs: DataFrame, end: int, vocabulary: str) -> DataFrame:
    """``doc_id, mix, tokens, low, high`` (a hash of the text, the ids' bytes) of each document, and from each task a row with its ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = ByteBpe.of(vocabulary), np.zeros(IDS, dtype=np.int64)
        for part in (x for batch in batches for x in together(batch, 2)):
            ids, bounds = closed(*bpe.encode_all(part.column(2)), end)
            counts += np.bincount(ids, minlength=IDS)
            n = part.num_rows
            yield rows(part.column(0), part.column(1), pa.array(np.diff(bounds), pa.int32()), binaries((ids & 255).astype(np.uint8), bounds), binaries((ids >> 8).astype(np.uint8), bounds), pa.nulls(n, pa.binary()))
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())]
        yield rows(*none, pa.array([counts.astype("<i8").tobytes()], pa.binary()))

    def rows(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "mix", "tokens", "low", "high", "counts"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mix"), text.alias("text")).mapInArrow(run, "doc_id long, mix long, tokens int, low binary, high binary, counts binary")


def _global_counts(ids: DataFrame) -> np.ndarray:
    """Counts over all documents; what comes to the driver is a number for each id of the vocabulary."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0).to_pylist():
                n = np.frombuffer(one, dtype="<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["id", "n"])

    per_id = ids.where("counts is not null").select("counts").mapInArrow(spread, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(IDS, dtype=np.int64)
    for row in per_id.collect():
        counts[row["id"]] = row["n"]
    return counts


def _key(doc: int | None, mix: int) -> tuple:
    """Places a document in the archive: null ids first, then by id; rows that repeat an id by the hash of their text."""
    return (doc is not None, doc or 0, mix)


def _ranges(ids: DataFrame, total: int) -> tuple[list[tuple], list[int]]:
    """The least key of each range of documents, ascending, and the ids before it; their number is bounded by ``MOST_RANGES``.

    Spark's own range partitioning deals the narrow keys, so a range is a partition of its.
    """
    ranges = min(MOST_RANGES, max(1, math.ceil(total / RANGE_TOKENS)))
    keys = ids.where("counts is null").select("doc_id", "mix", "tokens").repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), "mix")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "mix"))
    each = keys.groupBy(F.spark_partition_id().alias("p")).agg(first.alias("first"), F.sum("tokens").alias("n")).collect()
    each.sort(key=lambda r: r["p"])
    before = np.cumsum([0, *(r["n"] for r in each)])
    return [_key(r["first"]["doc_id"], r["first"]["mix"]) for r in each], before[:-1].tolist()


def write_archive(docs: DataFrame, path: str, end: int = 2, vocabulary: str | None = None) -> None:
    """Encode every document of ``docs`` (null or empty text: its ``end`` alone) into an archive at ``path`` in ascending order of ``doc_id``.

    The files, by name, hold the blocks in order.  Null ids come first; rows that repeat an id stay
    separate documents, in the order of a hash of their texts.  A document is never cut, so a
    very long one makes a block of its own.  Other columns of ``docs`` are ignored, and an empty
    table makes an archive without blocks.
    """
    spark = docs.sparkSession
    ids = written(_tokenised(docs, end, vocabulary or default_vocabulary()), "ids", compression="zstd")
    counts = _global_counts(ids)
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    first, bases = _ranges(ids, int(counts.sum()))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                docs = [np.frombuffer(a, dtype=np.uint8).astype(np.uint16) | np.frombuffer(b, dtype=np.uint8).astype(np.uint16) << 8 for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                done = encode(docs, lengths, codes)
                bucket = [bisect.bisect_right(first, _key(d, m)) - 1 for d, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), part.column(0), part.column(1), pa.array([len(d) for d in docs], pa.int32()), pa.array([a for a, _ in done], pa.binary()), pa.array([b for _, b in done], pa.binary())], names=["bucket", "doc_id", "mix", "tokens", "payload", "lanes"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, at, held, size = None, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            row = {"bucket": [now], "block": [number], "first_token": [at], "doc_ids": [[h[0] for h in held]], "doc_tokens": [[h[1] for h in held]], "lane_bits": [b"".join(h[3] for h in held)], "payload": [b"".join(h[2] for h in held)]}
            return pa.RecordBatch.from_pydict(row, schema=BLOCKS)

        for batch in batches:
            for b, *doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (b != now or size + doc[1] > BLOCK_TOKENS):
                    yield close()
                    at, number, held, size = at + size, number + 1, [], 0
                if b != now:
                    now, number, at = b, 0, bases[b]
                held.append(doc)
                size += doc[1]
        if held:
            yield close()

    coded = ids.where("counts is null").select("doc_id", "mix", "low", "high").mapInArrow(compress, "bucket int, doc_id long, mix long, tokens int, payload binary, lanes binary")
    dealt = coded.repartitionById(max(1, len(first)), "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "mix").select("bucket", "doc_id", "tokens", "payload", "lanes")
    dealt.mapInArrow(block, "bucket int, block int, first_token long, doc_ids array<long>, doc_tokens array<int>, lane_bits binary, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    seen = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in seen], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")


BLOCKS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("lane_bits", pa.binary()), ("payload", pa.binary())])


def read_archive(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document as decoded from the blocks; with ``ids`` (unsigned 16 bits, little-endian) if asked for."""
    lengths = np.zeros(IDS, dtype=np.uint8)
    for row in spark.read.schema("id int, bits int").parquet(f"{path}/code").collect():
        lengths[row["id"]] = row["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, bits = decoding_table(lengths)
        for batch in batches:
            for first, docs, tokens, lanes, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = np.array(tokens, dtype=np.int64)
                ids = decode(payload, sizes, np.frombuffer(lanes, dtype="<u2"), symbol, bits)
                stops = np.cumsum(sizes)
                each = [ids[b - n : b] for b, n in zip(stops, sizes, strict=True)]
                got = [pa.array(docs, pa.int64()), pa.array(first + stops - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(got + ([pa.array([x.tobytes() for x in each], pa.binary())] if with_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    blocks = spark.read.schema("first_token long, doc_ids array<long>, doc_tokens array<int>, lane_bits binary, payload binary").parquet(f"{path}/blocks")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, encoded into an archive in ascending order of ids and decoded from it."""
    path = shared_path(spark, "archive")
    write_archive(table(spark, sf_dir, "documents"), path)
    return read_archive(spark, path)

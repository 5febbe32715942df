"""Packing, separator scan and Huffman archive against the tokenizer itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import huffman as H
from paperloom.llm.packing import CAPACITY, best_two_fit, pack_documents
from paperloom.llm.separators import END, count_tokens, token_counts
from paperloom.llm.tokens import ByteBpe, default_vocabulary
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return t


def test_ids_are_the_librarys(tokenizer):
    random.seed(5)
    bpe = ByteBpe(default_vocabulary())
    odd = ["a  b\n\n c\x1d\x1e d\x1f  ", "it's 'll don't\t\tx 9,9 ü　　a\xa0b <|endoftext|> 日本語 😀 \r\n x", "a\x85\x85b", "a" * 3000]
    for text in odd + ["".join(random.choice(" \n\t\x1c\xa0 a'sé1,😀l!Z") for _ in range(80)) for _ in range(300)]:
        assert np.frombuffer(bpe.encode(text), dtype="<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_many_texts_are_the_librarys():
    library = Tokenizer.from_file(default_vocabulary())
    random.seed(15)
    texts = [None, "", " ", "a", " a", "a ", "\n ", " \n", "\n \nb", "it's 'll ''s o'clock 're's x 'd", "'s", "<|endoftext|>", "a <|endoftext|>'s", "x　 　y", "１２ ²Ⅻ ب٣", "😀😀 é'll", "w" * 5000, "a  b\n\n c\x1d\x1e d\x1f  "]
    texts += ["".join(random.choice("  \n\tab'sletré1,😀　\x85\x1c\xa0Z") for _ in range(random.randint(0, 60))) for _ in range(3000)]
    ids, lengths = ByteBpe.of(default_vocabulary()).encode_all(pa.array(texts).slice(3))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts[3:]]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [k for x in want for k in x]


def test_added_tokens_are_the_unmodified_librarys(documents, tmp_path):
    library = Tokenizer.from_file(default_vocabulary())
    texts = ["a <|endoftext|> b", "a<|endoftext|><|endoftext|>  b", "<|endoftext|>", " \n<|endoftext|>\n x", "<|endoftext|", "plain  text", "it's <|ENDOFTEXT|>"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(ByteBpe.of(default_vocabulary()).encode(t), dtype="<u2").tolist() for t in texts] == want
    docs = documents(list(enumerate(texts)))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pack_documents(docs).collect()}
    assert got == {k: (len(x) + 1, zlib.crc32(np.array([*x, 0], dtype="<u4").tobytes())) for k, x in enumerate(want)}
    H.write_archive(docs, str(tmp_path / "a"))
    assert {r.doc_id: r.n_tokens for r in H.read_archive(docs.sparkSession, str(tmp_path / "a")).collect()} == {k: len(x) + 1 for k, x in enumerate(want)}
    docs.write.parquet(str(tmp_path / "d"))
    assert {r.doc_id: r.n_tokens for r in token_counts(docs.sparkSession.read.parquet(str(tmp_path / "d"))).collect()} == {k: len(x) + 1 for k, x in enumerate(want)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_bins_hold_everything_once(lengths):
    x = np.array(lengths)
    bins, offsets, k = best_two_fit(x, 20)
    assert set(bins.tolist()) == set(range(k)) and k >= -(-x.sum() // 20)
    for b in range(k):
        rows = np.flatnonzero(bins == b)
        rows = rows[np.argsort(offsets[rows])]
        assert offsets[rows].tolist() == [0, *np.cumsum(x[rows]).tolist()[:-1]] and x[rows].sum() <= 20


def test_smallest_is_exchanged_for_two():
    assert best_two_fit(np.array([10, 5, 6, 3]), 20)[2] == 2
    # 11 + 6 leaves 3; without the 6 the gap of 9 is filled by 5 + 4
    bins, _, _ = best_two_fit(np.array([11, 6, 5, 4]), 20)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_packed_documents(documents, tokenizer):
    rows = [r for r in AWKWARD if r[0] != 4] + [(20 + i, "word " * (i * 13)) for i in range(60)]
    got = pack_documents(documents(rows).selectExpr("*", "1 as piece", "2 as sequence_id")).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= CAPACITY
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
    for doc, text in rows:
        mine = got[got["doc_id"].isna() if doc is None else got["doc_id"] == doc].sort_values("piece")
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert mine["length"].sum() == len(ids) and (mine["length"].iloc[1:] == CAPACITY).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert pack_documents(documents([])).count() == 0


def test_packing_of_repeated_rows_and_ids(documents):
    rows = [(4, "one two")] * 5 + [(4, f"text {i} " * i) for i in range(40)] + [(None, f"other {i}") for i in range(40)]
    got = pack_documents(documents(rows)).toPandas()
    assert len(got) == len(rows) and got["length"].sum() == sum(len(ByteBpe.of(default_vocabulary()).encode(t)) // 2 + 1 for _, t in rows)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= CAPACITY


def test_rows_alike_in_everything_are_no_group_of_their_own(spark):
    from paperloom.llm.packing import pack

    rows = spark.range(4000).selectExpr("cast(null as long) doc_id", "0 piece", "cast(100 as long) length").repartition(4)
    got = pack(rows, 16).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["sequence_id"] >> 40, []).append(r["offset"])
    assert len(got) == 4000 and len(groups) == 16 and max(map(len, groups.values())) < 400


def test_token_counts_with_several_files_of_a_task(documents, spark, tokenizer):
    """With a limit on the rows of a file a task writes several: their whole names tell them apart."""
    rows = [(k, f"text {k} " * (k % 5)) for k in range(60)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts(documents(rows).repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in rows}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=30), st.integers(5, 12))
def test_code_is_a_prefix_code_of_bounded_length(weights, bits):
    counts = np.zeros(H.IDS, dtype=np.int64)
    counts[: len(weights)] = weights
    n = H.code_lengths(counts, bits)[: len(weights)].astype(int)
    assert n.min() >= 1 and n.max() <= bits and (0.5**n).sum() <= 1
    if len(weights) > 1 and bits >= 11:
        import heapq

        heap, total = list(weights), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            total += both
            heapq.heappush(heap, both)
        if n.max() < bits:
            assert (n * np.array(weights)).sum() == total


def test_blocks_decode_to_what_was_encoded():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 300, n).astype(np.uint16) for n in (0, 1, 63, 64, 65, 1000, 0, 7)]
    lengths = H.code_lengths(np.bincount(np.concatenate(docs), minlength=H.IDS))
    coded = H.encode(docs, lengths, H.canonical(lengths))
    sizes = np.array([len(d) for d in docs])
    got = H.decode(b"".join(a for a, _ in coded), sizes, np.frombuffer(b"".join(b for _, b in coded), dtype="<u2"), *H.decoding_table(lengths))
    assert (got == np.concatenate(docs)).all()


def test_archive_round_trip(documents, tokenizer, spark, tmp_path):
    docs = documents(AWKWARD).selectExpr("*", "1 as tokens", "'x' as payload")
    H.write_archive(docs, str(tmp_path / "a"))
    got = H.read_archive(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in order]
    at = 0
    for r, (_, text) in zip(got, order, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) and r.ids == ids.astype("<u2").tobytes()
        at += len(ids)
    H.write_archive(documents([]), str(tmp_path / "e"))
    assert H.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_archive_files_are_in_ascending_order(documents, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "RANGE_TOKENS", 500)
    monkeypatch.setattr(H, "BLOCK_TOKENS", 100)
    random.seed(12)
    ids = random.sample(range(-5000, 5000), 700) + [None] * 60 + [77] * 60
    rows = [(d, " ".join(random.choice("abcd") for _ in range(random.randint(0, 20)))) for d in ids]
    H.write_archive(documents(rows).repartition(7), str(tmp_path / "a"))
    files = sorted((tmp_path / "a" / "blocks").glob("part-*.parquet"))
    got = [d for f in files for r in pq.read_table(f).to_pylist() for d in r["doc_ids"]]
    assert len(files) > 3 and got == sorted(ids, key=lambda d: (d is not None, d or 0))
    first = [r["first_token"] for f in files for r in pq.read_table(f).to_pylist()]
    assert first == sorted(first) and len(set(first)) == len(first)
    starts = [(r.start, r.n_tokens) for r in H.read_archive(spark, str(tmp_path / "a")).orderBy("start").collect()]
    assert [a for a, _ in starts] == np.cumsum([0, *(n for _, n in starts)])[:-1].tolist()


def test_separators_across_blocks_and_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    stream = np.concatenate([x for n in [0, 5, 1, 0, 40, 3, 17, 2] for x in (rng.integers(0, 50, n), [END])] + [rng.integers(0, 50, 4)]).astype(">u2")
    for k, part in enumerate(np.split(stream, [9, 10, 55])):
        (tmp_path / f"f{k}.bin").write_bytes(part.tobytes())
    (tmp_path / "f9.bin").write_bytes(b"")
    ends = np.flatnonzero(stream == END)
    want = [(int(a), int(b - a), True) for a, b in zip([0, *(ends[:-1] + 1)], ends + 1, strict=True)] + [(int(ends[-1]) + 1, 4, False)]
    for block in (1, 7, 1 << 18):
        got = count_tokens(spark, str(tmp_path), block=block).orderBy("start").collect()
        assert [(r.start, r.n_tokens, r.closed) for r in got] == want


def test_token_counts_do_not_depend_on_how_files_are_read(documents, spark, tmp_path):
    random.seed(7)
    rows = [(i, "word " * random.randint(0, 300)) for i in range(300)] + [(None, None), (5, "again"), (5, "again")]
    path = str(tmp_path / "d")
    documents(rows).repartition(5).write.parquet(path)
    want = sorted((d or 0, len(ByteBpe.of(default_vocabulary()).encode(t)) // 2 + 1) for d, t in rows)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes") if spark.conf.get(k, None)}
    try:
        counted = token_counts(spark.read.parquet(path))  # its flat files are written now, the rest is read later
        spark.conf.set("spark.sql.files.minPartitionNum", "13")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = counted.orderBy("start").collect()
    finally:
        for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert token_counts(documents([]).selectExpr("*", "1 as ordinal", "2 as part")).count() == 0


def test_token_counts(documents, tokenizer, tmp_path):
    path = str(tmp_path / "d")
    documents(AWKWARD).repartition(3).write.parquet(path)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(documents([]).sparkSession.read.parquet(path)).collect())
    assert got == sorted((d or 0, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in AWKWARD)

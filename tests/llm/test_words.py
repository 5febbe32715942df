"""New words of the tokenizer: many at once as one by one; no cache outlives a packing task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from paperloom.llm import packing, tokens


def test_words_at_once_are_words_one_by_one(monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 3)
    bpe = tokens.ByteBpe(tokens.default_vocabulary(), False)
    words = [bytes([b]) for b in range(256)] + [w.encode() for w in (" house", "ünïcödé", "𝄞𝄞", "\n\n ", "'ll", "12345678901234567890", "x" * 300, " <|endoftext|>")]
    one = [np.array([t.id for t in bpe.model.tokenize(w.decode("latin-1").translate(bpe.letters))], dtype=np.uint16).tobytes() for w in words]
    assert bpe._each(words) == one and bpe._each([]) == []
    texts = ["a house, a mouse", None, "", "ünïcödé 𝄞𝄞's\n\n 12 " * 40, "x" * 300]
    for _ in range(2):  # without and with the cache
        ids, n = bpe.encode_all(pa.array(texts))
        assert ids.tobytes() == b"".join(map(bpe.encode, texts)) and n.tolist() == [len(bpe.encode(t)) // 2 for t in texts]


def test_no_cache_outlives_a_packing_task(spark, documents):
    def held(batches):
        bpe = tokens.ByteBpe.of(tokens.default_vocabulary())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.words) + len(bpe.pieces)] * batch.num_rows, pa.int64())], names=["n"])

    docs = documents([(k, f"words of document {k}") for k in range(200)]).coalesce(1)
    assert packing.token_pieces(docs).count() == 200
    assert {r["n"] for r in docs.select("doc_id").mapInArrow(held, "n long").collect()} == {0}

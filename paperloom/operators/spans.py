"""Character offsets of pieces of a text, and literal matches mapped to the pieces that they cross.

Pieces lie end to end, so running sums of their lengths place them, and one sweep over the ends
of pieces and matches, in the order of places, cuts both against each other: its work is linear
in pieces and matches, where comparing each match with each piece would not be.

Where the pieces are a text's own words they stand in one row already: ``text_places`` counts them
there, with Arrow, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.registry import Tables, query


def quoted(literal: str) -> str:
    """A regular expression of the literal alone."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def offsets(pieces: DataFrame, key: list[str], order: list[str], text: str = "text") -> DataFrame:
    """``pieces`` with ``start`` and ``stop``: the characters of their key's text before and up to each, in their order; a null text has none."""
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return pieces.withColumn("stop", F.sum(size).over(upto)).withColumn("start", F.col("stop") - size)


def matches(texts: DataFrame, key: list[str], literal: str, text: str = "text") -> DataFrame:
    """``key, nth, start, stop`` of each occurrence of ``literal`` in the texts, from the left without overlap, ``nth`` from 1."""
    parts = texts.select(*key, F.posexplode(F.split(text, quoted(literal), -1)).alias("__k", "__piece"))
    w = Window.partitionBy(*key).orderBy("__k")
    size, before = len(literal), F.sum(F.length("__piece")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumns({"start": (before + F.col("__k") * size).cast("long"), "__more": F.lead("__k").over(w)})
    return placed.where("__more is not null").select(*key, (F.col("__k") + 1).cast("long").alias("nth"), "start", (F.col("start") + size).alias("stop"))


def crossings(pieces: DataFrame, found: DataFrame, key: list[str], columns: list[str], point: Column | None = None) -> DataFrame:
    """``key, nth, columns, a, b, inside``: for each match what it covers of each piece, as characters ``a`` to ``b`` of the piece.

    ``pieces`` have ``start`` and ``stop`` and lie end to end; those for which ``point`` holds have
    no length and count (``inside``, without ``a`` and ``b``) where a match goes on to both sides.
    """
    point = F.lit(False) if point is None else point
    piece = F.struct("start", *columns)
    none = lambda c: F.lit(None).cast(c)
    kind = pieces.select(piece.alias("p")).schema["p"].dataType
    rows = pieces.where(point | (F.col("stop") > F.col("start"))).select(*key, F.col("start").alias("at"), F.when(point, 1).otherwise(3).alias("o"), piece.alias("piece"), none("struct<nth:bigint,stop:bigint>").alias("match"))
    begin = found.select(*key, F.col("start").alias("at"), F.lit(2).alias("o"), F.lit(None).cast(kind).alias("piece"), F.struct("nth", "stop").alias("match"))
    end = found.select(*key, F.col("stop").alias("at"), F.lit(0).alias("o"), F.lit(None).cast(kind).alias("piece"), none("struct<nth:bigint,stop:bigint>").alias("match"))
    sweep = Window.partitionBy(*key).orderBy("at", "o")
    upto = sweep.rowsBetween(Window.unboundedPreceding, 0)
    every = rows.unionByName(begin).unionByName(end)
    seen = every.select(*key, "at", "o", F.col("piece").alias("own"), F.last(F.when(F.col("o") == 3, F.col("piece")), ignorenulls=True).over(upto).alias("now"), F.last("match", ignorenulls=True).over(upto).alias("match"), F.lead("at").over(sweep).alias("next"))
    seen = seen.where(F.col("match.stop") > F.col("at"))
    cut = seen.where((F.col("next") > F.col("at")) & F.col("now").isNotNull()).select(*key, "match.nth", *[F.col(f"now.{c}").alias(c) for c in columns], (F.col("at") - F.col("now.start")).alias("a"), (F.col("next") - F.col("now.start")).alias("b"), F.lit(False).alias("inside"))
    inside = seen.where("o = 1").select(*key, "match.nth", *[F.col(f"own.{c}").alias(c) for c in columns], none("long").alias("a"), none("long").alias("b"), F.lit(True).alias("inside"))
    return cut.unionByName(inside)


#: Bytes of texts that are cut together; a longer text is alone.  Rows of a batch that comes of it.
TOGETHER, ROWS = 1 << 21, 1 << 16


def _together(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, stop, raw, bounds``: runs of texts (none is null) with their bytes and where each begins in them, and the end."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every, at = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8), 0
    while at < len(texts):
        stop = max(int(np.searchsorted(bounds, bounds[at] + TOGETHER, side="right")) - 1, at + 1)
        yield at, stop, every[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at]
        at = stop


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, k, start, stop`` of each word with the blank after it, in bytes of ``raw``; an empty text, and what follows a last blank, is a word without length."""
    blanks = np.flatnonzero(raw == 0x20)
    n = np.diff(np.searchsorted(blanks, bounds)) + 1
    last = np.cumsum(n) - 1
    stop, inner = np.empty(n.sum(), dtype=np.int64), np.ones(n.sum(), dtype=bool)
    inner[last] = False
    stop[inner], stop[last] = blanks + 1, bounds[1:]
    start = np.concatenate([[0], stop[:-1]])  # texts lie end to end as well
    return np.repeat(np.arange(len(n)), n), np.arange(len(stop)) - np.repeat(last + 1 - n, n), start, stop


def _characters(raw: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """How many characters begin before a place in UTF-8."""
    begins = (raw & 0xC0) != 0x80
    if begins.all():
        return lambda at: at
    before = np.concatenate([[0], np.cumsum(begins)])
    return lambda at: before[at]


def text_places(texts: DataFrame, key: str, text: str = "text", literal: str | None = None) -> DataFrame:
    """``key, k, start, stop`` of the words of each row's text, each with the blank after it; with ``literal``, as ``crossings``, ``key, nth, k, a, b`` of what its matches cover of them.

    Every row is a text of its own, and a null one has none.  The work is linear in the texts.
    """
    names = ["k", "start", "stop"] if literal is None else ["nth", "k", "a", "b"]
    pattern = None if literal is None else re.compile(re.escape(literal.encode()))

    def places(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        of, k, start, stop = _words(raw, bounds)
        chars = _characters(raw)
        if pattern is None:
            base = chars(bounds)[of]
            return [of, k, chars(start) - base, chars(stop) - base]
        whole = raw.tobytes()
        found = [[m.start() for m in pattern.finditer(whole, a, b)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        begin = np.fromiter((x for f in found for x in f), np.int64, n.sum())
        end, nth = begin + len(literal.encode()), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        first = np.searchsorted(stop, begin, side="right")
        each = np.searchsorted(start, end, side="left") - first
        match = np.repeat(np.arange(len(begin)), each)
        piece = first[match] + np.arange(len(match)) - (np.cumsum(each) - each)[match]
        base = chars(start[piece])
        return [of[piece], nth[match], k[piece], chars(np.maximum(begin[match], start[piece])) - base, chars(np.minimum(end[match], stop[piece])) - base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, raw, bounds in _together(batch.column(1)):
                of, *values = places(raw, bounds)
                for at in range(0, len(of), ROWS):
                    rows = slice(at, at + ROWS)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + of[rows])), *(pa.array(v[rows], pa.int64()) for v in values)], names=[key, *names])

    kind = texts.schema[key].dataType.simpleString()
    return texts.where(F.col(text).isNotNull()).select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names))


WORDS = """w AS (SELECT doc_id, k - 1 AS k, string_split(text, ' ')[k] || CASE WHEN k < len(string_split(text, ' ')) THEN ' ' ELSE '' END AS text FROM documents, unnest(range(1, len(string_split(text, ' ')) + 1)) AS u(k)),
o AS (SELECT doc_id, k, text, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM w)"""


@query(f"WITH {WORDS} SELECT doc_id, k, stop - length(text) AS start, stop FROM o")
def text_offsets(t: Tables) -> DataFrame:
    """Where each piece of a text begins and ends in it."""
    return text_places(t.documents, "doc_id")


@query(f"""
WITH {WORDS},
p AS (SELECT doc_id, k, string_split(text, 'e t')[k] AS part, len(string_split(text, 'e t')) AS n FROM documents, unnest(range(1, len(string_split(text, 'e t')) + 1)) AS u(k)),
m AS (SELECT doc_id, k AS nth, n, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) + 3 * (k - 1) AS BIGINT) AS start FROM p QUALIFY k < n)
SELECT m.doc_id, nth, k, greatest(m.start, o.stop - length(text)) - (o.stop - length(text)) AS a, least(m.start + 3, o.stop) - (o.stop - length(text)) AS b FROM m JOIN o ON m.doc_id = o.doc_id AND m.start < o.stop AND o.stop - length(text) < m.start + 3""")
def match_crossings(t: Tables) -> DataFrame:
    """What each match of a literal covers of the pieces that it crosses."""
    return text_places(t.documents.where("doc_id is not null"), "doc_id", literal="e t")

"""Texts of packages written back without touching other bytes; what to write is planned by ``paperloom.plans.offsets``."""

from __future__ import annotations

from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.packages import parts
from paperloom.sources.packages import Refused


def apply_texts(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The parts of packages with the texts of ``edits`` (``doc_id, part, node_id, text``) in place of the old; bytes outside of them stay as they are."""

    def rewrite(_: tuple, here: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out = here.copy()
        if len(new):
            out["bytes"] = [replaced(bytes(b), dict(zip(new["__node"], new["__text"], strict=True))) for b in here["bytes"]]
        return out

    whole = parts(rows)
    schema = "doc_id long, part string, name string, content_type string, bytes binary"
    new = edits.select(F.col("doc_id").alias("__doc"), F.col("part").alias("__part"), F.col("node_id").alias("__node"), F.col("text").alias("__text"))
    return whole.groupBy("doc_id", "part").cogroup(new.groupBy("__doc", "__part")).applyInPandas(rewrite, schema)


def replaced(data: bytes, texts: dict[int, str]) -> bytes:
    """``data``, an XML part, with the content of the elements of those numbers (in document order) replaced.

    All other bytes stay.  New text is written in the part's own encoding; an element whose new
    text begins or ends with white space gets ``xml:space="preserve"``.  A part that has a document
    type is refused, as the reader refuses it.
    """
    encoding = "utf-8"
    spans: dict[int, dict] = {}
    open_: list[int] = []
    count = 0
    parser = expat.ParserCreate()

    def declared(_version: str, named: str | None, _standalone: int) -> None:
        nonlocal encoding
        if named and not named.lower().startswith("utf-16"):
            encoding = named

    def refuse(*_: object) -> None:
        raise Refused("E0006 document type declaration")

    def next_event(*_: object) -> None:
        at = parser.CurrentByteIndex
        for k in pending:
            spans[k]["content"] = at
        pending.clear()

    pending: list[int] = []

    def start(name: str, attrs: dict) -> None:
        nonlocal count
        next_event()
        if count in texts:
            spans[count] = {"tag": parser.CurrentByteIndex, "name": name, "kept": "xml:space" in attrs}
            pending.append(count)
        open_.append(count)
        count += 1

    def end(_: str) -> None:
        next_event()
        k = open_.pop()
        if k in spans:
            spans[k]["end"] = parser.CurrentByteIndex

    parser.XmlDeclHandler, parser.StartDoctypeDeclHandler, parser.StartElementHandler, parser.EndElementHandler = declared, refuse, start, end
    parser.CharacterDataHandler = parser.CommentHandler = parser.ProcessingInstructionHandler = parser.StartCdataSectionHandler = parser.DefaultHandler = next_event
    parser.Parse(data, True)
    for mark, wide in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        encoding = wide if data.startswith(mark) else encoding
    written = lambda text: text.encode(encoding, "xmlcharrefreplace")
    out, at = [], 0
    for k, s in spans.items():
        tag = data[s["tag"] : s["content"]].decode(encoding)
        alone = tag.endswith("/>")
        tag, tail = (tag[:-2].rstrip(), f"</{s['name']}>") if alone else (tag[:-1], "")
        space = ' xml:space="preserve"' if texts[k] != texts[k].strip() and not s["kept"] else ""
        out += [data[at : s["tag"]], written(f"{tag}{space}>{escape(texts[k])}{tail}")]
        at = s["end"]
    return b"".join(out) + data[at:]

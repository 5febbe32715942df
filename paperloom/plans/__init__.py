"""Adapters that give any corpus the relations that the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import wire


def blocks(documents: DataFrame) -> DataFrame:
    """``doc_id, ord, wire, text``: the lines of each text as the paragraphs of its main story, numbered from 1 before anything is filtered."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    n = (F.col("pos") + 1).cast("long")
    return lines.select("doc_id", n.alias("ord"), wire("M.P", n).alias("wire"), "text")


#: Event types as the revision wrapper that they stand for.
WRAPPER = {"error": "del", "purchase": "ins"}


def wrapper(event_type: Column) -> Column:
    out = F.lit("none")
    for name, kind in WRAPPER.items():
        out = F.when(event_type == name, kind).otherwise(out)
    return out

"""The corpus pipeline: documents through five stages to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of documents, and
each works on all that its predecessor kept.  Further columns pass through all stages but the last,
and an empty table gives no row in any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import written
from paperloom.llm.langid import UNKNOWN, fit_on_documents, identify
from paperloom.llm.line_dedup import dedup_lines
from paperloom.llm.mixing import repeated_by_weight
from paperloom.llm.ngram_join import first_of_each
from paperloom.llm.packing import pack_documents

#: A document whose language is this unsure is rejected: both decisions on it are near even.
LEAST_SCORE = 0.26


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter (null and empty texts too), or whose language cannot be told, go.

    A null ``lang`` becomes the predicted one.  Where no row has a language nothing can be learned,
    and every document with a letter stays as it is.  Null ids and repeated rows are judged by
    their text like any other.
    """
    model = fit_on_documents(docs)
    told = identify(docs, model, "__lang", "__score")
    sure = (F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SCORE)
    if not model.families.classes:
        sure = F.col("text").cast("string").rlike(r"\p{L}")
    filled = F.coalesce("lang", F.when(F.col("__lang") != UNKNOWN, F.col("__lang")))
    return told.where(sure).select(*[filled.alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of later repeated runs, with ``n_chars`` as they are then; a document whose every word was a repeat goes.

    Rows without an id or a text are not changed; rows that repeat both are one document.
    """
    free = "__" + "_".join(docs.columns)  # a name that no column has
    clean = dedup_lines(docs, f"{free}_lines", f"{free}_gone")
    unchanged = F.col(f"`{free}_gone`").isNull()
    left = unchanged | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return clean.where(left).select(*[F.when(unchanged, F.col(c)).otherwise(F.length("text")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id.

    Of rows that repeat id and text one stays; rows without an id, and texts without words, have
    no group and stay.
    """
    return first_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask, each once at least; a null source is a source, a text without words comes once."""
    return repeated_by_weight(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, repeated ones as often as they come; a null or empty text is its separator."""
    return pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]

#: Language identification and the byte-level BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

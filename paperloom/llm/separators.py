"""Token counts from flat token files that have no index: a scan for end-of-document ids.

A flat file is a run of big-endian unsigned 16-bit ids, in which ``END`` closes each document.
Files are read in byte ranges of ``BLOCK`` ids, each a row of its own that any task can take, and
searched with one vector comparison each.  A prefix scan over the blocks' sums, first within each
file and then over the files, gives each block the ids and the last end that stand before it, so
a document may begin in one block or file and end in a later one.  Files count in the order of
their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import shared_path, table, written
from paperloom.llm.tokens import ByteBpe, binaries, default_vocabulary, together

#: The end of a document: outside the vocabulary, and its two bytes are one UTF-8 character, so
#: that Spark's text writer can write it as a line separator.
END = 0xC480
SEPARATOR = END.to_bytes(2, "big").decode()
#: Ids of a block.
BLOCK = 1 << 20
#: Files of a range of names, and ranges at most, that a scan over files is cut into.
RANGE_FILES = 1000
FILE_RANGES = 256


def write_flat(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Flat token files of all texts (null: empty) below ``path/kind=ids``, and what stands in them below ``path/kind=places``.

    Both come from one pass: the task that writes a file of ids writes a file of ``ordinal,doc_id``
    lines with the same part number, so the two agree however the rows were dealt.
    """
    voc = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, at = ByteBpe.of(voc), 0
        for part in (x for batch in batches for x in together(batch, 1)):
            ids, lengths = bpe.encode_all(part.column(1))
            n = part.num_rows
            places = pa.array([f"{at + k},{'' if d is None else d}".encode() for k, d in enumerate(part.column(0).to_pylist())], pa.binary())
            order = pa.array(np.arange(at, at + n))
            for kind, value in (("ids", binaries(ids.astype(">u2"), np.concatenate([[0], np.cumsum(lengths)]))), ("places", places)):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * n), order, value], names=["kind", "ordinal", "value"])
            at += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, ordinal long, value binary")
    rows.sortWithinPartitions("kind", "ordinal").select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", SEPARATOR).text(path)


def _block_rows(spark: SparkSession, path: str, end: int, block: int, dtype: str) -> DataFrame:
    """``file, block, ids, ends`` of each byte range of the files below ``path``."""
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")  # contents are not read
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (block * width)))).alias("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for file, length, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", file)))
                with system.open_input_file(name) as f:
                    start = k * block * width
                    ids = np.frombuffer(f.read_at(min(block * width, length - start) // width * width, start), dtype=dtype)
                ends = np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int32()))], names=["file", "block", "ids", "ends"])

    tasks = max(1, spark.sparkContext.defaultParallelism)
    return ranges.repartition(tasks, "path", "block").mapInArrow(search, "file string, block long, ids long, ends array<int>")


def count_tokens(spark: SparkSession, path: str, end: int = END, block: int = BLOCK, dtype: str = ">u2") -> DataFrame:
    """``file, ordinal, start, n_tokens, closed`` of each document of the flat files below ``path``.

    ``file`` and ``ordinal`` (from 0) tell where the document ends, ``start`` counts the ids of
    all files before it, ``n_tokens`` includes the end.  Ids after the last end are one more
    document, not ``closed``, with the ordinal that its end would have had.  Files without ids,
    and a folder of such files, give no row; an odd byte at the end of a file is not an id.
    Executors open the files by their address (a local or shared folder, s3, gs, hdfs).
    """
    blocks = written(_block_rows(spark, path, end, block, dtype), "blocks")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    within = blocks.select("file", "block", "ids", "ends", F.coalesce(F.sum("ids").over(upto), F.lit(0)).alias("before"), F.coalesce(F.sum(F.size("ends")).over(upto), F.lit(0)).alias("docs"))
    within = within.withColumn("last", F.max(F.col("before") + last).over(upto))
    sums = within.groupBy("file").agg(F.sum("ids").alias("f_ids"), F.sum(F.size("ends")).alias("f_docs"), F.max(F.col("before") + last).alias("f_last"))

    # Over the files: within ranges of names, and over the ranges, of which there are ``FILE_RANGES`` at most.
    sums = written(sums, "sums")
    ranges = min(FILE_RANGES, max(1, math.ceil(sums.count() / RANGE_FILES)))
    files = written(sums.repartitionByRange(ranges, "file").withColumn("r", F.spark_partition_id()), "files")
    upto = Window.partitionBy("r").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    inner = files.withColumn("base", F.coalesce(F.sum("f_ids").over(upto), F.lit(0)))
    inner = inner.withColumn("carry", F.max(F.col("base") + F.col("f_last")).over(upto))
    each = inner.groupBy("r").agg(F.sum("f_ids").alias("r_ids"), F.max(F.col("base") + F.col("f_last")).alias("r_last"), F.max_by("file", "file").alias("r_file"), F.max_by("f_docs", "file").alias("r_docs")).collect()
    bases, carry, ids = [], -1, 0
    for r in sorted(each, key=lambda r: r["r"]):
        bases.append((r["r"], ids, carry))
        carry = carry if r["r_last"] is None else ids + r["r_last"]
        ids += r["r_ids"]
    over = inner.join(spark.createDataFrame(bases, "r int, r_base long, r_carry long"), "r")
    over = over.select("file", (F.col("base") + F.col("r_base")).alias("base"), F.coalesce(F.col("r_base") + F.col("carry"), "r_carry").alias("carry"))
    placed = within.join(over, "file").withColumn("prior", F.coalesce(F.col("base") + F.col("last"), F.col("carry")))
    ended = placed.where(F.size("ends") > 0).select("file", "docs", "prior", (F.col("base") + F.col("before")).alias("at"), "ends", F.posexplode("ends").alias("k", "end"))
    stop = F.col("at") + F.col("end")
    start = F.when(F.col("k") == 0, F.col("prior")).otherwise(F.col("at") + F.get("ends", F.greatest(F.col("k") - 1, F.lit(0)))) + 1
    closed = ended.select("file", (F.col("docs") + F.col("k")).alias("ordinal"), start.alias("start"), (stop - start + 1).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = [(max((r["r"], r["r_file"], r["r_docs"]) for r in each)[1:]) + (carry + 1, ids - carry - 1, False)] if ids > carry + 1 else []
    return closed.unionByName(spark.createDataFrame(tail, "file string, ordinal long, start long, n_tokens long, closed boolean"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, start, n_tokens`` of each row of ``docs`` (with its end; null or empty text: 1), from flat files written and scanned for it.

    Rows that repeat an id are documents of their own, a null id stays null, a document of any
    length is counted whole; other columns of ``docs`` are ignored and an empty table gives no row.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long")
    path = shared_path(spark, "flat")
    write_flat(docs, path, vocabulary)
    # Where files have a limit of rows a task writes several, by number; documents are counted through all of them.
    part, number = (lambda c: F.regexp_extract(c, r"([^/]+?)(\.c\d+)?\.[^./]+$", 1).alias("part")), F.regexp_extract("file", r"\.c(\d+)\.[^./]+$", 1).try_cast("int")
    found = written(count_tokens(spark, f"{path}/kind=ids").withColumn("part", part(F.col("file"))).withColumn("number", number), "found")
    upto = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("part", "number").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0))).select(F.col("part").alias("p"), F.col("number").alias("c"), "base")
    found = found.join(base, (F.col("part") == F.col("p")) & F.col("number").eqNullSafe(F.col("c"))).select("part", (F.col("ordinal") + F.col("base")).alias("ordinal"), "start", "n_tokens")
    lines = spark.read.schema("value string").option("lineSep", SEPARATOR).text(f"{path}/kind=places").select(part(F.col("_metadata.file_name")), F.split("value", ",").alias("v"))
    places = lines.select("part", F.col("v")[0].cast("long").alias("ordinal"), F.when(F.col("v")[1] != "", F.col("v")[1].cast("long")).alias("doc_id"))
    both = places.withColumn("placed", F.lit(True)).join(found, ["part", "ordinal"], "full")
    lost = F.raise_error(F.lit("the flat files and their places do not agree"))
    return both.select("doc_id", F.when(F.col("placed").isNull() | F.col("n_tokens").isNull(), lost.cast("long")).otherwise(F.col("start")).alias("start"), "n_tokens")


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens`` of every document, from flat token files that are written and scanned."""
    return token_counts(table(spark, sf_dir, "documents"))

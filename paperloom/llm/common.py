"""What the operators share: reading tables, tables written in the cluster's shared folder, and filters of bounded size."""

from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import shared_path, written

__all__ = ["hash_filter", "in_filter", "release", "shared_path", "table", "written"]

#: 64-bit words of a filter, at least and at most.
FILTER_WORDS = (1 << 10, 1 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that a task has done with back to the system: Python workers live on, and hold what they once needed beside the work of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def _bits(h: str) -> Column:
    """Two of the 64 bits of a hash's word."""
    bit = lambda shift: F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, {shift}) & 63 as int))")
    return bit(58).bitwiseOR(bit(52))


def hash_filter(hashes: DataFrame, most: int = FILTER_WORDS[1]) -> DataFrame:
    """``words``: one row, a Bloom filter of the column ``h`` of ``hashes`` with some 32 bits for each, but ``most`` words at most: a full filter lets more pass, and stops nothing that is in it."""
    size = 1 << max(0, math.ceil(math.log2(max(1, hashes.count() / 2))))
    size = min(max(size, min(FILTER_WORDS[0], most)), most)
    bits = hashes.select((F.col("h").bitwiseAND(F.lit(size - 1).cast("long"))).alias("at"), _bits("h").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    dense = hashes.sparkSession.range(size).select(F.col("id").alias("at")).join(bits, "at", "left").select("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"])  # ``size`` entries, a bound that does not grow
    return written(dense.agg(whole.alias("words")), "filter")


def in_filter(words: str, h: str) -> Column:
    """Whether the hash in the column ``h`` may be in the filter in the column ``words``; false for a null hash."""
    at = F.expr(f"cast({h} & (size({words}) - 1) as int)")
    return F.coalesce(F.get(words, at).bitwiseAND(_bits(h)) == _bits(h), F.lit(False))

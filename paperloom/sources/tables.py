"""Tables that a query writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where that is unset a session in one process gets a temporary folder; on a cluster it is an
    error, since executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="paperloom-"))
    return f"{root.rstrip('/')}/paperloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, partition_by: str | None = None, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads neither repeat its work nor need the executors that did it."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    writer = df.write.options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

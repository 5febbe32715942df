"""Continuous ingestion of packages: our own addition, built on the batch stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.sources.packages import shred

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_packages(spark: SparkSession, path: str, out: str, checkpoint: str, glob: str = "*.docx") -> StreamingQuery:
    """Shred each new package below ``path`` once into the Parquet table ``out``; runs until what is there is done."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def store(batch: DataFrame, number: int) -> None:
        rows = shred(batch.select(F.xxhash64("path").alias("doc_id"), "content"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

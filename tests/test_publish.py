"""Packages published together or not at all."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from paperloom.sources.publish import publish, published


def seen(spark, path):
    return {os.path.basename(r["path"]): bytes(r["content"]) for r in published(spark, path).collect()}


def test_a_run_replaces_the_one_before(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(f"p{k}.docx", bytearray(b"x" * k), k) for k in range(1, 30)], "name string, content binary, other int").repartition(4)
    publish(rows, path)
    assert seen(spark, path) == {f"p{k}.docx": b"x" * k for k in range(1, 30)}
    publish(rows.limit(2), path)
    assert len(seen(spark, path)) == 2


def test_a_failing_task_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"p{k}.docx", bytearray(b"old")) for k in range(5)], "name string, content binary")
    publish(rows, path)
    bad = rows.unionByName(spark.createDataFrame([("../escape", bytearray(b"new"))], "name string, content binary")).repartition(3).withColumn("content", F.lit(b"new"))
    with pytest.raises(Exception, match="no name for a file"):
        publish(bad, path)
    assert set(seen(spark, path).values()) == {b"old"} and len([d for d in os.listdir(path) if d.startswith("run-")]) == 1
    with pytest.raises(Exception, match="missing"):
        publish(rows.drop("content"), path)

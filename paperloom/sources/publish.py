"""Packages written as files, and published all together or not at all.

A data source for ``df.write``: tasks write packages under temporary names into a folder of the
run and rename them when they are whole, so a task that is done again writes the same names.  The
commit writes one small file that names the run's folder; until then, and after a failure, readers
see what was published before.  What the driver learns from a task is a count.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from paperloom.sources.packages import read_packages

FORMAT = "paperloom-packages"
CURRENT = "_current.json"


def _files(address: str):  # noqa: ANN202
    """The file system of an address, and the name there."""
    from pyarrow.fs import FileSystem

    plain = address if re.match("[a-z0-9]+:", address) else f"file://{address}"
    return FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", plain)))


@dataclass
class Wrote(WriterCommitMessage):
    packages: int


class PackageWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        missing = {"name", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"packages need the columns name and content; missing: {sorted(missing)}")
        self.path, self.run = path.rstrip("/"), f"run-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Wrote:
        system, root = _files(f"{self.path}/{self.run}")
        system.create_dir(root, recursive=True)
        n = 0
        for row in rows:
            if not row["name"] or "/" in row["name"] or row["name"].startswith((".", "_")):
                raise ValueError(f"no name for a file: {row['name']!r}")
            if row["content"] is None:
                raise ValueError(f"no content: {row['name']!r}")
            temporary = f"{root}/_{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                f.write(bytes(row["content"]))
            system.move(temporary, f"{root}/{row['name']}")
            n += 1
        return Wrote(n)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        temporary = f"{root}/_{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as f:
            f.write(json.dumps({"run": self.run, "packages": sum(m.packages for m in messages if m)}).encode())
        system.move(temporary, f"{root}/{CURRENT}")

    def abort(self, messages: list[Wrote | None]) -> None:
        from pyarrow.fs import FileType

        system, root = _files(f"{self.path}/{self.run}")
        if system.get_file_info(root).type == FileType.Directory:
            system.delete_dir(root)


class PackageSink(DataSource):
    """Rows of ``name, content`` (other columns are ignored) as files of the folder that they are saved to; each save replaces what was published."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"], schema)


def publish(packages: DataFrame, path: str) -> None:
    """Write ``packages`` (``name, content``) below ``path`` and make them what readers see, all at once."""
    packages.sparkSession.dataSource.register(PackageSink)
    packages.write.format(FORMAT).mode("append").save(path)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The packages of the last run that was published below ``path``, as ``read_packages`` gives them."""
    system, root = _files(path)
    with system.open_input_stream(f"{root}/{CURRENT}") as f:
        run = json.loads(f.read())["run"]
    return read_packages(spark, f"{path.rstrip('/')}/{run}", "*")

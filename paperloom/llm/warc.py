"""Web archives packed in ZIP files: written, and read record by record without extraction.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (each
record a gzip member of its own), ``indexes/index.cdxj`` (a line for each record, with its place
in the archive) and ``datapackage.json``.  The reader finds a package's end record, the ZIP64 one
where there is one, walks the central directory in pieces, takes each record's place from the
indexes (an archive without index lines is walked once, record by record), and then reads byte
ranges: records are rows dealt by package and stretch of ``RANGE`` bytes, so any task can take
some of a package and none needs all of it.

Writing is safe when executors are lost: a task writes files of fresh names and gives their
names as rows; only files that the manifest, a table written by Spark, names are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import math
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import shared_path, table, written

#: Bytes of records after which a package is closed; of a stretch that is read at once; of a piece of a directory or index.
PACKAGE_BYTES = 32 << 20
RANGE = 4 << 20
PIECE = 1 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_PAYLOAD = 0
#: The date of all records: pages have none.
DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the profile of a revisit of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_file(address: str) -> Any:
    """A file of a local or shared folder, s3, gs or hdfs for reading in places."""
    from pyarrow.fs import FileSystem

    system, name = FileSystem.from_uri(_plain(address))
    return system.open_input_file(name)


def _plain(address: str) -> str:
    """The address as Arrow takes it."""
    return re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", address if re.match("[a-z0-9]+:", address) else f"file://{address}"))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- Records ---------------------------------------------------------------------------------


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A WARC record as a gzip member; fields without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page: a response, or a revisit of the page ``refers_to`` with the HTTP header alone."""
    digest = base32_sha1(payload)
    name = lambda page: f"<urn:page:{'' if page is None else page}:{digest}>"
    # A field is one line without blanks: what could end it is written as %XX.
    safe = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Record-ID": name(page_id), "WARC-Target-URI": safe, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to)}, http)


def parsed(member: bytes) -> dict:
    """A record's fields by name in lower case (``warc-type``, ``content-length`` ...) and its ``block``; a ValueError where it is damaged."""
    data = gzip.decompress(member) if member[:2] == b"\x1f\x8b" else member
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields: dict[str, Any] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record that ends early")
    return fields | {"block": rest[:size]}


def page_of(name: str | None) -> int | None:
    """The page id in a record's name."""
    m = re.fullmatch(r"<urn:page:(-?[0-9]+):[A-Z2-7]*>", name or "")
    return int(m[1]) if m else None


def page_row(fields: dict) -> dict:
    """``page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to`` of a response or revisit.

    The digest of a response is made from its payload anew and must be the one it states; that of
    a revisit, and the size of its payload, are what its record states.
    """
    head, _, payload = fields["block"].partition(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    row = {"page_id": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload": payload, "payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "refers_to": None}
    if fields["warc-type"] == "revisit":
        m = re.search(rb"(?im)^content-length:\s*([0-9]+)", head)
        return row | {"payload": None, "payload_bytes": int(m[1]) if m else None, "payload_digest": stated, "refers_to": page_of(fields.get("warc-refers-to"))}
    if stated and stated != row["payload_digest"]:
        raise ValueError(f"the payload of {fields.get('warc-record-id')} is not that of its digest")
    return row


# --- Packages: writing -----------------------------------------------------------------------


def packed(records: list[bytes]) -> bytes:
    """A package of records."""
    lines, at = [], 0
    for k, r in enumerate(records):
        lines.append(f"{k:012d} " + json.dumps({"filename": "data.warc.gz", "offset": at, "length": len(r)}))
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("archive/data.warc.gz", b"".join(records)), ("indexes/index.cdxj", "\n".join(lines).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}).encode())):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def revisits(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``page_id, url, payload, refers_to``: of pages with equal payloads of ``least`` bytes or more that with the largest id is named by the others.

    A null id is less than any; rows that repeat the largest id are all responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    same = F.sha2("payload", 256)
    leaders = p.where(F.octet_length("payload") >= least).groupBy(same.alias("same")).agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("same", "leader")
    both = p.withColumn("same", F.when(F.octet_length("payload") >= least, same)).join(written(leaders, "leaders"), "same", "left")
    return both.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader")).alias("refers_to"))


def write_packages(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Archives of ``pages`` (``page_id, url, html``) below ``path``; gives the manifest: ``package, records, bytes``."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            address, data = f"{path}/packages/{uuid.uuid4().hex}.wacz", packed(held)
            system, name = FileSystem.from_uri(_plain(address))
            system.create_dir(name.rpartition("/")[0], recursive=True)
            with system.open_output_stream(name) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"package": [address], "records": [len(held)], "bytes": [len(data)]})

        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(page_record(*(c[k].as_py() for c in batch.columns)))
                size += len(held[-1])
                if size >= package_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    revisits(pages, least).mapInArrow(run, "package string, records long, bytes long").write.parquet(f"{path}/manifest")
    return spark.read.schema("package string, records long, bytes long").parquet(f"{path}/manifest")


# --- Packages: reading -----------------------------------------------------------------------


def end_of(f: Any) -> tuple[int, int, int]:
    """``(offset, size, entries)`` of a ZIP file's central directory, by its end record or its ZIP64 one."""
    size = f.size()
    tail = f.read_at(min(size, 65557), max(0, size - 65557))
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):  # a comment may hold the mark too
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no ZIP file")
    entries, length, start = struct.unpack("<H2L", tail[at + 10 : at + 20])
    here = max(0, size - 65557) + at
    if here >= 20 and (entries == 0xFFFF or 0xFFFFFFFF in (length, start)):
        mark, _, where, _ = struct.unpack("<4sLQL", f.read_at(20, here - 20))
        if mark == b"PK\x06\x07":
            end = f.read_at(56, where)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            entries, length, start = struct.unpack("<3Q", end[32:56])
    return start, length, entries


def members(f: Any, piece: int = PIECE) -> Iterator[tuple[str, int, int, int]]:
    """``(name, method, data offset, size)`` of the entries of a central directory, read in pieces; sizes and places beyond 32 bits by their ZIP64 field."""
    start, length, entries = end_of(f)
    held, read = b"", 0

    def have(n: int) -> None:
        nonlocal held, read
        while len(held) < n:
            more = f.read_at(min(piece, length - read), start + read) if read < length else b""
            if not more:
                raise ValueError("a central directory that ends early")
            held, read = held + more, read + len(more)

    for _ in range(entries):
        have(46)
        mark, method, packed_size, size, n, extra, comment, place = struct.unpack("<4s6xH8xLLHHH8xL", held[:46])
        if mark != b"PK\x01\x02":
            raise ValueError("no central directory entry")
        have(46 + n + extra + comment)
        name = held[46 : 46 + n].decode("utf-8", "replace")
        fields, held = held[46 + n : 46 + n + extra], held[46 + n + extra + comment :]
        large = _zip64(fields)
        size = large.pop(0) if size == 0xFFFFFFFF and large else size
        packed_size = large.pop(0) if packed_size == 0xFFFFFFFF and large else packed_size
        place = large.pop(0) if place == 0xFFFFFFFF and large else place
        local = f.read_at(30, place)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local entry of {name!r}")
        a, b = struct.unpack("<HH", local[26:30])
        yield name, method, place + 30 + a + b, packed_size


def _zip64(fields: bytes) -> list[int]:
    """The 64-bit numbers of an entry's ZIP64 field, in order."""
    while len(fields) >= 4:
        kind, size = struct.unpack("<HH", fields[:4])
        if kind == 1:
            return list(struct.unpack(f"<{size // 8}Q", fields[4 : 4 + size // 8 * 8]))
        fields = fields[4 + size :]
    return []


def lines_of(f: Any, at: int, size: int, piece: int = PIECE) -> Iterator[bytes]:
    """The lines of a stored member, read in pieces."""
    held = b""
    for k in range(0, size, piece):
        *whole, held = (held + f.read_at(min(piece, size - k), at + k)).split(b"\n")
        yield from whole
    if held:
        yield held


def walked(f: Any, at: int, size: int, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """``(offset, length)`` of the gzip members of a stored member, each a record, found by unpacking them in pieces."""
    begin, pos, end, rest = at, at, at + size, b""
    unpack = zlib.decompressobj(31)
    while pos < end or rest:
        data = rest or f.read_at(min(piece, end - pos), pos)
        pos += 0 if rest else len(data)
        if not data:
            raise ValueError("a member that ends early")
        unpack.decompress(data, piece)
        rest = unpack.unconsumed_tail
        if unpack.eof:
            rest = unpack.unused_data
            stop = pos - len(rest)
            yield begin, stop - begin
            begin, unpack = stop, zlib.decompressobj(31)
    if begin != end:
        raise ValueError("a record that ends early")


def places(f: Any) -> Iterator[tuple[int, int]]:
    """``(offset, length)`` in the package of each record: by its indexes, and by a walk of archives that no index line names."""
    found = list(members(f))
    archives = {name.removeprefix("archive/"): (at, size) for name, method, at, size in found if name.startswith("archive/") and method == 0}
    if packed_ := [n for n, method, _, _ in found if n.startswith(("archive/", "indexes/")) and method != 0 and not n.endswith("/")]:
        raise ValueError(f"members that are not stored: {packed_[:3]}")
    named = set()
    for name, _, at, size in found:
        if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx")):
            for line in lines_of(f, at, size):
                if b"{" in line:
                    entry = json.loads(line[line.index(b"{") :])
                    base, whole = archives[entry["filename"]]
                    offset, length = int(entry["offset"]), int(entry["length"])
                    if offset + length > whole:
                        raise ValueError("an index line beyond its archive")
                    named.add(entry["filename"])
                    yield base + offset, length
    for name, (at, size) in archives.items():
        if name not in named:
            yield from walked(f, at, size)


def read_records(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to`` (and ``payload``, null for revisits) of the responses and revisits of the packages that ``manifest`` names in ``package``.

    Records of other types are passed over; a damaged package or record is an error.
    """
    spark = manifest.sparkSession

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("package", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for package in batch.column(0).to_pylist():
                rows = []
                with open_file(package) as f:
                    for at, size in places(f):
                        rows.append({"package": package, "at": at, "size": size})
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    columns = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}
    names = {"page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long"}
    if with_payload:
        columns, names = columns | {"payload": pa.binary()}, names | {"payload": "binary"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, package, f = pa.schema(list(columns.items())), None, None
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            rows, held, k = [], 0, 0
            while k < len(wanted):
                name, at, size = wanted[k]
                if name != package:
                    if f:
                        f.close()
                    package, f = name, open_file(name)
                last = k + 1  # records that stand close together are read at once
                while last < len(wanted) and wanted[last][0] == name and wanted[last][1] + wanted[last][2] - at <= RANGE:
                    last += 1
                end = max(a + s for _, a, s in wanted[k:last])
                data = f.read_at(end - at, at)
                for _, a, s in wanted[k:last]:
                    fields = parsed(data[a - at : a - at + s])
                    if fields["warc-type"] in ("response", "revisit"):
                        row = page_row(fields)
                        held += len(row["payload"] or b"") if with_payload else 0
                        rows.append({c: row[c] for c in columns})
                    if len(rows) >= 4096 or held >= RANGE:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, held = [], 0
                k = last
            yield pa.RecordBatch.from_pylist(rows, schema=kind)
        if f:
            f.close()

    tasks = max(1, spark.sparkContext.defaultParallelism)
    spots = written(manifest.select("package").repartition(tasks).mapInArrow(locate, "package string, at long, size long"), "spots")
    # The rows are narrow, what they stand for is not: the number of tasks is that of the bytes to be read.
    total = spots.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    dealt = spots.repartition(max(tasks, math.ceil(total / (4 * RANGE))), "package", F.floor(F.col("at") / RANGE)).sortWithinPartitions("package", "at")
    return dealt.mapInArrow(read, ", ".join(f"{c} {t}" for c, t in names.items()))


def archived(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """What the records of ``pages`` say after they were written to packages in the shared folder: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A null or empty html is an empty payload, like any other; a null id names no page, and a null
    url none (blanks and controls in one are written as %XX); repeated rows have a record each; other columns are ignored and an empty table gives
    no row.
    """
    manifest = write_packages(pages.select("page_id", "url", "html"), shared_path(pages.sparkSession, "warc"), least)
    return read_records(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page of ``pages``, from its record in a package."""
    return archived(table(spark, sf_dir, "pages"))


#: SHA-1 in base 32: the digest's bits, five for each character.
OP12_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, octet_length(payload) AS size, sha1(payload) AS hex FROM p),
bits AS (SELECT *, array_to_string([lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0') FOR i IN range(1, 41)], '') AS b FROM d),
n AS (SELECT *, array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(b[5 * j + 1] AS INT) + 8 * CAST(b[5 * j + 2] AS INT) + 4 * CAST(b[5 * j + 3] AS INT) + 2 * CAST(b[5 * j + 4] AS INT) + CAST(b[5 * j + 5] AS INT)] FOR j IN range(0, 32)], '') AS digest, max(page_id) OVER (PARTITION BY payload) AS leader FROM bits)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS DISTINCT FROM leader THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to FROM n"""

"""Archives in ZIP packages: round trips, places, and what damaged ones do."""

from __future__ import annotations

import base64
import hashlib
import io
import os
import zipfile

import pytest

from paperloom.llm.common import shared_path
from paperloom.llm.warc import OP12_SQL, archived, end_of, members, op12_warc_packages, packed, page_record, parsed, places, read_records, write_packages
from tests.test_queries import SF, duck, same  # noqa: F401

SCHEMA = "page_id long, url string, html string"


class Bytes:
    def __init__(self, data):
        self.data, self.reads = data, []

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.reads.append(n)
        return self.data[at : at + n]


def plain(rows, least=0):
    body = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for page, b in body:
        known = [p for p, c in body if c == b and p is not None]
        leader = max(known) if known and len(b) >= least else page
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if page == leader else "revisit", None if page == leader else leader))
    return sorted(out, key=str)


ROWS = [(1, "http://a/ b\r\nX: y", "<p>ä😀</p>"), (2, None, "<p>ä😀</p>"), (3, "u", None), (4, "u", ""), (5, "http://x/%20", "x" * 300_000), (6, "é", "x" * 300_000), (None, "n", "x" * 300_000), (7, "r", "a\r\n\r\nb"), (7, "r", "a\r\n\r\nb"), (7, "r", "other"), (-9, "m", "only")]


@pytest.mark.parametrize("least", [0, 1, 1000])
def test_equals_a_plain_reading(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as same", "2 as leader", "3 as payload", "4 as n").repartition(3)
    assert sorted(map(tuple, archived(pages, least).collect()), key=str) == plain(ROWS, least)


def test_payloads_and_small_packages(spark):
    path = shared_path(spark, "warc-test")
    manifest = write_packages(spark.createDataFrame(ROWS * 5, SCHEMA), path, package_bytes=500)
    stray = manifest.first()["package"].replace("/packages/", "/packages/stray-")
    os.makedirs(os.path.dirname(stray), exist_ok=True)
    with open(stray, "wb") as f:  # what a lost task left is not in the manifest
        f.write(b"half a package")
    got = read_records(manifest, with_payload=True).collect()
    assert manifest.count() > 5 and len(got) == len(ROWS) * 5
    texts = {(r[0], (r[2] or "").encode()) for r in ROWS}
    assert all((r["page_id"], bytes(r["payload"])) in texts for r in got if r["record_type"] == "response")
    assert {r["url"] for r in got if r["page_id"] == 1} == {"http://a/%20b%0D%0AX:%20y"} and {r["url"] for r in got if r["page_id"] == 5} == {"http://x/%20"}


def test_no_rows(spark):
    assert archived(spark.createDataFrame([], SCHEMA)).collect() == []


def records(n):
    return [page_record(k, f"u{k}", b"%d" % k * k, None) for k in range(n)]


def test_places_by_index_and_by_walk():
    each = records(40)
    f = Bytes(packed(each))
    assert [f.data[a : a + s] for a, s in places(f)] == each
    assert [parsed(f.data[a : a + s])["warc-record-id"].split(":")[2] for a, s in places(f)] == [str(k) for k in range(40)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/one.warc.gz", b"".join(each))
        z.writestr("archive/two.warc.gz", each[3])
        z.writestr("indexes/index.cdxj", 'k 1 {"filename": "two.warc.gz", "offset": 0, "length": %d}\n' % len(each[3]))
    g = Bytes(out.getvalue())
    assert sorted(g.data[a : a + s] for a, s in places(g)) == sorted([*each, each[3]])


def test_directories_in_pieces_with_many_members_comments_and_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(66_000):  # more than 65,535 members need the ZIP64 end record
            z.writestr(f"m/{k}", str(k))
        z.comment = b"PK\x05\x06 in a comment"
    f = Bytes(out.getvalue())
    assert end_of(f)[2] == 66_000
    f.reads.clear()
    found = list(members(f, piece=5000))
    assert len(found) == 66_000 and max(n for n in f.reads if n != 65557) <= 5000
    assert all(f.data[at : at + size] == name[2:].encode() for name, _, at, size in found[::997])

    class Sparse(io.BytesIO):  # a place and sizes beyond 32 bits, in their ZIP64 fields
        pass

    with zipfile.ZipFile(s := Sparse(), "w") as z:
        z.writestr("a", b"first")
        info = zipfile.ZipInfo("b")
        with z.open(info, "w", force_zip64=True) as g:
            g.write(b"second")
    data = bytearray(s.getvalue())
    at = data.rfind(b"PK\x01\x02")
    size, place = len(b"second"), int.from_bytes(data[at + 42 : at + 46], "little")
    extra = b"\x01\x00\x18\x00" + size.to_bytes(8, "little") * 2 + place.to_bytes(8, "little")
    entry = data[at : at + 46 + 1]
    entry[20:28], entry[30:32], entry[42:46] = b"\xff" * 8, len(extra).to_bytes(2, "little"), b"\xff" * 4
    end = data.rfind(b"PK\x05\x06")
    head, tail = data[:at], data[end:]
    tail[12:16] = (end - int.from_bytes(data[end + 16 : end + 20], "little") + len(entry) + len(extra) - (end - at)).to_bytes(4, "little")
    whole = Bytes(bytes(head + entry + extra + tail))
    assert [whole.data[a : a + n] for _, _, a, n in members(whole)] == [b"first", b"second"]


@pytest.mark.parametrize("damage", [lambda d: d[:-30], lambda d: b"x" * 100, lambda d: d.replace(b"PK\x01\x02", b"PK\x01\x03"), lambda d: d.replace(b'"length": ', b'"length": 9')])
def test_damaged_packages_are_errors(damage):
    with pytest.raises((ValueError, KeyError)):
        list(places(Bytes(damage(packed(records(3))))))


def test_a_changed_payload_is_an_error(spark, tmp_path):
    import gzip

    member = gzip.compress(gzip.decompress(page_record(1, "u", b"payload", None)).replace(b"\r\n\r\npayload", b"\r\n\r\nPAYLOAD"))
    (tmp_path / "p.wacz").write_bytes(packed([member]))
    with pytest.raises(Exception, match="not that of its digest"):
        read_records(spark.createDataFrame([(str(tmp_path / "p.wacz"),)], "package string")).collect()
    (tmp_path / "z.wacz").write_bytes(b"")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"x" * 1000)
    with pytest.raises(ValueError, match="not stored"):
        list(places(Bytes(out.getvalue())))


def test_sql(spark, duck):  # noqa: F811
    same(op12_warc_packages(spark, SF).toPandas(), duck.execute(OP12_SQL).df())

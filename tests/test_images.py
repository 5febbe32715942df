"""Image headers against a walk over bytes."""

from __future__ import annotations

import random
import struct
import zlib

from pyspark.sql import functions as F

from paperloom.functions.images import ALONE, FRAMES, image_type, pixel_size


def png(w, h):
    head = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head)) + b"rest"


def segment(rng, code, data):
    return b"\xff" * rng.randint(1, 3) + bytes([code]) + struct.pack(">H", len(data) + 2) + data


def jpeg(rng):
    out = b"\xff\xd8"
    for _ in range(rng.randint(0, 6)):
        kind = rng.random()
        if kind < 0.2:
            out += b"\xff" + bytes([rng.choice(ALONE)])
        elif kind < 0.3:
            out += bytes(rng.choice([b"\x00", b"ab", b"\x12\x13"]))
        else:
            out += segment(rng, rng.choice([0xE0, 0xE1, 0xDB, 0xC4, 0xFE]), bytes(rng.randrange(256) for _ in range(rng.randint(0, 40))))
    frame = struct.pack(">BHHB", 8, rng.randint(0, 3000), rng.randint(0, 3000), 3)
    return out + rng.choice([segment(rng, rng.choice(FRAMES), frame + b"x" * 9), b"", b"\xff\xda\x00\x08", segment(rng, 0xC0, b"\x08")])


def walk(b):
    at = 2
    while at + 3 < len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        while at < len(b) and b[at] == 0xFF:
            at += 1
        if at >= len(b) or b[at] in (0xD9, 0xDA):
            return None
        code, at = b[at], at + 1
        if code in ALONE:
            continue
        if at + 1 >= len(b):
            return None
        size = b[at] << 8 | b[at + 1]
        if size < 2 or at + size > len(b):
            return None
        if code in FRAMES and size >= 7:
            h, w = b[at + 3] << 8 | b[at + 4], b[at + 5] << 8 | b[at + 6]
            return (w, h) if w and h else None
        at += size
    return None


def test_types_and_sizes(spark):
    rng = random.Random(4)
    images = [png(7, 9), png(0, 9), png(70_000, 2), png(7, 9)[:20], b"GIF89a....", b"II*\x00", b"RIFFabcdWEBPVP8 ", b"BM", b"", b"text", None, b"\xff\xd8\xff"]
    photos = [jpeg(rng) for _ in range(300)]
    photos += [x[: rng.randint(0, len(x))] for x in photos[:100]]
    rows = spark.createDataFrame([(k, bytearray(x) if x is not None else None) for k, x in enumerate([*images, *photos])], "k long, b binary")
    got = {r["k"]: r for r in rows.select("k", image_type(F.col("b")).alias("kind"), pixel_size(F.col("b")).alias("size")).collect()}
    assert [got[k]["kind"] for k in range(len(images))] == ["image/png"] * 4 + ["image/gif", "image/tiff", "image/webp", "image/bmp", None, None, None, "image/jpeg"]
    assert [got[k]["size"] and tuple(got[k]["size"]) for k in range(len(images))] == [(7, 9), None, (70_000, 2)] + [None] * 9
    for k, x in enumerate(photos):
        size = got[len(images) + k]["size"]
        assert (size and tuple(size)) == (walk(x) if x[:3] == b"\xff\xd8\xff" else None), x
    assert sum(walk(x) is not None for x in photos) > 60

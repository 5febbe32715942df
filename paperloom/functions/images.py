"""Type and pixel size of images from their first bytes, as column expressions.

Bytes are read as characters of ISO 8859-1, one for each, so that string functions find them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How files of a type begin, as regular expressions over such characters.
SIGNATURES = {
    "image/png": r"^\x89PNG\r\n\x1A\n",
    "image/jpeg": r"^\xFF\xD8\xFF",
    "image/gif": r"^GIF8[79]a",
    "image/bmp": r"^BM",
    "image/tiff": r"^(II\*\x00|MM\x00\*)",
    "image/webp": r"(?s)^RIFF.{4}WEBP",
}
#: JPEG markers without a length, those that end the search, and those that hold the size.
ALONE = [0x01, *range(0xD0, 0xD8)]
LAST = [0xD9, 0xDA]
FRAMES = [0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF]


def _chars(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def image_type(content: Column) -> Column:
    """The content type that the first bytes tell; null for none that is known."""
    head = _chars(F.substring(content, 1, 16))
    return F.coalesce(*[F.when(head.rlike(p), kind) for kind, p in SIGNATURES.items()])


def _number(content: Column, at: int, size: int) -> Column:
    """A big-endian number; ``at`` counts from 0."""
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("long")


def _png(content: Column) -> Column:
    fits = (F.octet_length(content) >= 24) & (_chars(F.substring(content, 13, 4)) == "IHDR")
    return F.when(fits, F.struct(_number(content, 16, 4).alias("width"), _number(content, 20, 4).alias("height")))


def _jpeg(content: Column) -> Column:
    """A fold over segments: each step goes to the next marker, and on by its length; a frame's marker ends it with the size, damage ends it without."""
    text, size = _chars(content), F.octet_length(content)
    byte = lambda at: F.ascii(F.substring(text, at, F.lit(1)))  # noqa: E731  ``at`` counts from 1
    pair = lambda at: byte(at) * 256 + byte(at + 1)
    none = F.lit(None).cast("int")
    state = lambda at, open_, width=none, height=none: F.struct(at.cast("int").alias("at"), F.lit(open_).alias("open"), width.alias("width"), height.alias("height"))
    ended = state(F.lit(0), False)

    def step(s: Column, _: Column) -> Column:
        found = F.locate("ÿ", text, s["at"]) if isinstance(s, str) else F.call_function("locate", F.lit("ÿ"), text, s["at"])
        run = F.length(F.regexp_extract(F.substring(text, found, size), "^ÿ+", 0))
        mark = F.struct(found.alias("found"), (found + run).alias("m"))
        code = byte(mark["m"])
        after = mark["m"] + 1
        length = pair(after)
        broken = (mark["found"] == 0) | (mark["found"] + 2 >= size) | (mark["m"] > size)
        sized = F.when((after + 1 > size) | (length < 2) | (after - 1 + length > size), ended).when(code.isin(*FRAMES) & (length >= 7), state(F.lit(0), False, pair(after + 5), pair(after + 3))).otherwise(state(after + length, True))
        return F.when(~s["open"], s).when(broken | code.isin(*LAST), ended).when(code.isin(*ALONE), state(after, True)).otherwise(sized)

    folded = F.aggregate(F.sequence(F.lit(1), F.floor(size / 2).cast("int") + 1), state(F.lit(3), True), step)
    got = F.when(size >= 4, folded)
    return F.when(got["width"].isNotNull(), F.struct(got["width"].cast("long").alias("width"), got["height"].cast("long").alias("height")))


def pixel_size(content: Column) -> Column:
    """``width`` and ``height`` of a PNG or JPEG image; null for other types, damaged images, and sizes of nought."""
    kind = image_type(content)
    got = F.when(kind == "image/png", _png(content)).when(kind == "image/jpeg", _jpeg(content))
    return F.when((got["width"] > 0) & (got["height"] > 0), got)

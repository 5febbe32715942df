"""Scalar functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman numerals by falling value.
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
#: English Metric Units in a unit of length.
EMU = {"in": 914400, "cm": 360000, "mm": 36000, "pt": 12700, "px": 9525, "emu": 1}
#: How a field's cached result can be renewed, by the field's name.
FIELD_POLICY = {"REF": "limited", "PAGEREF": "limited", "NOTEREF": "limited", "QUOTE": "limited"}


def truncated(text: Column, most: int) -> Column:
    """``text`` in at most ``most`` characters; what is cut ends in ``...`` where that fits."""
    cut = F.concat(F.substring(text, 1, most - 3), F.lit("...")) if most > 3 else F.substring(text, 1, most)
    return F.when(F.length(text) > most, cut).otherwise(text)


#: Characters that are shown as two, the backslash first.
SHOWN = [("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")]


def escaped(text: Column) -> Column:
    """``text`` on one line between quotes: quotes, backslashes, line ends and tabs as two characters each."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SHOWN, text)


def normalized(text: Column) -> Column:
    """White space runs (by Unicode) as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def contains_any_case(text: Column, query: str) -> Column:
    return F.contains(F.lower(text), F.lit(query.lower()))


def wire(prefix: str, number: Column, width: int = 4) -> Column:
    """``prefix`` and a number of at least ``width`` digits."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", number))


def roman(n: Column) -> Column:
    """Lower-case roman numeral of 1 to 3999; null for any other number."""
    left, parts = n.cast("int"), []
    for value, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    return F.when(n.between(1, 3999), F.concat(*parts))


def letters(n: Column) -> Column:
    """``a`` to ``z``, then ``aa``, ``ab`` and so on, for any number from 1 (14 letters are enough for a long); null below."""
    digit = lambda left: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), ((left - 1) % 26 + 1).cast("int"), F.lit(1))
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    step = lambda a, _: F.when(a["left"] > 0, F.struct(F.floor((a["left"] - 1) / 26).cast("long").alias("left"), F.concat(digit(a["left"]), a["out"]).alias("out"))).otherwise(a)
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["out"]))


def emu(value: Column, unit: Column) -> Column:
    """A length in English Metric Units; null for a unit that is not known."""
    factor = reduce(lambda c, u: c.when(unit == u, F.lit(EMU[u])), EMU, F.when(F.lit(False), F.lit(0)))
    return F.round(value.cast("decimal(18,3)") * factor).cast("long")


def on_off(value: Column, absent: bool | None = None) -> Column:
    """A toggle attribute: absent is not the same as off."""
    return F.when(value.isNull(), F.lit(absent).cast("boolean")).otherwise(F.lower(value).isin("1", "true", "on"))


def nth_replaced(text: Column, find: str, to: str, n: int) -> Column:
    """``text`` with the ``n``-th occurrence of ``find`` (from 1, not overlapping) replaced; unchanged where there are fewer."""
    parts = F.split(text, "\\Q" + find + "\\E", -1)
    before = F.array_join(F.slice(parts, 1, n), find)
    after = F.array_join(F.slice(parts, F.lit(n + 1), F.greatest(F.size(parts) - n, F.lit(0))), find)
    return F.when(F.size(parts) > n, F.concat(before, F.lit(to), after)).otherwise(text)


def occurrences(text: Column, find: str) -> Column:
    """How often ``find`` occurs without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)).cast("long")


def valid_uri(uri: Column) -> Column:
    """Absolute http, https or mailto address."""
    return F.coalesce(uri.rlike(r"^(?i)(https?://[^\s/?#]+|mailto:[^\s@]+@[^\s@]+)"), F.lit(False))

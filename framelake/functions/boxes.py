"""Bytes of containers as column expressions: numbers, boxes and tables of entries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the expression once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def number_hex(value: Column, size: int) -> Column:
    """Hex of the low ``size`` bytes (1 to 8) of a whole number, greatest first; negative ones in two's complement."""
    if size == 8:
        return F.lpad(F.hex(value.cast("long")), 16, "0")
    # A one before the digits keeps their zeros.
    return F.substring(F.hex(value.cast("long").bitwiseAND((1 << 8 * size) - 1).bitwiseOR(F.lit(1 << 8 * size))), 2, 2 * size)


def number(value: Column, size: int) -> Column:
    return F.unhex(number_hex(value, size))


def box(kind: str, *parts: Column) -> Column:
    """A box of the given kind around the parts, with a size of four bytes."""
    body = F.concat(*parts) if parts else F.unhex(F.lit(""))
    return let(body, lambda b: F.concat(number(F.length(b) + 8, 4), F.lit(kind).cast("binary"), b))


def flat_box(kind: str, *parts: Column) -> Column:
    """``box`` of parts that stand in the expression twice: columns of the step before, and constants."""
    size = reduce(lambda a, b: a + b, (F.length(part) for part in parts), F.lit(8))
    return F.concat(number(size, 4), F.lit(kind).cast("binary"), *parts)


def nested(body: Column, *kinds: str) -> Column:
    """Boxes of the given kinds, the innermost first, that hold nothing but each other and the body."""
    heads = lambda b: [part for k, kind in reversed(list(enumerate(kinds, 1))) for part in (number(F.length(b) + 8 * k, 4), F.lit(kind).cast("binary"))]
    return let(body, lambda b: F.concat(*heads(b), b))


def full_box(kind: str, *parts: Column, version: int | Column = 0, flags: int = 0) -> Column:
    version = version if isinstance(version, Column) else F.lit(version)
    return box(kind, number(version, 1), number(F.lit(flags), 3), *parts)


def table_box(kind: str, entries: Column, *before: Column, version: int | Column = 0) -> Column:
    """A full box of an array of entries in hex, with their count."""
    return full_box(kind, *before, number(F.size(entries), 4), F.unhex(F.array_join(entries, "")), version=version)

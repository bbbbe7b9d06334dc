"""Which pictures a decoder keeps as references: the rules for one picture after another, and their run over a whole table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Commands of adaptive memory control.
FORGET_SHORT, FORGET_LONG, ASSIGN_LONG, LIMIT_LONG, FORGET_ALL, MARK_LONG = 1, 2, 3, 4, 5, 6

#: Fixed value: the most references that a stream may declare.
MOST_REFERENCES = 16

#: An entry of the buffer; long_index is null for a short-term reference.
HELD = "array<struct<index:bigint,frame_num:bigint,poc:bigint,long_index:int>>"

COMMANDS = "array<struct<op:int,a:int,b:int>>"


@dataclass(frozen=True)
class Reference:
    index: int
    frame_num: int
    poc: int
    long_index: int | None = None


@dataclass(frozen=True)
class Buffer:
    """References in the order in which they came, and the greatest long-term index allowed."""

    held: tuple[Reference, ...] = ()
    most_long: int | None = None


@dataclass(frozen=True)
class Limits:
    """Of a stream: how many references it keeps (at least one) and how many values its frame numbers have."""

    references: int
    frame_nums: int

    @classmethod
    def of(cls, references: int, log2_frame_nums: int) -> Limits:
        if not 4 <= log2_frame_nums <= 16:
            raise ValueError("log2 of the number of frame numbers is outside 4 to 16")
        if not 0 <= references <= MOST_REFERENCES:
            raise ValueError("more references than a buffer may hold")
        return cls(max(references, 1), 1 << log2_frame_nums)


class Refused(ValueError):
    """A picture whose marking is not valid; the buffer stays as it was."""


def _wrapped(held: Reference, frame_num: int, limits: Limits) -> int:
    """A frame number greater than the current one was counted before the last turn."""
    return held.frame_num - limits.frame_nums if held.frame_num > frame_num else held.frame_num


def _without(held: tuple[Reference, ...], gone: Reference) -> tuple[Reference, ...]:
    return tuple(r for r in held if r is not gone)


def _short(held: tuple[Reference, ...], frame_num: int, difference: int, limits: Limits) -> Reference:
    if difference == 0:
        raise Refused("invalid: difference of picture numbers is zero")
    found = [r for r in held if r.long_index is None and _wrapped(r, frame_num, limits) == frame_num - difference]
    if not found:
        raise Refused("invalid: no such short-term reference")
    return found[0]


def _long(held: tuple[Reference, ...], index: int) -> Reference | None:
    return next((r for r in held if r.long_index == index), None)


def _free_long(buffer: Buffer, index: int) -> Buffer:
    """The buffer after a long-term index is taken from whatever had it."""
    if buffer.most_long is None or index > buffer.most_long:
        raise Refused("invalid: long-term index is over the greatest one")
    had = _long(buffer.held, index)
    return replace(buffer, held=_without(buffer.held, had)) if had else buffer


def store_refresh(index: int, poc: int, long_term: bool) -> Buffer:
    """After an instant refresh only the picture itself is held, with frame number 0."""
    return Buffer((Reference(index, 0, poc, 0 if long_term else None),), 0 if long_term else None)


def store_sliding(buffer: Buffer, picture: Reference, limits: Limits) -> Buffer:
    """The picture as a short-term reference; in a full buffer that of least wrapped frame number goes."""
    short = [r for r in buffer.held if r.long_index is None]
    if any(r.frame_num == picture.frame_num for r in short):
        raise Refused("invalid: frame number is held already")
    held = buffer.held
    if len(held) == limits.references:
        if not short:
            raise Refused("invalid: no short-term reference to remove")
        held = _without(held, min(short, key=lambda r: _wrapped(r, picture.frame_num, limits)))
    return replace(buffer, held=(*held, picture))


def store_adaptive(buffer: Buffer, picture: Reference, commands: list[tuple[int, int, int]], limits: Limits) -> Buffer:
    """The picture stored after all commands in turn; if one is refused none holds."""
    now = buffer
    for op, a, b in commands:
        if op == FORGET_SHORT:
            now = replace(now, held=_without(now.held, _short(now.held, picture.frame_num, a, limits)))
        elif op == FORGET_LONG:
            gone = _long(now.held, a)
            if gone is None:
                raise Refused("invalid: no such long-term reference")
            now = replace(now, held=_without(now.held, gone))
        elif op == ASSIGN_LONG:
            now = _free_long(now, b)
            found = _short(now.held, picture.frame_num, a, limits)
            now = replace(now, held=tuple(replace(r, long_index=b) if r is found else r for r in now.held))
        elif op == LIMIT_LONG:
            now = Buffer(tuple(r for r in now.held if r.long_index is None or r.long_index < a), a - 1 if a > 0 else None)
        elif op == FORGET_ALL:
            now = Buffer()
        elif op == MARK_LONG:
            now = _free_long(now, a)
            picture = replace(picture, long_index=a)
        else:
            raise Refused("invalid: unknown command")
    if picture.long_index is None and any(r.long_index is None and r.frame_num == picture.frame_num for r in now.held):
        raise Refused("invalid: frame number is held already")
    if len(now.held) >= limits.references:
        raise Refused("invalid: more references than allowed")
    return replace(now, held=(*now.held, picture))


def store(buffer: Buffer, row: dict, limits: Limits) -> tuple[Buffer, str | None]:
    """The buffer after one row and what was refused; see ``mark_references`` for rows."""
    if row["kind"] in ("end_of_sequence", "end_of_stream"):
        return Buffer(), None
    if row["kind"] != "picture" or not row["is_reference"]:
        return buffer, None
    if row["is_refresh"]:
        return store_refresh(row["index"], row["poc"], row["long_term"]), None
    try:
        if not 0 <= row["frame_num"] < limits.frame_nums:
            raise Refused("invalid: frame number is out of range")
        picture = Reference(row["index"], row["frame_num"], row["poc"])
        if row["commands"] is None:
            return store_sliding(buffer, picture, limits), None
        return store_adaptive(buffer, picture, row["commands"], limits), None
    except Refused as refused:
        return buffer, str(refused)


#: Columns of a row besides the stream, as the rules read them.
ROW = ["index", "kind", "is_reference", "is_refresh", "long_term", "frame_num", "poc", "commands"]


def plain_rows(frame: pd.DataFrame) -> Iterator[dict]:
    """Rows of a frame with missing values as None, False or 0, commands as tuples."""
    for index, kind, is_reference, is_refresh, long_term, frame_num, poc, commands in frame[ROW].itertuples(index=False):
        given = None if commands is None else [(int(c["op"]), int(c["a"] or 0), int(c["b"] or 0)) for c in commands]
        yield {
            "index": int(index), "kind": kind, "is_reference": bool(is_reference), "is_refresh": bool(is_refresh), "long_term": bool(long_term),
            "frame_num": -1 if pd.isna(frame_num) else int(frame_num), "poc": 0 if pd.isna(poc) else int(poc), "commands": given,
        }


def held_rows(buffer: Buffer) -> list[dict]:
    return [{"index": r.index, "frame_num": r.frame_num, "poc": r.poc, "long_index": r.long_index} for r in buffer.held]


def keys_of(frame: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    """The values of the key columns of each row, with missing ones as None, so that they are equal to each other."""
    for values in frame[names].itertuples(index=False, name=None):
        yield tuple(None if pd.isna(v) else v for v in values)


def mark_references(rows: DataFrame, stream: list[str], references: int, log2_frame_nums: int) -> DataFrame:
    """(stream, index, error, held) of each row: the reference buffer behind it, and why its marking was refused.

    Rows: the stream, index (decode order, unique in a stream, not null), kind
    ("picture", "delimiter", "end_of_sequence" or "end_of_stream"),
    is_reference, is_refresh, long_term, frame_num, poc and commands (null for
    the sliding window, else structs of op, a and b). Null flags are false, a
    null frame number is out of range, a null poc is 0. Ends clear the buffer;
    pictures that are no references, and delimiters, leave it. A refused
    picture is not stored and none of its commands holds.

    What is held depends on all rows back to the last refresh or end, and on
    nothing before: so a stream is cut there and its parts are worked on apart,
    each read in order with at most 16 references in hand.
    """
    limits = Limits.of(references, log2_frame_nums)
    begins = ((F.col("kind") == "picture") & F.coalesce(F.col("is_reference") & F.col("is_refresh"), F.lit(False))).cast("long")
    ends = F.col("kind").isin("end_of_sequence", "end_of_stream").cast("long")
    ordered = Window.partitionBy(*stream).orderBy("index")
    part = F.sum(begins).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(ends).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.select(*stream, *ROW).withColumn("_part", part)
    keyed = cut.repartition(*stream, "_part").sortWithinPartitions(*stream, "_part", "index")
    names = [*stream, "_part"]

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, buffer = None, Buffer()
        for frame in frames:
            out = []
            for own, row in zip(keys_of(frame, names), plain_rows(frame), strict=True):
                if own != key:
                    key, buffer = own, Buffer()
                buffer, error = store(buffer, row, limits)
                out.append((*own[:-1], row["index"], error, held_rows(buffer)))
            yield pd.DataFrame(out, columns=[*stream, "index", "error", "held"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return keyed.mapInPandas(play, ", ".join([*(f"`{s}` {types[s]}" for s in stream), f"index long, error string, held {HELD}"]))

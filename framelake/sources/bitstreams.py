"""Elementary streams as rows: units of byte streams and length-prefixed packets, frames of superframes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

UNIT_SCHEMA = "id long, unit int, stream_offset long, data binary, error string"


def start_code_units(data: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """Units between 00 00 01 codes; zeros before the first code and behind a unit are padding, else it is an error."""
    at = data.find(b"\0\0\1")
    if at < 0 or data[:at].strip(b"\0"):
        if data.strip(b"\0") or (at >= 0 and data[:at].strip(b"\0")):
            yield 0, b"", "invalid: no start code"
        return
    while at >= 0:
        after = data.find(b"\0\0\1", at + 3)
        unit = data[at + 3 : after if after >= 0 else len(data)].rstrip(b"\0")
        if not unit:
            yield at + 3, b"", "invalid: empty unit"
            return
        yield at + 3, unit, None
        at = after


def prefixed_units(data: bytes, length_size: int) -> Iterator[tuple[int, bytes, str | None]]:
    """Units behind their length in ``length_size`` bytes, greatest first."""
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + length_size], "big")
        start = at + length_size
        if start > len(data) or start + size > len(data) or not size:
            yield at, b"", "invalid: bad length"
            return
        yield start, data[start : start + size], None
        at = start + size


def superframe(data: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """Frames of a packet: its index, if the last byte marks one, must cover the payload exactly."""
    if not data:
        yield 0, b"", "invalid: empty packet"
        return
    marker = data[-1]
    if marker & 0xE0 != 0xC0:
        yield 0, data, None
        return
    frames, width = (marker & 7) + 1, (marker >> 3 & 3) + 1
    index = 2 + frames * width
    if len(data) < index or data[-index] != marker:
        yield 0, b"", "invalid: bad index"
        return
    body = data[len(data) - index + 1 : -1]
    sizes = [int.from_bytes(body[k * width : (k + 1) * width], "little") for k in range(frames)]
    if 0 in sizes or sum(sizes) != len(data) - index:
        yield 0, b"", "invalid: sizes do not cover the payload"
        return
    at = 0
    for size in sizes:
        yield at, data[at : at + size], None
        at += size


#: Types of sequence and picture parameter sets, with the bits that hold how many follow.
PARAMETER_SETS = ((7, 0x1F), (8, 0xFF))


def configuration_sets(record: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """Parameter sets of a decoder configuration: those of sequences, then of pictures; a faulty record gives its error alone, at the start of the list that holds it."""
    if len(record) < 7 or record[0] != 1 or record[4] < 0xFC or record[5] < 0xE0:
        yield 0, b"", "invalid: bad configuration header"
        return
    found, at = [], 5
    for kind, mask in PARAMETER_SETS:
        left = record[at] & mask if at < len(record) else 0
        at += 1
        if not left:
            yield at - 1, b"", "invalid: no parameter sets"
            return
        for start, unit, error in prefixed_units(record[at:], 2):
            if error or unit[0] & 0x9F != kind:
                break
            found.append((at + start, unit, None))
            left -= 1
            if not left:
                at += start + len(unit)
                break
        if left:
            yield at, b"", "invalid: bad parameter set"
            return
    yield from found


def unescaped(data: bytes) -> bytes | None:
    """Payload without its emulation prevention bytes; null where a forbidden sequence stands."""
    out, zeros, at = bytearray(), 0, 0
    while at < len(data):
        b = data[at]
        if zeros >= 2 and b <= 3:
            if b != 3 or at + 1 == len(data) or data[at + 1] > 3:
                return None
            zeros = 0
        else:
            out.append(b)
            zeros = zeros + 1 if b == 0 else 0
        at += 1
    return bytes(out)


def unescaped_payload(data: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """The one payload of a unit without its emulation prevention bytes, or its error."""
    payload = unescaped(data)
    yield 0, payload or b"", "invalid: forbidden sequence" if payload is None else None


class Bits:
    """Reads a payload bit by bit, the greatest first; reading past the end raises EOFError."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            raise EOFError
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def unsigned(self) -> int:
        """Exponential Golomb code."""
        zeros = 0
        while not self.read(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("code is too long")
        return (1 << zeros) - 1 + self.read(zeros)

    def signed(self) -> int:
        code = self.unsigned()
        return (code + 1) // 2 if code % 2 else -(code // 2)


def split_packets(packets: DataFrame, split: Callable[[bytes], Iterator[tuple[int, bytes, str | None]]]) -> DataFrame:
    """packets (id, data) to one row per unit; what is wrong with a packet is a row with an error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, *row) for i, data in zip(frame["id"], frame["data"], strict=True) for k, row in enumerate(split(bytes(data if data is not None else b"")))]
            yield pd.DataFrame(rows, columns=["id", "unit", "stream_offset", "data", "error"])

    return packets.select("id", "data").mapInPandas(read, UNIT_SCHEMA)

"""A bit cursor over the payloads of a whole batch: all rows are read in step, and rows that fail stay where they were.

Fields are read by NumPy, a field of all rows at a time, so a step costs the
same for one row as for thousands. A row that cannot be read on takes no
further part: its cursor keeps the place of the field that failed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the most bits of one field.
MOST_BITS = 32


class BitBatch:
    """Cursors of the rows of a column of bytes; null rows have failed from the start."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.ok = column.is_valid().to_numpy(zero_copy_only=False).copy()
        rows = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = rows.buffers()
        bounds = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
        own = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        self.bytes = np.concatenate([own, np.zeros(16, np.uint8)])
        self.start = (bounds[:-1] - bounds[0]) * 8
        self.at, self.end = self.start.copy(), (bounds[1:] - bounds[0]) * 8
        self.all = np.ones(len(rows), bool)

    @property
    def position(self) -> np.ndarray:
        """Bits read of each row."""
        return self.at - self.start

    @property
    def remaining(self) -> np.ndarray:
        return self.end - self.at

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The 64 bits from a place on; those behind the end of a row are another's and must not count."""
        first = np.minimum(at >> 3, len(self.bytes) - 9)
        near = self.bytes[first[:, None] + np.arange(9)].astype(np.uint64)
        whole = np.zeros(len(at), np.uint64)
        for k in range(8):
            whole |= near[:, k] << np.uint64(56 - 8 * k)
        shift = (at & 7).astype(np.uint64)
        return (whole << shift) | (near[:, 8] >> (np.uint64(8) - shift))

    def _bits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n`` bits (0 to 64) from a place on as a number."""
        return np.where(n > 0, self._window(at) >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0))

    def _take(self, n: np.ndarray, fits: np.ndarray, where: np.ndarray | None) -> np.ndarray:
        """Moves the rows that read on and marks those that fail; which have read."""
        asked = self.ok if where is None else self.ok & where
        read = asked & fits
        self.ok = self.ok & (~asked | fits)
        self.at = self.at + np.where(read, n, 0)
        return read

    def peek(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, which rows have so many bits left), without moving."""
        width = np.full(len(self.at), n)
        fits = self.ok & (n <= MOST_BITS) & (width <= self.remaining)
        return np.where(fits, self._bits(self.at, width), 0).astype(np.int64), fits

    def read(self, n: int | np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(values, which rows have read) of a field of ``n`` bits, the greatest first."""
        width = np.broadcast_to(np.asarray(n, np.int64), self.at.shape)
        value = self._bits(self.at, np.clip(width, 0, MOST_BITS))
        read = self._take(width, (width <= MOST_BITS) & (width <= self.remaining), where)
        return np.where(read, value, 0).astype(np.int64), read

    def unsigned(self, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """An exponential Golomb code of up to 32 zeros whose value has 32 bits at most."""
        value, width, fits = self._code()
        read = self._take(width, fits, where)
        return np.where(read, value, 0), read

    def signed(self, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A code as 0, 1, -1, 2, -2 and so on; one over 31 bits fails."""
        value, width, fits = self._code()
        number = np.where(value % 2 == 1, (value + 1) // 2, -(value // 2))
        read = self._take(width, fits & (number < 1 << 31), where)
        return np.where(read, number, 0), read

    def _code(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        head = (self._window(self.at) >> np.uint64(31)).astype(np.int64)
        # 33 bits are exact as floats; without any of them set there are over 32 zeros.
        zeros = np.where(head > 0, 32 - np.floor(np.log2(np.maximum(head, 1))).astype(np.int64), 33)
        width = 2 * zeros + 1
        suffix = self._bits(self.at + np.minimum(zeros, 32) + 1, np.minimum(zeros, 32)).astype(np.int64)
        value = (np.int64(1) << np.minimum(zeros, 32)) - 1 + suffix
        return value, width, (zeros <= 32) & (width <= self.remaining) & (value < 1 << 32)

    def skip(self, n: int | np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        width = np.broadcast_to(np.asarray(n, np.int64), self.at.shape)
        return self._take(width, (width >= 0) & (width <= self.remaining), where)

    def align(self, where: np.ndarray | None = None) -> np.ndarray:
        """To the next whole byte; a row that stands at one stays."""
        return self.skip(-self.position % 8, where)

    def rewind(self, position: np.ndarray, where: np.ndarray) -> None:
        """The cursors of rows back to an earlier ``position``; they count as readable again."""
        back = where & (position >= 0) & (position <= self.position)
        self.at = np.where(back, self.start + position, self.at)
        self.ok = self.ok | back

    def fail(self, where: np.ndarray) -> np.ndarray:
        """Marks rows that were read so far and break a rule; which they are."""
        broken = self.ok & where
        self.ok = self.ok & ~where
        return broken

    def at_tail(self) -> np.ndarray:
        """Which rows have nothing left but one bit set and then zeros; a row at its end has no tail."""
        ones = np.concatenate([[0], np.cumsum(self.bytes != 0)])
        mark, _ = self.peek(1)
        after = np.minimum(self.at + 1, self.end)
        edge = np.minimum((after + 7) // 8 * 8, self.end)
        rest = self._bits(after, edge - after)
        return (self.remaining > 0) & (mark == 1) & (rest == 0) & (ones[self.end // 8] == ones[edge // 8])

    def trailing(self, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(1, which rows have read) of a tail of one bit set and then only zeros up to the end of the row."""
        read = self._take(self.remaining, self.at_tail(), where)
        return read.astype(np.int64), read


#: What a field can be, as a step of a batch of cursors.
STEPS: dict[str, Callable[..., object]] = {"bits": BitBatch.read, "unsigned": BitBatch.unsigned, "signed": BitBatch.signed, "skip": BitBatch.skip, "align": BitBatch.align, "trailing": BitBatch.trailing}


def bit_fields(data: Column, fields: list[tuple]) -> Column:
    """struct of the named fields in order, position and complete.

    ``fields`` are (name, kind) or (name, kind, bits), with the kinds of STEPS;
    "skip" and "align" give no column. A field that was not read is null, as are
    all behind it; ``position`` is the place of the first that failed, or the
    end of the last. A null column is not complete, at position 0.
    """
    shown = [f for f in fields if f[1] not in ("skip", "align")]

    @F.arrow_udf(", ".join([*(f"`{f[0]}` long" for f in shown), "position long, complete boolean"]))
    def read(column: pa.Array) -> pa.Array:
        batch = BitBatch(column)
        columns = []
        for field in fields:
            got = STEPS[field[1]](batch, *field[2:])
            if field[1] not in ("skip", "align"):
                columns.append(pa.array(got[0], mask=~got[1]))
        return pa.StructArray.from_arrays([*columns, pa.array(batch.position), pa.array(batch.ok)], [*(f[0] for f in shown), "position", "complete"])

    return read(data)


#: Profiles that are read, the one of them with more fields, and the most macroblocks of a picture.
PROFILES, HIGH = (66, 77, 100), 100
MOST_REFERENCES, MOST_CYCLE, MOST_MACROBLOCKS = 16, 255, 36_864

SEQUENCE_DDL = (
    "id long, profile long, constraints long, level long, frame_num_bits long, order_type long, order_lsb_bits long, deltas_zero boolean, offset_non_reference long, offset_bottom long, offsets array<long>, "
    "references long, gaps boolean, frames_only boolean, adaptive boolean, direct_8x8 boolean, coded_width long, coded_height long, x long, y long, width long, height long, error string"
)


def read_sequence_sets(column: pa.Array) -> pa.Array:
    """Sequence parameter sets without their emulation bytes, as structs of SEQUENCE_DDL; see ``sequence_set``."""
    batch = BitBatch(column)
    n = len(batch.at)
    error = np.full(n, None, object)
    one = lambda where=None: batch.read(1, where)[0].astype(bool)

    def refuse(where: np.ndarray, why: str) -> None:
        error[batch.fail(where)] = why

    profile, _ = batch.read(8)
    refuse(~np.isin(profile, PROFILES), "unsupported: profile")
    constraints, _ = batch.read(8)
    refuse(constraints & 3 != 0, "invalid: reserved bits are set")
    level, _ = batch.read(8)
    ident, _ = batch.unsigned()
    refuse(ident > 31, "invalid: id is out of range")
    high = profile == HIGH
    chroma, _ = batch.unsigned(high)
    refuse(high & (chroma != 1), "unsupported: chroma format")
    luma_depth, chroma_depth = batch.unsigned(high)[0], batch.unsigned(high)[0]
    refuse(high & ((luma_depth > 0) | (chroma_depth > 0)), "unsupported: bit depth")
    one(high)
    refuse(one(high), "unsupported: scaling lists")
    frame_num_bits, _ = batch.unsigned()
    refuse(frame_num_bits > 12, "invalid: bits of frame numbers")
    order_type, _ = batch.unsigned()
    refuse(order_type > 2, "invalid: type of order counts")
    by_lsb, by_cycle = order_type == 0, order_type == 1
    lsb, has_lsb = batch.unsigned(by_lsb)
    refuse(by_lsb & (lsb > 12), "invalid: bits of order counts")
    deltas_zero = one(by_cycle)
    non_reference, has_cycle = batch.signed(by_cycle)
    bottom, _ = batch.signed(by_cycle)
    cycle, _ = batch.unsigned(by_cycle)
    refuse(by_cycle & (cycle > MOST_CYCLE), "invalid: length of the cycle")
    steps = [batch.signed(by_cycle & (cycle > k))[0] for k in range(int(np.max(np.where(batch.ok & by_cycle, cycle, 0), initial=0)))]
    references, _ = batch.unsigned()
    refuse(references > MOST_REFERENCES, "invalid: number of references")
    gaps = one()
    across, down = batch.unsigned()[0] + 1, batch.unsigned()[0] + 1
    frames_only = one()
    adaptive = one(~frames_only)
    direct = one()
    cropped = one()
    left, right, top, under = (batch.unsigned(cropped)[0] for _ in range(4))
    refuse(one(), "unsupported: usability information")
    reading = batch.ok.copy()
    batch.trailing()
    error[reading & ~batch.ok] = "invalid: trailing bits"
    factor = np.where(frames_only, 1, 2)
    # Counts of 32 bits each: as floats, to stay clear of 64 bits.
    refuse(across.astype(float) * down * factor > MOST_MACROBLOCKS, "invalid: picture is too large")
    coded_width, coded_height = across * 16, down * factor * 16
    width, height = coded_width - 2 * (left + right), coded_height - 2 * factor * (top + under)
    refuse((width <= 0) | (height <= 0), "invalid: nothing is visible")
    error[~batch.ok & np.equal(error, None)] = "invalid: truncated set"
    fine = batch.ok
    sound = lambda values, also=True: pa.array(values, mask=~(fine & also))
    offsets = pa.array([[int(s[k]) for s in steps[: cycle[k]]] if fine[k] and by_cycle[k] else None for k in range(n)], pa.list_(pa.int64()))
    columns = [
        sound(ident), sound(profile), sound(constraints), sound(level), sound(frame_num_bits + 4), sound(order_type), sound(lsb + 4, has_lsb), sound(deltas_zero, has_cycle), sound(non_reference, has_cycle), sound(bottom, has_cycle), offsets,
        sound(references), sound(gaps), sound(frames_only), sound(adaptive), sound(direct), sound(coded_width), sound(coded_height), sound(2 * left), sound(2 * factor * top), sound(width), sound(height), pa.array(error, pa.string()),
    ]
    names = [f.strip().split(" ")[0] for f in SEQUENCE_DDL.split(",")]
    return pa.StructArray.from_arrays(columns, names)


def sequence_set(data: Column) -> Column:
    """struct of a sequence parameter set (8-bit 4:2:0 of three profiles), from its bytes behind the unit's first and without emulation bytes.

    Sizes and the visible rectangle are worked out; what cannot be read has an
    error and nulls. Scaling lists and usability information are not read.
    """
    return F.arrow_udf(read_sequence_sets, SEQUENCE_DDL)(data)


#: The most active references by default, quantizers and their offsets, and what weights of predicted pairs are.
MOST_ACTIVE, MIDDLE_QP, MOST_QP, MOST_QP_OFFSET, WEIGHTS = 32, 26, 51, 12, ("default", "explicit", "implicit")

PICTURE_DDL = (
    "id long, sequence_id long, arithmetic boolean, field_order boolean, active_0 long, active_1 long, weighted boolean, pair_weights string, qp long, qs long, chroma_offset long, deblocking boolean, constrained_intra boolean, redundant boolean, transform_8x8 boolean, "
    "second_chroma_offset long, error string"
)


def read_picture_sets(column: pa.Array) -> pa.Array:
    """Picture parameter sets without their emulation bytes, as structs of PICTURE_DDL; see ``picture_set``."""
    batch = BitBatch(column)
    error = np.full(len(batch.at), None, object)
    one = lambda where=None: batch.read(1, where)[0].astype(bool)

    def refuse(where: np.ndarray, why: str) -> None:
        error[batch.fail(where)] = why

    ident, _ = batch.unsigned()
    refuse(ident > 255, "invalid: id is out of range")
    sequence, _ = batch.unsigned()
    refuse(sequence > 31, "invalid: id of the sequence is out of range")
    arithmetic, field_order = one(), one()
    groups, _ = batch.unsigned()
    refuse(groups > 7, "invalid: number of slice groups")
    refuse(groups > 0, "unsupported: slice groups")
    active = []
    for _ in range(2):
        count, _ = batch.unsigned()
        refuse(count >= MOST_ACTIVE, "invalid: number of active references")
        active.append(count + 1)
    weighted = one()
    pairs, _ = batch.read(2)
    refuse(pairs == 3, "invalid: weights of pairs")
    quantizers = []
    for _ in range(2):
        step, _ = batch.signed()
        refuse((step < -MIDDLE_QP) | (step > MOST_QP - MIDDLE_QP), "invalid: quantizer")
        quantizers.append(MIDDLE_QP + step)
    chroma, _ = batch.signed()
    refuse(np.abs(chroma) > MOST_QP_OFFSET, "invalid: offset of the chroma quantizer")
    deblocking, constrained, redundant = one(), one(), one()
    # Sets of older profiles end here; what follows is there only if more than the tail is left.
    more = batch.ok & ~batch.at_tail() & (batch.remaining > 0)
    transform = one(more)
    refuse(one(more), "unsupported: scaling lists")
    second, told = batch.signed(more)
    refuse(told & (np.abs(second) > MOST_QP_OFFSET), "invalid: offset of the chroma quantizer")
    reading = batch.ok.copy()
    batch.trailing()
    error[reading & ~batch.ok] = "invalid: trailing bits"
    error[~batch.ok & np.equal(error, None)] = "invalid: truncated set"
    sound = lambda values: pa.array(values, mask=~batch.ok)
    columns = [
        sound(ident), sound(sequence), sound(arithmetic), sound(field_order), sound(active[0]), sound(active[1]), sound(weighted), sound(np.array(WEIGHTS, object)[np.minimum(pairs, 2)]), sound(quantizers[0]), sound(quantizers[1]), sound(chroma),
        sound(deblocking), sound(constrained), sound(redundant), sound(transform), sound(np.where(more, second, chroma)), pa.array(error, pa.string()),
    ]
    return pa.StructArray.from_arrays(columns, [f.strip().split(" ")[0] for f in PICTURE_DDL.split(",")])


def picture_set(data: Column) -> Column:
    """struct of a picture parameter set, from its bytes behind the unit's first and without emulation bytes.

    Which sequence it belongs to is left to a lookup by sequence_id. Slice
    groups and scaling lists are not read; what cannot be read has an error and
    nulls. Without fields of its own the second chroma offset is the first.
    """
    return F.arrow_udf(read_picture_sets, PICTURE_DDL)(data)

"""MP4 files as rows: boxes, tracks and raw tables, with what cannot be read told apart.

Box headers of many files are read at once, one step along all levels that are
open; all that joins or sums is left to the operators on the resulting tables.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes, with the bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"stsd": 8, b"avc1": 78, b"avc3": 78, b"vp09": 78, b"mp4a": 28}

BOX_SCHEMA = "path string, offset long, size long, kind string, header_size int, depth int, parent long, error string"

#: Levels of boxes that are read; what lies deeper is one row with an error.
MOST_DEPTH = 32

#: Gives so many bytes from an offset on, fewer at the end.
Read = Callable[[int, int], bytes]


def scan_boxes(read: Read, length: int, level: tuple | None = None) -> Iterator[tuple]:
    """(offset, size, kind, header_size, depth, parent, error) of all boxes, a box before those that it holds.

    Only headers are read. The first bad box of a level ends the level. Levels
    that are still open stand on a stack, so depth costs no recursion. It starts
    from a level (place, end, depth, parent), else from that of the whole file.
    """
    levels = [level or (0, length, 0, -1)]
    while levels:
        at, end, depth, parent = levels.pop()
        if at >= end:
            continue
        head = read(at, min(16, end - at))
        if len(head) < 8:
            yield at, end - at, None, 0, depth, parent, "invalid: truncated header"
            continue
        size, kind = struct.unpack_from(">I4s", head)
        header = 8
        if size == 1:
            if len(head) < 16:
                yield at, end - at, None, 0, depth, parent, "invalid: truncated header"
                continue
            size, header = struct.unpack_from(">Q", head, 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            header += 16
        if size < header or size > end - at:
            yield at, end - at, kind.decode("latin-1"), header, depth, parent, "invalid: size out of bounds"
            continue
        yield at, size, kind.decode("latin-1"), header, depth, parent, None
        levels.append((at + size, end, depth, parent))
        if kind in CONTAINERS:
            inside = min(at + header + CONTAINERS[kind], at + size)
            if depth + 1 < MOST_DEPTH:
                levels.append((inside, at + size, depth + 1, at))
            elif inside < at + size:
                yield inside, at + size - inside, None, 0, depth + 1, at, "invalid: nested too deep"


def box_rows(data: bytes) -> Iterator[tuple]:
    """``scan_boxes`` of bytes at hand."""
    return scan_boxes(lambda at, n: data[at : at + n], len(data))


PARSED = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("kind", pa.string()), ("header_size", pa.int32()), ("depth", pa.int32()), ("parent", pa.int64()), ("error", pa.string()), ("payload", pa.binary())])


TRUNCATED, OUT_OF_BOUNDS, TOO_DEEP = ERRORS = ["invalid: truncated header", "invalid: size out of bounds", "invalid: nested too deep"]

#: With fewer open levels than that in a batch, what is left of them is read level by level.
FEW_LEVELS = 32

_HEADS = {int.from_bytes(kind, "big"): inside for kind, inside in CONTAINERS.items()}
_UUID = int.from_bytes(b"uuid", "big")


def _contents(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a column of contents with the place and length of each; those of nulls are empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], lengths


def _numbers(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Big-endian numbers of 4 or 8 bytes at places; past the end of all data its last byte is repeated."""
    return data[np.minimum(at[:, None] + np.arange(size), len(data) - 1)].view(f">u{size}")[:, 0]


def scan_batch(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """``scan_boxes`` of many contents in one buffer, as columns: file, offset, size, kind (as a number, -1: none), header_size, depth, parent, error (place in ERRORS, -1: none).

    Each step reads the next box of every level that is open in any file.
    """
    found: list[list] = []

    def add(file, offset, size, kind, header, depth, parent, error):
        found.append([np.broadcast_to(np.asarray(c, np.int64), file.shape) for c in (file, offset, size, kind, header, depth, parent, error)])

    none = np.zeros(len(starts), np.int64)
    file, at, end, depth, parent = np.arange(len(starts)), none, lengths.astype(np.int64), none, none - 1
    while True:
        live = at < end
        file, at, end, depth, parent = (c[live] for c in (file, at, end, depth, parent))
        if len(file) < FEW_LEVELS:
            break
        room, place = end - at, starts[file] + at
        both = _numbers(data, place, 8).astype(np.uint64)
        size, kind = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        large = (size == 1) & (room >= 8)
        cut = (room < 8) | (large & (room < 16))
        if large.any():
            # What is over 63 bits is out of bounds in any case.
            size = np.where(large, np.minimum(_numbers(data, place + 8, 8), (1 << 63) - 1).astype(np.int64), size)
        size = np.where((size == 0) & ~large, room, size)
        header = np.where(large, 16, 8) + np.where(kind == _UUID, 16, 0)
        bad = ~cut & ((size < header) | (size > room))
        if cut.any():
            add(file[cut], at[cut], room[cut], -1, 0, depth[cut], parent[cut], 0)
        if bad.any():
            add(file[bad], at[bad], room[bad], kind[bad], header[bad], depth[bad], parent[bad], 1)
        sound = ~(cut | bad)
        file, at, end, depth, parent, size, kind, header = (c[sound] for c in (file, at, end, depth, parent, size, kind, header))
        add(file, at, size, kind, header, depth, parent, -1)
        holds, inside = np.zeros(len(file), bool), np.zeros(len(file), np.int64)
        for code, skip in _HEADS.items():
            own = kind == code
            holds |= own
            inside[own] = skip
        inside = np.minimum(at + header + inside, at + size)
        deep = holds & (depth + 1 >= MOST_DEPTH) & (inside < at + size)
        if deep.any():
            add(file[deep], inside[deep], (at + size - inside)[deep], -1, 0, depth[deep] + 1, at[deep], 2)
        holds &= depth + 1 < MOST_DEPTH
        file, at, end, depth, parent = (np.concatenate(pair) for pair in ((file, file[holds]), (at + size, inside[holds]), (end, (at + size)[holds]), (depth, depth[holds] + 1), (parent, at[holds])))
    rows = []
    for f, *level in zip(*(c.tolist() for c in (file, at, end, depth, parent)), strict=True):
        own = data[starts[f] : starts[f] + lengths[f]].data
        for offset, size, kind, header, deep, above, error in scan_boxes(lambda at, n, own=own: bytes(own[at : at + n]), 0, tuple(level)):
            rows.append((f, offset, size, -1 if kind is None else int.from_bytes(kind.encode("latin-1"), "big"), header, deep, above, -1 if error is None else ERRORS.index(error)))
    if rows:
        found.append(list(np.array(rows, np.int64).T))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [none[:0]] * 8
    # In the order of their places a box comes before those that it holds.
    order = np.lexsort((columns[1], columns[0]))
    return [c[order] for c in columns]


def _pieces(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, there: np.ndarray) -> pa.Array:
    """Binary values cut from one buffer; null where they are not there."""
    ends = np.cumsum(np.where(there, lengths, 0))
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    if offsets[-1] < 64 * len(at):
        # Short ones all at once, with the place of each byte.
        own = np.where(there, lengths, 0)
        taken = data[np.repeat(at - (ends - own), own) + np.arange(offsets[-1])]
    else:
        bytes_ = memoryview(data)
        taken = b"".join([bytes_[a : a + n] for a, n in zip(at[there].tolist(), lengths[there].tolist(), strict=True)])
    return pa.Array.from_buffers(pa.binary(), len(at), [pa.py_buffer(np.packbits(there, bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(taken)])


#: Bytes of payloads after which a task hands on the rows it has.
FLUSH_BYTES = 1 << 24


def _number(kind: str) -> int:
    return int.from_bytes(kind.encode("latin-1"), "big")


def parsed(files: DataFrame, kinds: list[str]) -> DataFrame:
    """files (path, content) to one row per box, with the payload of the sound ones of some kinds, in one pass over each file.

    Null contents have no boxes. What is parsed can stand wherever operators on
    tracks take files; write it where several of them follow.
    """
    wanted = np.array([_number(kind) for kind in kinds], np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, lengths = _contents(batch["content"])
            rows = scan_batch(data, starts, lengths)
            held = (rows[7] < 0) & np.isin(rows[3], wanted)
            flush = np.cumsum(np.where(held, rows[2] - rows[4], 0)) // FLUSH_BYTES
            for part in np.split(np.arange(len(flush)), np.flatnonzero(np.diff(flush)) + 1):
                file, offset, size, kind, header, depth, parent, error = (c[part] for c in rows)
                codes, places = np.unique(kind, return_inverse=True)
                names = pa.array([None if c < 0 else int(c).to_bytes(4, "big").decode("latin-1") for c in codes], pa.string())
                said = pa.array(ERRORS).take(pa.array(error, mask=error < 0))
                payload = _pieces(data, starts[file] + offset + header, size - header, held[part])
                columns = [batch["path"].take(pa.array(file)), pa.array(offset), pa.array(size), names.take(pa.array(places)), pa.array(header.astype(np.int32)), pa.array(depth.astype(np.int32)), pa.array(parent), said, payload]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, PARSED, strict=True)], schema=PARSED)

    return files.select("path", "content").mapInArrow(read, f"{BOX_SCHEMA}, payload binary")


def holders(files: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """One row per box of ``kind``, and per other box that holds some of ``kinds``: path, box (its place, -1: the file), parent and one array for each of ``kinds``.

    The arrays have the payloads of the sound boxes of that kind that the box
    holds itself, in their order. ``parent`` is known of boxes of ``kind`` and
    null for others. Files are (path, content) or what is ``parsed`` of them.
    """
    if "content" not in files.columns:
        of = lambda name: F.sort_array(F.collect_list(F.when(F.col("kind") == name, F.struct("offset", "payload"))))["payload"].alias(name)
        is_kind = F.col("kind") == kind
        rows = files.where(F.col("error").isNull() & F.col("kind").isin(kind, *kinds))
        keyed = rows.withColumns({"box": F.when(is_kind, F.col("offset")).otherwise(F.col("parent")), "parent": F.when(is_kind, F.col("parent"))})
        return keyed.groupBy("path", "box").agg(F.max("parent").alias("parent"), *map(of, kinds))
    schema = pa.schema([("path", pa.string()), ("box", pa.int64()), ("parent", pa.int64()), *((k, pa.list_(pa.binary())) for k in kinds)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, lengths = _contents(batch["content"])
            file, offset, size, found, header, _, parent, error = scan_batch(data, starts, lengths)
            # A box of a batch is one number: its file and its place in it, from 0 for the file itself.
            places = int(lengths.max(initial=0)) + 2
            own, above = file * places + offset + 1, file * places + parent + 1
            named, held = (error < 0) & (found == _number(kind)), (error < 0) & np.isin(found, [_number(k) for k in kinds])
            keys = np.unique(np.concatenate([own[named], above[held]]))
            parents, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            at = np.searchsorted(keys, own[named])
            parents[at], known[at] = parent[named], True
            columns = [batch["path"].take(pa.array(keys // places)).cast(pa.string()), pa.array(keys % places - 1), pa.array(parents, mask=~known)]
            for k in kinds:
                mine = np.flatnonzero(held & (found == _number(k)))
                at = np.searchsorted(keys, above[mine])
                order = np.argsort(at, kind="stable")
                mine, counts = mine[order], np.bincount(at, minlength=len(keys))
                payloads = _pieces(data, starts[file[mine]] + offset[mine] + header[mine], size[mine] - header[mine], np.ones(len(mine), bool))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), payloads))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(read, ", ".join(["path string, box long, parent long", *(f"{k} array<binary>" for k in kinds)]))


def boxes(files: DataFrame) -> DataFrame:
    """One row per box of files (path, content) or of what is ``parsed`` of them."""
    return (parsed(files, []) if "content" in files.columns else files).drop("payload")


def box_payloads(files: DataFrame, kinds: list[str]) -> DataFrame:
    """The sound boxes of some kinds with their payload, of files (path, content) or of what is ``parsed`` of them with these kinds."""
    found = parsed(files, kinds) if "content" in files.columns else files
    return found.where(F.col("error").isNull() & F.col("kind").isin(kinds))


def full_box_entries(payloads: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """Payloads of a version, flags, a count and entries of ``width`` bytes to ``keep``, version, entry and data; short boxes give none."""
    count = F.conv(F.hex(F.substring("payload", 5, 4)), 16, 10).cast("long")
    fits = payloads.withColumn("_n", count).where((F.col("_n") > 0) & (F.length("payload") == 8 + F.col("_n") * width))
    version = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int").alias("version")
    # Cut into pieces before rows are made of it, so that no row copies the whole list.
    entries = F.transform(F.sequence(F.lit(0), F.col("_n").cast("int") - 1), lambda k: F.substring(F.col("payload"), 9 + k * width, F.lit(width)))
    return fits.select(*keep, version, F.posexplode(entries).alias("entry", "data"))


def read_files(spark, path: str) -> DataFrame:
    """Files of a folder as (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")

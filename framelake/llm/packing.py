"""Best-two-fit packing of documents into token sequences of one size.

Only the number of pieces of each length matters to the packing, so the driver
packs a histogram of at most ``capacity`` entries: it fills a bin greedily with
the longest pieces that fit, then replaces the bin's smallest piece with the two
unpacked pieces that fill the widened gap best, and repeats the bin as often as
the counts allow. The pieces are ranked within their length on the cluster and
take the places that the plan gives their rank.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import row_chunks, stored

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Pieces of one length are ranked in groups of about so many, and in so many groups at least, so that many tasks rank a frequent length.
RANK_ROWS = 100_000
RANK_GROUPS = 64

#: The faster encoder recurses over white space; runs of so many characters go to the other, which gives the same ids.
LONG_RUN = re.compile(r"\s{100000}")


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE in two forms of equal ids: ranks with their splitting pattern, and the JSON form.

    ``special`` are the added tokens of the JSON form: strings with ids of their own.
    """

    ranks: bytes
    pattern: str
    json: str
    special: tuple[tuple[str, int], ...] = ()

    @staticmethod
    def read(ranks_path: str, pattern: str, json_path: str, special: tuple[tuple[str, int], ...] = ()) -> Vocabulary:
        with open(ranks_path, "rb") as ranks, open(json_path, encoding="utf-8") as json:
            return Vocabulary(ranks.read(), pattern, json.read(), special)


@lru_cache(maxsize=2)
def _encoding(vocabulary: Vocabulary) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.ranks.splitlines())}
    return tiktoken.Encoding("framelake", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.special))


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: Vocabulary) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_str(vocabulary.json)


def encoded(vocabulary: Vocabulary, text: str) -> list[int]:
    """The ids of a text, as the JSON form gives them without special tokens around it."""
    if len(text) >= 100_000 and LONG_RUN.search(text):
        return _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    return _encoding(vocabulary).encode(text, allowed_special="all")


def piece_bounds(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces: whole ones of ``capacity``, the first takes what is over."""
    first = tokens % capacity or capacity
    return [(0, min(first, tokens)), *((start, capacity) for start in range(first, tokens, capacity))]


def tokenize(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, along: tuple[str, ...] = ()) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32, if asked for ids array<int>, and the document's columns ``along``.

    A document is the ids of its text, in which the strings of added tokens
    are their ids, and ``end_id``; a null text is empty. Only documents of over
    ``capacity`` ids are cut. Other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoded, shipped.value)
        for batch in row_chunks(batches):
            out: list[tuple] = []
            kept: list[np.ndarray] = []
            rows: list[int] = []
            for row, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids = encode(text or "")
                ids.append(end_id)
                data = np.array(ids, "<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    part = data[start : start + length]
                    out.append((doc_id, k, start, length, zlib.crc32(part)))
                    kept.append(part)
                    rows.append(row)
            columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32())))
                names.append("ids")
            for name in along:
                columns.append(batch.column(name).take(pa.array(rows, pa.int64())))
                names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    read = docs.select(F.col("doc_id").cast("long"), "text", *along)
    more = "".join(f", `{name}` {read.schema[name].dataType.simpleString()}" for name in along)
    return read.mapInArrow(pieces, PIECE_SCHEMA + ", ids array<int>" * keep_ids + more)


@dataclass
class Bin:
    """``repeats`` sequences with pieces of these lengths, in this order."""

    lengths: list[int]
    repeats: int


def _last_available(counts: np.ndarray) -> np.ndarray:
    """For each x the greatest length up to x with a count; 0 where there is none."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def pack_histogram(counts_by_length: dict[int, int], capacity: int) -> list[Bin]:
    """Best-two-fit over counts of lengths from 1 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in counts_by_length.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        counts[length] = n
    bins = []
    while counts.any():
        left = counts.copy()
        at_most = _last_available(left)
        held, gap = [], capacity
        while at_most[gap]:
            length = int(at_most[gap])
            take = int(min(left[length], gap // length))
            held += [length] * take
            gap -= take * length
            left[length] -= take
            if not left[length]:
                at_most = _last_available(left)
        if gap and len(held) > 1:
            room = held[-1] + gap
            a = np.flatnonzero(left[:room])
            b = at_most[room - a]
            b = np.where((b == a) & (left[a] < 2), at_most[b - 1], b) * (a > 0)
            total = np.where(b > 0, a + b, 0)
            if len(total) and total.max() > held[-1]:
                best = int(total.argmax())
                held[-1:] = sorted((int(a[best]), int(b[best])), reverse=True)
        used = np.bincount(held, minlength=capacity + 1)
        some = used > 0
        repeats = int((counts[some] // used[some]).min())
        counts -= used * repeats
        bins.append(Bin(held, repeats))
    return bins


@dataclass
class Places:
    """Runs of ranks within a length, sorted by (length, first rank), with the place of each run's first piece."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


#: Ranks within a length stay under this; length * RANK_SPAN + rank then sorts by both.
RANK_SPAN = 1 << 50


def places_of(bins: list[Bin]) -> Places:
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for b in bins:
        offset = 0
        for length in b.lengths:
            rank = next_rank.get(length, 0)
            rows.append((length * RANK_SPAN + rank, rank, sequence, offset))
            next_rank[length] = rank + b.repeats
            offset += length
        sequence += b.repeats
    return Places(*np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def rank_within_length(pieces: DataFrame, groups: int) -> DataFrame:
    """``pieces`` with _rank, gapless from 0 within each length.

    Pieces of a length are dealt over ``groups`` groups by hash, numbered there
    and moved up by the sizes of the groups before.
    """
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n")).select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(bases, ["length", "_group"]).withColumn("_rank", F.col("_base") + F.col("_at")).drop("_group", "_at", "_base")


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, packed best-two-fit.

    ``pieces`` is read twice, so it should be a stored table. The driver holds
    at most ``capacity`` counts. Repeated rows are packed as separate pieces.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shipped = pieces.sparkSession.sparkContext.broadcast(places_of(pack_histogram(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Places = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("length", "_rank"))
            at = np.searchsorted(p.key, length * RANK_SPAN + rank, side="right") - 1
            columns = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(p.sequence[at] + rank - p.first[at]), pa.array(p.offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    groups = max(RANK_GROUPS, max(counts.values(), default=0) // RANK_ROWS)
    return rank_within_length(pieces, groups).mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """All ``docs`` (doc_id, text) as pieces in sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. A
    null or empty text is a piece of ``end_id`` alone; long texts become several
    pieces; an empty table gives no rows; other columns are ignored.
    """
    return pack_pieces(stored(tokenize(docs, vocabulary, capacity, end_id), "pieces"), capacity)


#: Windows are numbered in runs of so many, so that no task sums over all of them.
WINDOW_RUN = 1_000


def pack_in_order(pieces: DataFrame, window: str, within: list[str], capacity: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset, packed best-two-fit within each value of ``window``, a long from 0 on.

    sequence_id rises with the window; in a window the sequences go by the
    first of their pieces in the order of ``within``, longs. A task holds the
    pieces of one window at a time.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    order = [*within, "doc_id", "piece", "ids_crc32"]

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([(name, "ascending") for name in order])
        lengths = group.column("length").to_numpy()
        waiting: dict[int, list[int]] = {}
        for row, length in enumerate(lengths.tolist()):
            waiting.setdefault(length, []).append(row)
        taken = dict.fromkeys(waiting, 0)
        sequences = []
        for b in pack_histogram({length: len(rows) for length, rows in waiting.items()}, capacity):
            for _ in range(b.repeats):
                rows, at = [], 0
                for length in b.lengths:
                    rows.append((waiting[length][taken[length]], at))
                    taken[length] += 1
                    at += length
                sequences.append((min(rows)[0], rows))
        local, offset = np.empty((2, len(lengths)), np.int64)
        for k, (_, rows) in enumerate(sorted(sequences)):
            for row, at in rows:
                local[row], offset[row] = k, at
        return pa.table([*(group.column(name) for name in columns), group.column(window), pa.array(local), pa.array(offset)], names=[*columns, "_window", "_local", "offset"])

    packed = stored(pieces.select(*columns, window, *within).groupBy(window).applyInArrow(pack, PIECE_SCHEMA + ", _window long, _local long, offset long"), "packed")
    run = F.expr(f"_window div {WINDOW_RUN}")
    counts = packed.groupBy("_window").agg((F.max("_local") + 1).alias("_n")).withColumn("_run", run)
    inside = Window.partitionBy("_run").orderBy("_window").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("_run").agg(F.sum("_n").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(runs, "_run").select("_window", (F.col("_base") + F.col("_first")).alias("_base"))
    return packed.join(bases, "_window").select(*columns, (F.col("_base") + F.col("_local")).alias("sequence_id"), "offset")

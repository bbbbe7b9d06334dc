"""Order MinHash fingerprints: likeness that falls with edit distance.

A text becomes word k-mers, each numbered by its occurrence, so that repeated
k-mers differ. Every one of ``size`` hash functions picks the ``taken`` k-mers
of least hash and keeps them in the order of the text; the hash of that tuple
is one entry of the fingerprint. Two fingerprints are alike by the share of
equal entries.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import shuffle_partitions
from framelake.llm.wordhash import SPREAD, joined_bytes, mix, sequence_hashes, word_hashes

#: Greater than any hash; marks k-mers that were taken.
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class OrderMinHash:
    """Texts of under ``short_words`` words are cut into characters in place of words."""

    size: int = 64
    word_k: int = 2
    char_k: int = 4
    taken: int = 2
    short_words: int = 8

    def kmers(self, texts: list[str]) -> list[np.ndarray]:
        """Hashes of each text's k-mers in its order; units that are too few for one make a single k-mer."""
        units, counts = word_hashes(*joined_bytes([t.encode() for t in texts]))
        words = sequence_hashes(units, self.word_k)
        ends = np.cumsum(counts)
        out = []
        for text, end, count in zip(texts, ends.tolist(), counts.tolist(), strict=True):
            if count >= self.short_words:
                out.append(words[end - count : end - self.word_k + 1])
            else:
                points = mix(np.array(list(map(ord, text)), np.uint64) + SPREAD)
                out.append(sequence_hashes(points, max(1, min(self.char_k, len(points)))) if len(points) else np.zeros(1, np.uint64))
        return out

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """An array of texts x ``size`` entries of 32 bits."""
        parts = self.kmers(texts)
        if not parts:
            return np.zeros((0, self.size), np.uint32)
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        base = np.concatenate(parts)
        place = np.arange(len(base)) - np.repeat(starts, lengths)
        bits = np.uint64(max(1, int(lengths.max()).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        place = place.astype(np.uint64)
        base = _mix_occurrences(base, place, starts, lengths, low)
        # The low bits of a hash hold the place in the text, so a minimum carries its place.
        out = np.empty((len(parts), self.size), np.uint32)
        seeds = np.random.default_rng(20_240_601).integers(1, 1 << 63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for j in range(self.size):
            ranked = (base * seeds[j]) & ~low | place
            places = np.empty((self.taken, len(parts)), np.uint64)
            for n in range(self.taken):
                least = np.minimum.reduceat(ranked, starts)
                # A text with fewer k-mers than are taken repeats its last.
                spent = least == np.uint64(MASK)
                places[n] = np.where(spent, places[n - 1] if n else 0, least & low)
                ranked[starts + places[n].astype(np.int64)] = np.uint64(MASK)
            places.sort(axis=0)
            entry = np.zeros(len(parts), np.uint64)
            for n in range(self.taken):
                entry = mix(entry * SPREAD + base[starts + places[n].astype(np.int64)])
            out[:, j] = entry >> np.uint64(32)
        return out


def _mix_occurrences(base: np.ndarray, place: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: np.uint64) -> np.ndarray:
    """K-mer hashes that also hold which occurrence in its text each is: the first, the second and so on."""
    keyed = (base & ~low) | place
    for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
        keyed[start : start + length].sort()
    fresh = np.ones(len(keyed), bool)
    fresh[1:] = (keyed[1:] & ~low) != (keyed[:-1] & ~low)
    fresh[starts] = True
    at = np.arange(len(keyed))
    number = at - np.maximum.accumulate(np.where(fresh, at, 0))
    occurrence = np.zeros(len(keyed), np.uint64)
    occurrence[np.repeat(starts, lengths) + (keyed & low).astype(np.int64)] = number
    return mix(base + occurrence * SPREAD)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def printed(entries: np.ndarray) -> list[str]:
    return [base64.b64encode(row.astype("<u4").tobytes()).decode() for row in entries]


def fingerprint(docs: DataFrame, method: OrderMinHash = OrderMinHash()) -> DataFrame:
    """doc_id and the fingerprint string of every text of ``docs``; a null text is empty.

    The empty text has a fingerprint of its own; other columns are ignored.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _text_slices(batch.column(1)):
                texts = [x or "" for x in batch.column(1).slice(*part).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(*part), pa.array(printed(method.fingerprints(texts)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, fingerprint string")


#: Bytes of text that are fingerprinted at once.
SLICE_BYTES = 1 << 19


def _text_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Offsets and lengths of runs of about SLICE_BYTES of text, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield start, stop - start
        start = stop


EDITED_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


#: Ranges differ in rows by a few times one in so many of all rows.
QUANTILE_ACCURACY = 10_000


def _range_of(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at least doc_id, found by halving; null ids come last."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    halves = F.split(F.lit(",".join(map(str, steps))), ",").cast("array<int>")
    below = F.aggregate(halves, F.lit(0), lambda found, step: F.when(F.get(table, found + step - 1) < F.col("doc_id"), found + step).otherwise(found))
    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - below)


def _with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (_range, _own, doc_id, text, _tie): each range's own texts and one text more, the one after its last.

    The ranges follow quantiles of doc_id downwards; after the last text of all
    comes the first. Null ids come last, and rows of one id are ordered by
    their text's hash. The driver sees one row per range.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / ranges for k in range(1, ranges)], QUANTILE_ACCURACY)).first()[0] if ranges > 1 else None
    cuts = sorted(set(found or []))
    keyed = keyed.withColumn("_range", _range_of(cuts) if cuts else F.lit(0))
    downwards = F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("d"), F.col("_tie").alias("t"))
    firsts = keyed.select("_range", "doc_id", "_tie", downwards.alias("_at")).groupBy("_range").agg(F.min_by(F.struct("doc_id", "_tie"), "_at").alias("f")).orderBy("_range").collect()
    if not firsts:
        return keyed.withColumn("_own", F.lit(True))
    tails = [(firsts[k - 1]["_range"], r["f"]["doc_id"], r["f"]["_tie"]) for k, r in enumerate(firsts)]
    tails = F.broadcast(docs.sparkSession.createDataFrame(tails, "_before int, _id long, _hash long"))
    marked = keyed.join(tails, keyed.doc_id.eqNullSafe(tails._id) & (keyed._tie == tails._hash), "left")
    own = F.struct(F.col("_range"), F.lit(True).alias("_own"))
    tail = F.struct(F.col("_before").alias("_range"), F.lit(False).alias("_own"))
    places = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, tail))
    return marked.withColumn("_place", F.explode(places)).select("_place.*", "doc_id", "text", "_tie")


def fingerprint_edits(docs: DataFrame, method: OrderMinHash = OrderMinHash(), ranges: int | None = None) -> DataFrame:
    """Every text with its fingerprint, that of its edited form, and how alike both and the next text are.

    The next text is the one of the next smaller doc_id. Returns doc_id,
    n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A null text is empty; a table of one row is its
    own next; an empty table gives no rows; repeated rows repeat; other columns
    are ignored. Texts are sorted once, a range of doc_id in each partition,
    and streamed.
    """
    ranges = ranges or shuffle_partitions(docs.sparkSession)
    sorted_ = _with_next(docs.select("doc_id", "text"), ranges).repartitionById(ranges, F.col("_range")).sortWithinPartitions("_range", F.desc("_own"), F.desc_nulls_last("doc_id"), "_tie")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in source:
            for start, length in _text_slices(batch.column(3)):
                part = batch.slice(start, length)
                rows = held + list(zip(*(part.column(k).to_pylist() for k in range(4)), strict=True))
                held = rows[-1:]
                at = [i for i in range(len(rows) - 1) if rows[i][1] and rows[i][0] == rows[i + 1][0]]
                if not at:
                    continue
                texts = [r[3] for r in rows]
                changed = [edited(texts[i], texts[i + 1]) for i in at]
                plain, altered = method.fingerprints(texts), method.fingerprints(changed)
                here = np.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[i][2] for i in at], pa.int64()),
                        pa.array([len(texts[i]) for i in at], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                        pa.array(printed(plain[here]), pa.string()),
                        pa.array(printed(altered), pa.string()),
                        pa.array(likeness(plain[here], altered)),
                        pa.array(likeness(plain[here], plain[here + 1])),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return sorted_.select("_range", "_own", "doc_id", "text").mapInArrow(batches, EDITED_SCHEMA)

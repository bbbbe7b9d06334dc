"""Pfair mixing: interleave sources so that each is always within a block of its target weight.

A source's rows, in an order given by their hash, are cut into blocks of equal
bytes. Block i of a source with weight w may start at slot floor(i / w) and is
due by slot ceil((i + 1) / w), both exact for any w; one slot at a time the
released block that is due first is taken. The driver schedules blocks, of
which there is a bounded number, and the rows are joined to their places.
"""

from __future__ import annotations

import heapq
import math
import zlib
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import discard, shuffle_partitions, small_table, stored

#: Bytes of a block, doubled until all rows fit in MOST_BLOCKS blocks.
BLOCK_BYTES = 1 << 16
MOST_BLOCKS = 1 << 17

#: Bytes of a group of a source's rows that one task sums up in order.
GROUP_BYTES = 1 << 26

#: Least digits of the order hash by which a source's rows are grouped; 16^n groups.
GROUP_DIGITS = 3

#: Rows of a stored file that one task sums up in order.
SPAN_ROWS = 100_000

#: Key of the metadata that says that rows are in the order of the mix.
MARK = "mixed"

#: What rows without a source are counted as.
NO_SOURCE = ""

#: What a placed row is given.
MIX_COLUMNS = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset"]


def whole_ratio(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights, which are positive."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights are positive")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def pfair_schedule(weights: dict[str, float | Fraction], blocks: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """(release, deadline, slot) of each of a source's ``blocks``: earliest deadline first among the released.

    Of equal deadlines the lesser name goes first. A slot in which no block is
    released stays empty: a source that is spent leaves its slots, and the
    others keep theirs.
    """
    ratio = whole_ratio({s: weights[s] for s in blocks})
    total = sum(ratio.values())
    window = lambda s, i: (i * total // ratio[s], -(-(i + 1) * total // ratio[s]))
    out: dict[str, list] = {s: [] for s in blocks}
    waiting = [(0, s) for s, n in blocks.items() if n > 0]
    heapq.heapify(waiting)
    due: list[tuple[int, str]] = []
    slot = 0
    while waiting or due:
        if not due:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(due, (window(s, len(out[s]))[1], s))
        deadline, s = heapq.heappop(due)
        out[s].append((window(s, len(out[s]))[0], deadline, slot))
        if len(out[s]) < blocks[s]:
            heapq.heappush(waiting, (window(s, len(out[s]))[0], s))
        slot += 1
    return out


def _order_key() -> Column:
    """Equal rows have equal keys; their order does not matter."""
    return F.md5(F.concat_ws("\x01", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))


def _size() -> Column:
    return (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long")


def source_sizes(docs: DataFrame) -> dict[str, int]:
    """Bytes of each source, a text taking its UTF-8 bytes and one more; a registry that the driver holds."""
    rows = docs.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("source")).agg(F.sum(_size()).alias("bytes")).collect()
    return {r["source"]: r["bytes"] for r in rows}


def root_weights(sizes: dict[str, int]) -> dict[str, int]:
    """The whole part of the square root of each source's bytes as its weight."""
    return {s: math.isqrt(n) for s, n in sizes.items()}


def block_size(total: int, least: int = BLOCK_BYTES) -> int:
    """``least`` bytes, doubled until ``total`` bytes are at most MOST_BLOCKS blocks."""
    while total > least * MOST_BLOCKS:
        least *= 2
    return least


def mix_sources(docs: DataFrame, weights: dict[str, float | Fraction], sizes: dict[str, int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with mix_block, mix_release, mix_deadline, mix_slot and mix_offset.

    A row lies in the block of its source in which its first byte lies; a text
    takes its UTF-8 bytes and one more. mix_slot is when the block is to be
    read: reading in order of mix_slot and mix_offset mixes the sources. Blocks
    hold ``block_bytes``, more where block_size says so. ``sizes`` are those of
    source_sizes, if they are known. Every row is placed once. Where a source
    is spent its later slots stay empty, and the others keep their proportions.
    A null source is the empty one, a null text is empty; repeated rows follow
    each other; a source missing from ``weights`` is an error. An empty table
    gives no rows. Columns of ``docs`` that are named like the new ones are
    replaced.
    """
    placed, _ = _placed(docs, weights, sizes, block_bytes)
    kept = [c for c in docs.columns if c.lower() not in MIX_COLUMNS]
    return placed.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"_fl_{c}").alias(c) for c in MIX_COLUMNS))


def _placed(docs: DataFrame, weights: dict[str, float | Fraction], sizes: dict[str, int] | None, block_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with the new columns under names of their own and _fl_turn, the place of its block among all, and the number of blocks."""
    sizes = source_sizes(docs) if sizes is None else sizes
    for s in sizes:
        if s not in weights:
            raise ValueError(f"no weight for source {s}")
    block = block_size(sum(sizes.values()), block_bytes)
    plan = pfair_schedule(weights, {s: -(-n // block) for s, n in sizes.items()})
    turns = {slot: k for k, slot in enumerate(sorted(p[2] for places in plan.values() for p in places))}
    rows = [{"_fl_s": s, "_fl_release": [p[0] for p in places], "_fl_deadline": [p[1] for p in places], "_fl_slot": [p[2] for p in places], "_fl_turns": [turns[p[2]] for p in places]} for s, places in plan.items()]
    places = small_table(docs.sparkSession, rows, "_fl_s string, _fl_release array<long>, _fl_deadline array<long>, _fl_slot array<long>, _fl_turns array<long>")
    digits = GROUP_DIGITS
    while max(sizes.values(), default=0) > GROUP_BYTES << 4 * digits:
        digits += 1
    source, group = F.coalesce("source", F.lit(NO_SOURCE)), F.substring(_order_key(), 1, digits)
    keyed = docs.withColumns({"_fl_source": source, "_fl_key": _order_key(), "_fl_bytes": _size(), "_fl_group": group})
    # Bytes before a row: those of its source's groups before, and those before it in its group.
    groups_before = Window.partitionBy("_fl_source").orderBy("_fl_group").rowsBetween(Window.unboundedPreceding, -1)
    light = docs.select(source.alias("_fl_source"), group.alias("_fl_group"), _size().alias("_fl_bytes"))
    bases = light.groupBy("_fl_source", "_fl_group").agg(F.sum("_fl_bytes").alias("_fl_sum")).select("_fl_source", "_fl_group", F.coalesce(F.sum("_fl_sum").over(groups_before), F.lit(0)).alias("_fl_base"))
    inside = Window.partitionBy("_fl_source", "_fl_group").orderBy("_fl_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_fl_before", F.coalesce(F.sum("_fl_bytes").over(inside), F.lit(0))).join(bases, ["_fl_source", "_fl_group"]).withColumn("_fl_at", F.col("_fl_base") + F.col("_fl_before"))
    placed = placed.withColumn("_fl_mix_block", F.expr(f"_fl_at div {block}")).join(F.broadcast(places), F.col("_fl_source") == F.col("_fl_s"))
    of_block = lambda name: F.get(name, F.col("_fl_mix_block").cast("int"))
    placed = placed.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        "_fl_mix_block",
        of_block("_fl_release").alias("_fl_mix_release"),
        of_block("_fl_deadline").alias("_fl_mix_deadline"),
        of_block("_fl_slot").alias("_fl_mix_slot"),
        (F.col("_fl_at") - F.col("_fl_mix_block") * F.lit(block)).alias("_fl_mix_offset"),
        of_block("_fl_turns").alias("_fl_turn"),
    )
    return placed, len(turns)


def in_mixed_order(docs: DataFrame, weights: dict[str, float | Fraction], sizes: dict[str, int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with its columns, a run of blocks in each partition, sorted in the order of the mix.

    Writing the result keeps the order: its files follow each other, and each
    is sorted. Rows of a block follow their offset in it.
    """
    sizes = source_sizes(docs) if sizes is None else sizes
    mixed, blocks = _placed(docs, weights, sizes, block_bytes)
    partitions = shuffle_partitions(docs.sparkSession)
    share = F.expr(f"cast(_fl_turn * {partitions}L div {max(blocks, 1)}L as int)")
    order = ["_fl_mix_slot", "_fl_mix_offset", "doc_id"]
    sorted_ = mixed.repartitionById(partitions, share).sortWithinPartitions(*order)
    mark = {MARK: {"block": block_size(sum(sizes.values()), block_bytes), "from": _files(docs)}}
    return sorted_.select(*(F.col(f"`{c}`").alias(c, metadata=mark) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns))


def _files(docs: DataFrame) -> int:
    """One number for the files that ``docs`` reads."""
    return zlib.crc32("\n".join(sorted(docs.inputFiles())).encode())


def stored_mix(docs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``docs`` as files in the order of the mix, and the bytes of its blocks; what was not mixed and written before is now.

    in_mixed_order marks its result in the metadata of doc_id, which Parquet
    keeps, with the files that it was made of: who still reads these has not
    read what was written.
    """
    mark = docs.schema["doc_id"].metadata.get(MARK)
    if mark and mark["from"] != _files(docs):
        return docs, mark["block"]
    if not mark:
        sizes = source_sizes(docs)
        docs = in_mixed_order(docs, root_weights(sizes), sizes)
    return stored(docs, name), docs.schema["doc_id"].metadata[MARK]["block"]


def stored_slots(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` of stored_mix with mix_file and mix_row, their place in the stored order, and (mix_file, mix_row, mix_slot).

    A block of a source holds ``block`` of its bytes in the stored order, and
    blocks are numbered without gaps by their first rows. Each step is stored,
    narrow as it is, since the next ones read it more than once: the texts are
    read once for their sizes, and no plan holds all the steps several times.
    """
    named = docs.select("*", F.col("_metadata.file_name").alias("_fl_name"), F.col("_metadata.row_index").alias("mix_row"))
    files = stored(named.select("_fl_name").distinct().select("_fl_name", (F.row_number().over(Window.orderBy("_fl_name")) - 1).cast("long").alias("mix_file")), "mix_files")
    read = named.join(F.broadcast(files), "_fl_name").drop("_fl_name")
    light = stored(read.select("mix_file", "mix_row", F.coalesce("source", F.lit(NO_SOURCE)).alias("_s"), _size().alias("_bytes"), F.expr(f"mix_row div {SPAN_ROWS}").alias("_span")), "mix_sizes")
    spans_before = Window.partitionBy("_s").orderBy("mix_file", "_span").rowsBetween(Window.unboundedPreceding, -1)
    bases = light.groupBy("_s", "mix_file", "_span").agg(F.sum("_bytes").alias("_sum")).select("_s", "mix_file", "_span", F.coalesce(F.sum("_sum").over(spans_before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_s", "mix_file", "_span").orderBy("mix_row").rowsBetween(Window.unboundedPreceding, -1)
    at = light.withColumn("_before", F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).join(bases, ["_s", "mix_file", "_span"])
    placed = stored(at.select("mix_file", "mix_row", "_s", F.expr(f"(_base + _before) div {block}").alias("_block")), "mix_places")
    firsts = stored(placed.groupBy("_s", "_block").agg(F.min(F.struct("mix_file", "mix_row")).alias("_first")), "mix_firsts")
    in_file = firsts.withColumn("_k", F.row_number().over(Window.partitionBy("_first.mix_file").orderBy("_first.mix_row")) - 1)
    before = Window.orderBy("mix_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = firsts.groupBy(F.col("_first.mix_file").alias("mix_file")).agg(F.count(F.lit(1)).alias("_n")).select(F.col("mix_file").alias("_file"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_slots"))
    slots = stored(in_file.join(counts, F.col("_first.mix_file") == F.col("_file")).select("_s", "_block", (F.col("_slots") + F.col("_k")).cast("long").alias("mix_slot")), "mix_slots")
    discard(light, firsts)
    return read, placed.join(slots, ["_s", "_block"]).select("mix_file", "mix_row", "mix_slot")

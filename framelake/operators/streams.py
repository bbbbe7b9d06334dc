"""Order-dependent rules of coded streams as windows over one stream at a time.

Rows whose stream columns are null are one stream for the windows; the rules
that read a stream in one task (``cache_hits``, ``reorder_bounded``,
``retain_spaced``) and ``retain_rising`` take none. The order columns give
every row of a stream its own place, nulls first; rows of equal places come in
any order. Repeated rows are rows of their own, null values differ from all
others unless a rule says otherwise, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.asof import as_of
from framelake.storage import written


def _ordered(stream: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*stream).orderBy(*order)


def format_changes(rows: DataFrame, stream: list[str], order: list[str], parts: list[str]) -> DataFrame:
    """``rows`` with changed: whether any of ``parts`` differs from the row before, nulls being equal; true for the first."""
    w = _ordered(stream, order)
    first = F.row_number().over(w) == 1
    differs = F.lit(False)
    for p in parts:
        differs = differs | ~F.col(p).eqNullSafe(F.lag(p).over(w))
    return rows.withColumn("changed", first | differs)


def number_groups(rows: DataFrame, stream: list[str], order: list[str], starts: Column, name: str = "group_id") -> DataFrame:
    """``rows`` with a running count of ``starts``: pictures of access units, epochs between instant refreshes or gaps."""
    w = _ordered(stream, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(starts.cast("long")).over(w))


def access_units(slices: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """``slices`` with new_picture and picture_id.

    Columns: frame_num, pps_id, sps_id, is_field, is_bottom, ref_idc, is_idr,
    idr_pic_id, poc_lsb, delta_bottom, after_mark (a delimiter or end stands
    between it and the slice before). A picture begins where one of them differs:
    ref_idc counts as zero or not, is_bottom only between fields, idr_pic_id only
    between instant refreshes.
    """
    w = _ordered(stream, order)
    old = lambda c: F.lag(c).over(w)
    differs = F.row_number().over(w) == 1
    for c in ("frame_num", "pps_id", "sps_id", "is_field", "is_idr", "poc_lsb", "delta_bottom"):
        differs = differs | ~F.col(c).eqNullSafe(old(c))
    differs = differs | ((F.col("ref_idc") == 0) != (old("ref_idc") == 0))
    differs = differs | (F.col("is_field") & old("is_field") & (F.col("is_bottom") != old("is_bottom")))
    differs = differs | (F.col("is_idr") & old("is_idr") & (F.col("idr_pic_id") != old("idr_pic_id")))
    fresh = F.coalesce(differs, F.lit(False)) | F.col("after_mark")
    return number_groups(slices.withColumn("new_picture", fresh), stream, order, F.col("new_picture"), "picture_id")


def unwrap(rows: DataFrame, stream: list[str], order: list[str], value: str, modulus: int) -> DataFrame:
    """``rows`` with unwrapped: a counter modulo ``modulus`` made whole, a step of half or more counting as a turn.

    Falling by at least half is a turn upwards, rising by more than half one
    downwards.
    """
    w = _ordered(stream, order)
    step = F.col(value) - F.lag(value).over(w)
    half = modulus // 2
    turn = F.when(-step >= half, 1).when(step > half, -1).otherwise(0)
    turned = rows.withColumn("_turn", turn)
    return turned.withColumn("unwrapped", (F.col(value) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)) * modulus).cast("long")).drop("_turn")


def last_writers(rows: DataFrame, stream: list[str], order: list[str], index: str, mask: str, slots: int = 8) -> DataFrame:
    """``rows`` with slot0.. : the index of the last earlier row whose mask has that bit."""
    w = _ordered(stream, order).rowsBetween(Window.unboundedPreceding, -1)
    hit = lambda k: F.when(F.shiftright(F.col(mask), k).bitwiseAND(1) == 1, F.col(index))
    return rows.withColumns({f"slot{k}": F.last(hit(k), ignorenulls=True).over(w) for k in range(slots)})


def pack_spans(samples: DataFrame, cursor: list[str], order: list[str], start: str, end: str, budget: int) -> DataFrame:
    """The leading ``samples`` of each cursor whose joint span stays within ``budget``; the first is always in, a budget of 0 takes none."""
    w = _ordered(cursor, order).rowsBetween(Window.unboundedPreceding, 0)
    span = F.max(end).over(w) - F.min(start).over(w)
    kept = samples.withColumn("_n", F.row_number().over(_ordered(cursor, order))).withColumn("span", span.cast("long"))
    return kept.where((F.lit(budget) > 0) & ((F.col("_n") == 1) | (F.col("span") <= budget))).drop("_n")


def is_monotonic(rows: DataFrame, stream: list[str], order: list[str], value: str) -> DataFrame:
    """Per stream whether ``value`` never falls."""
    kept = rows.withColumn("_ok", F.coalesce(F.col(value) >= F.lag(value).over(_ordered(stream, order)), F.lit(True)))
    return kept.groupBy(*stream).agg(F.bool_and("_ok").alias("monotonic"))


def service_until_output(rows: DataFrame, stream: list[str], order: list[str], is_output: str, duration: str) -> DataFrame:
    """(stream, frame, service): what was spent since the output before, for each output in turn; what follows the last is left out."""
    before = _ordered(stream, order).rowsBetween(Window.unboundedPreceding, -1)
    framed = rows.withColumn("frame", F.coalesce(F.sum(F.col(is_output).cast("long")).over(before), F.lit(0)))
    return framed.groupBy(*stream, "frame").agg(F.sum(duration).alias("service"), F.bool_or(is_output).alias("_out")).where("_out").drop("_out")


def cache_hits(accesses: DataFrame, cache: list[str], order: list[str], block: str, capacity: int) -> DataFrame:
    """``accesses`` with hit: whether a least-recently-used cache of ``capacity`` blocks still holds the block.

    The accesses of a cache are read in order by one task, which holds its
    blocks; other columns stay.
    """
    keyed = accesses.repartition(*cache).sortWithinPartitions(*cache, *order)

    def per_cache(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, {}
        for frame in frames:
            hits = []
            for *own, b in frame[[*cache, block]].itertuples(index=False):
                if own != key:
                    key, held = own, {}
                hits.append(b in held)
                held.pop(b, None)
                held[b] = None
                if len(held) > capacity:
                    del held[next(iter(held))]
            yield frame.assign(hit=hits)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in accesses.schema.fields)
    return keyed.mapInPandas(per_cache, f"{fields}, hit boolean")


def reorder_bounded(rows: DataFrame, stream: list[str], order: list[str], value: str, depth: int) -> DataFrame:
    """``rows`` with output_index: the place in which a buffer of ``depth`` releases them, least ``value`` first.

    A row enters in decode order; when more than ``depth`` wait, the one of
    least (value, decode order) leaves; at the end the rest leave in that order.
    The buffer of a stream is all that a task holds.
    """
    from heapq import heappop, heappush

    ranked = rows.withColumn("_at", F.row_number().over(_ordered(stream, order)))
    keyed = ranked.repartition(*stream).sortWithinPartitions(*stream, "_at")
    names = [*stream, "_at", value]

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, released = None, [], 0

        def leave(out: list) -> None:
            nonlocal released
            _, at = heappop(waiting)
            out.append((*key, at, released))
            released += 1

        for frame in frames:
            out: list = []
            for *own, at, v in frame[names].itertuples(index=False):
                if own != key:
                    while waiting:
                        leave(out)
                    key, released = own, 0
                heappush(waiting, (v, at))
                if len(waiting) > depth:
                    leave(out)
            yield pd.DataFrame(out, columns=[*stream, "_at", "output_index"])
        out = []
        while waiting:
            leave(out)
        yield pd.DataFrame(out, columns=[*stream, "_at", "output_index"])

    types = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    places = keyed.select(*names).mapInPandas(play, ", ".join([*(f"`{s}` {types[s]}" for s in stream), "_at int, output_index long"]))
    return ranked.join(places, [*stream, "_at"]).drop("_at")


def drained_order(rows: DataFrame, stream: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with output_index: the place in which a buffer as deep as the stream releases them, by ``value``, then decode order."""
    w = Window.partitionBy(*stream).orderBy(value, *order)
    return rows.withColumn("output_index", (F.row_number().over(w) - 1).cast("long"))


def retain_spaced(rows: DataFrame, stream: list[str], order: list[str], index: str, spacing: int) -> DataFrame:
    """``rows`` with retained: whether ``index`` lies ``spacing`` or more from the last retained one. The first is retained.

    For streams whose index may jump back, as a cursor's does; one task reads a
    stream in order. Where it only rises, ``retain_rising`` needs no such task.
    """
    keyed = rows.repartition(*stream).sortWithinPartitions(*stream, *order)

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for frame in frames:
            kept = []
            for *own, at in frame[[*stream, index]].itertuples(index=False):
                if own != key:
                    key, last = own, None
                keep = last is None or abs(at - last) >= spacing
                last = at if keep else last
                kept.append(keep)
            yield frame.assign(retained=kept)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return keyed.mapInPandas(play, f"{fields}, retained boolean")


def retain_rising(rows: DataFrame, stream: list[str], index: str, spacing: int, bucket: int | None = None) -> DataFrame:
    """``rows`` with retained: whether ``index`` lies ``spacing`` or more behind the last retained one. The first is retained.

    ``index`` is the order of the rows, a whole number that a stream has once;
    rows of a null index are not retained. Whether a row is retained depends on
    what was retained before it, but the row that follows a retained one does
    not: it is the first of at least ``index + spacing``, found for all rows at
    once as of that index. These jumps are doubled (two, four, eight rows on)
    until none stays within its stream, and then the longest jumps mark first:
    what k jumps of a length reach from marked rows is marked. So a stream is
    never read from its beginning in one task; the rounds are twice the binary
    digits of the number of retained rows. ``bucket`` splits the lookup of one
    stream by spans of ``index``.
    """
    known = rows.where(F.col(index).isNotNull()).select(*stream, F.col(index).cast("long").alias("_i")).distinct()
    asked = known.withColumn("_want", F.col("_i") + spacing)
    others = known.select(*stream, F.col("_i").alias("_at"))
    step = as_of(asked, others, stream, "_want", "_at", "_at", forward=True, bucket=bucket, prefix="_next").where("_next_index IS NOT NULL")
    jumps = [written(step.select(*stream, "_i", F.col("_next_index").alias("_to")))]
    marked = written(known.groupBy(*stream).agg(F.min("_i").alias("_i")))
    # A jump that no first row can make is too long for every row of its stream that counts.
    while not jumps[-1].join(marked, [*stream, "_i"], "left_semi").isEmpty():
        onward = jumps[-1].select(*stream, F.col("_i").alias("_to"), F.col("_to").alias("_further"))
        jumps.append(written(jumps[-1].join(onward, [*stream, "_to"]).select(*stream, "_i", F.col("_further").alias("_to"))))
    for jump in reversed(jumps[:-1]):
        reached = marked.join(jump, [*stream, "_i"]).select(*stream, F.col("_to").alias("_i"))
        marked = written(marked.unionByName(reached))
    kept = marked.select(*stream, F.col("_i").alias(index), F.lit(True).alias("_kept"))
    return rows.join(kept, [*stream, index], "left").withColumn("retained", F.coalesce("_kept", F.lit(False))).drop("_kept")

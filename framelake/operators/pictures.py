"""Picture order, reference lists and parameter sets at the level of headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.asof import as_of


def _epochs(rows: DataFrame, stream: list[str], order: list[str], begins: Column | None) -> DataFrame:
    """``rows`` with _epoch: how many rows that begin one have come, each of them included."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_epoch", F.lit(0) if begins is None else F.count_if(F.coalesce(begins, F.lit(False))).over(w))


def whole_frame_numbers(rows: DataFrame, stream: list[str], order: list[str], frame_num: str, modulus: int, is_idr: str | None = None) -> DataFrame:
    """``rows`` with abs_frame_num: frame_num plus a turn for each time it has fallen; each row with ``is_idr`` begins anew."""
    rows = _epochs(rows, stream, order, F.col(is_idr) if is_idr else None)
    w = Window.partitionBy(*stream, "_epoch").orderBy(*order)
    turned = rows.withColumn("_turn", F.coalesce((F.lag(frame_num).over(w) > F.col(frame_num)).cast("long"), F.lit(0)))
    turns = F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return turned.withColumn("abs_frame_num", (turns * modulus + F.col(frame_num)).cast("long")).drop("_turn", "_epoch")


def order_counts_by_lsb(rows: DataFrame, stream: list[str], order: list[str], lsb: str, modulus: int, is_reference: str, is_idr: str, resets: str, delta_bottom: str, is_field: str, is_bottom: str) -> DataFrame:
    """``rows`` with top and bottom picture order counts from their low bits (type 0).

    A row is compared with the reference before it: falling by at least half
    of ``modulus`` is a turn upwards, rising by more than half one downwards.
    An IDR picture is compared with 0, and so is the first row of a stream. A
    reference that ``resets`` (memory operation 5) stands at its own counts
    less the lesser of them, and what follows is compared with its top; a
    bottom field stands at 0. A field has one of the two counts, the other is
    null.
    """
    w = Window.partitionBy(*stream).orderBy(*order)
    reset = F.col(resets) & F.col(is_reference)
    after = F.coalesce(F.lag(reset).over(w), F.lit(False))
    start = F.when(after & ~F.col(is_idr), F.greatest(F.lit(0), F.when(F.lag(is_field).over(w), F.lit(0)).otherwise(-F.lag(delta_bottom).over(w)))).otherwise(F.lit(0))
    rows = rows.withColumns({"_begins": after | F.col(is_idr), "_start": start})
    rows = _epochs(rows, stream, order, F.col("_begins"))
    inside = Window.partitionBy(*stream, "_epoch").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col(is_reference), F.col(lsb)), ignorenulls=True).over(earlier), F.first("_start").over(inside))
    half = modulus // 2
    rows = rows.withColumn("_before", before)
    rows = rows.withColumn("_turn", F.when(F.col("_before") - F.col(lsb) >= half, 1).when(F.col(lsb) - F.col("_before") > half, -1).otherwise(0))
    turns = F.coalesce(F.sum(F.when(F.col(is_reference), F.col("_turn"))).over(earlier), F.lit(0)) + F.col("_turn")
    value = (turns * modulus + F.col(lsb)).cast("long")
    top = F.when(~(F.col(is_field) & F.col(is_bottom)), value)
    bottom = F.when(~F.col(is_field), value + F.col(delta_bottom)).when(F.col(is_bottom), value).cast("long")
    return rows.withColumns({"top": top, "bottom": bottom}).drop("_begins", "_start", "_epoch", "_before", "_turn")


def order_count_by_cycle(abs_frame_num: Column, is_reference: Column, is_idr: Column, offsets: list[int], non_reference_offset: int, delta: Column) -> Column:
    """Picture order count from a cycle of reference offsets (type 1)."""
    n = len(offsets)
    sums = [sum(offsets[: k + 1]) for k in range(n)]
    within = F.when(is_idr | F.lit(n == 0), F.lit(0)).otherwise(abs_frame_num)
    within = F.when(~is_reference & (within > 0), within - 1).otherwise(within).cast("long")
    if n:
        table = F.array(*(F.lit(s).cast("long") for s in sums))
        cycle = F.call_function("div", within - 1, F.lit(n).cast("long"))
        part = F.try_element_at(table, (F.pmod(within - 1, F.lit(n)) + 1).cast("int"))
        expected = F.when(within > 0, cycle * F.lit(sums[-1]) + part).otherwise(F.lit(0))
    else:
        expected = F.lit(0)
    return (expected + F.when(~is_reference, F.lit(non_reference_offset)).otherwise(F.lit(0)) + delta).cast("long")


def order_count_by_frame(abs_frame_num: Column, is_reference: Column, is_idr: Column) -> Column:
    """Picture order count in decode order (type 2)."""
    return F.when(is_idr, F.lit(0)).otherwise(2 * abs_frame_num - F.when(is_reference, F.lit(0)).otherwise(F.lit(1))).cast("long")


def retained_references(rows: DataFrame, stream: list[str], order: list[str], index: str, is_reference: str, most: int, is_idr: str | None = None) -> DataFrame:
    """``rows`` with references: the ``most`` latest earlier reference rows of the stream, latest first.

    A row with ``is_idr`` clears them. Frame numbers rise from reference to
    reference and turn over, so the least by wrapped number is the oldest; the
    rule holds as long as no reference is kept over a whole turn.
    """
    rows = _epochs(rows, stream, order, F.col(is_idr) if is_idr else None)
    stream = [*stream, "_epoch"]
    w = Window.partitionBy(*stream).orderBy(*order)
    numbered = rows.withColumn("_n", F.sum(F.col(is_reference).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Among the references alone the frame has a fixed number of rows.
    refs = numbered.where(is_reference).withColumn("_held", F.reverse(F.collect_list(index).over(w.rowsBetween(-(most - 1), 0)))).select(*stream, F.col("_n").alias("_last"), "_held")
    before = numbered.withColumn("_last", F.col("_n") - F.col(is_reference).cast("long"))
    joined = before.join(refs, [*stream, "_last"], "left")
    return joined.withColumn("references", F.coalesce("_held", F.array().cast("array<bigint>"))).drop("_n", "_last", "_held", "_epoch")


#: Entries of a reference buffer as the list functions take them.
REFERENCE = "array<struct<id:bigint, frame_num:bigint, poc:bigint, long_index:int>>"


def _ids(entries: Column) -> Column:
    return F.transform(entries, lambda x: x["id"])


def _sorted_by(entries: Column, key) -> Column:
    """Entries in ascending order of a number."""
    keyed = F.transform(entries, lambda x: F.struct(key(x).cast("long").alias("k"), x["id"].alias("id")))
    return _ids(F.array_sort(keyed))


def p_list(references: Column, frame_num: Column, modulus: int) -> Column:
    """Ids of list 0 of a P picture: short-term by falling wrapped number, then long-term by index."""
    short = F.filter(references, lambda x: x["long_index"].isNull())
    long = F.filter(references, lambda x: x["long_index"].isNotNull())
    wrapped = lambda x: -F.when(x["frame_num"] > frame_num, x["frame_num"] - modulus).otherwise(x["frame_num"])
    return F.concat(_sorted_by(short, wrapped), _sorted_by(long, lambda x: x["long_index"]))


def b_lists(references: Column, poc: Column) -> Column:
    """struct(list0, list1) of a B picture: earlier by falling count, later by rising count, long-term; list 1 later first.

    If both are equal and have more than one entry, the first two of list 1 change places.
    """
    short = lambda p: F.filter(references, lambda x: x["long_index"].isNull() & p(x))
    earlier = _sorted_by(short(lambda x: x["poc"] <= poc), lambda x: -x["poc"])
    later = _sorted_by(short(lambda x: x["poc"] > poc), lambda x: x["poc"])
    long = _sorted_by(F.filter(references, lambda x: x["long_index"].isNotNull()), lambda x: x["long_index"])
    one, two = F.concat(earlier, later, long), F.concat(later, earlier, long)
    swapped = F.concat(F.slice(two, 2, 1), F.slice(two, 1, 1), F.slice(two, 3, F.greatest(F.size(two) - 2, F.lit(0))))
    return F.struct(one.alias("list0"), F.when((one == two) & (F.size(two) > 1), swapped).otherwise(two).alias("list1"))


def _first(entries: Column) -> Column:
    return F.try_element_at(entries, F.lit(1))


def short_term_by_number(references: Column, frame_num: Column, modulus: int, number: Column) -> Column:
    """The entry that a modification names: the first short-term one of that picture number, else null.

    A number over the current ``frame_num`` stands for one of the turn before.
    """
    turned = lambda x: F.when(x > frame_num, x - modulus).otherwise(x)
    return _first(F.filter(references, lambda x: x["long_index"].isNull() & (turned(x["frame_num"]) == turned(number))))


def long_term_by_index(references: Column, index: Column) -> Column:
    """The first long-term entry of that index, else null."""
    return _first(F.filter(references, lambda x: x["long_index"] == index))


def entries_of_list(ids: Column, references: Column) -> Column:
    """The buffer's entry for each id of an active list; null for a null id and for one that the buffer does not hold."""
    return F.transform(ids, lambda i: _first(F.filter(references, lambda x: x["id"] == i)))


def active_list(initial: Column, count: Column, moves: Column) -> Column:
    """The first ``count`` entries, padded with nulls, after each of ``moves`` (ids) is put at the next place and taken out behind it."""
    size = F.greatest(count, F.lit(1))
    start = F.slice(F.concat(initial, F.array_repeat(F.lit(None).cast("bigint"), 32)), 1, size)
    begin = F.struct(start.alias("list"), F.lit(0).alias("at"))

    def move(state: Column, id_: Column) -> Column:
        head = F.slice(state["list"], 1, state["at"])
        tail = F.filter(F.slice(state["list"], state["at"] + 1, 64), lambda x: x.isNull() | (x != id_))
        return F.struct(F.slice(F.concat(head, F.array(id_), tail), 1, size).alias("list"), (state["at"] + 1).alias("at"))

    return F.aggregate(moves, begin, move, lambda state: state["list"])


def reorder_depth(declared: Column, profile: Column, references: Column) -> Column:
    """Pictures that may wait: as declared, else none in the baseline profile and as many as references in others."""
    return F.coalesce(declared, F.when(profile == 66, F.lit(0)).otherwise(references))


def bind_parameter_sets(slices: DataFrame, pictures: DataFrame, sequences: DataFrame, stream: list[str]) -> DataFrame:
    """Slices (stream, at, pps_id) with the place of their picture set and of the sequence set bound to it.

    A slice takes the last picture set of its id before it; that one stays bound
    to the sequence set of its id that stood when it was read. pictures: stream,
    at, pps_id, sps_id; sequences: stream, at, sps_id. Places are null where a
    set is missing.
    """
    keyed = sequences.select(*stream, "sps_id", F.col("at").alias("_sps_at"))
    bound = as_of(pictures, keyed, [*stream, "sps_id"], "at", "_sps_at", "_sps_at", strict=True, prefix="sps")
    sets = bound.select(*stream, "pps_id", F.col("at").alias("_pps_at"), F.col("sps_index").alias("sps_at"))
    found = as_of(slices, sets, [*stream, "pps_id"], "at", "_pps_at", "_pps_at", strict=True, prefix="pps").drop("pps_index").withColumnRenamed("pps_time", "pps_at")
    return found.join(sets.withColumnRenamed("_pps_at", "pps_at"), [*stream, "pps_id", "pps_at"], "left")

"""As-of lookups: the row of the right side at, before, after or nearest to a time of the left side.

Null ``by`` columns are one key, but a key that is cut into spans (``bucket``,
``seconds``) is not null. Every row of the left side comes back once,
repeated ones each; an empty right side gives nulls, an empty left side no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, right_index: str, *, forward: bool = False, strict: bool = False, greatest_index: bool = False, bucket: int | None = None, prefix: str = "found") -> DataFrame:
    """``left`` with {prefix}_time and {prefix}_index: of the right row of the greatest time at or before its own.

    ``forward`` looks for the least time at or after it, ``strict`` leaves out
    equal times. Of equal right times the least index is taken, or with
    ``greatest_index`` the greatest. Times and indices are whole numbers; rows
    of a null time find and are nothing.

    Both sides are merged in order of time and the best row so far is carried
    on, so the cost does not depend on how many rows match. ``bucket`` cuts the
    times of a key into spans that are worked on apart, with the best row of
    the spans before carried in; use it where one key holds much of the data.
    """
    sign = -1 if forward else 1
    best = F.struct((F.col(right_time) * F.lit(sign)).alias("t"), (F.col(right_index) * F.lit(1 if greatest_index else -1)).alias("i"))
    kind = "struct<t:bigint,i:bigint>"
    own = left.select(*by, (F.col(left_time) * F.lit(sign)).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(kind).alias("_best"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    other = right.where(F.col(right_time).isNotNull()).select(*by, (F.col(right_time) * F.lit(sign)).alias("_t"), F.lit(1 if strict else 0).alias("_side"), best.cast(kind).alias("_best"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    merged = own.unionByName(other)
    span = [*by]
    if bucket:
        merged = merged.withColumn("_span", F.coalesce(F.floor(F.col("_t") / F.lit(bucket)), F.lit(-(1 << 62))))
        span.append("_span")
    running = Window.partitionBy(*span).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.max("_best").over(running)
    carried = merged.withColumn("_found", found)
    if bucket:
        before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        spans = merged.groupBy(*span).agg(F.max("_best").alias("_own")).select(*span, F.max("_own").over(before).alias("_earlier"))
        carried = carried.join(spans, span, "left").withColumn("_found", F.coalesce("_found", "_earlier"))
    hit = F.col("_t").isNotNull()
    return carried.where("_row is not null").select(
        "_row.*", F.when(hit, F.col("_found.t") * F.lit(sign)).alias(f"{prefix}_time"), F.when(hit, F.col("_found.i") * F.lit(1 if greatest_index else -1)).alias(f"{prefix}_index")
    )


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, right_index: str, bucket: int | None = None) -> DataFrame:
    """``left`` with nearest_time and nearest_index; of two equally near times the earlier, of equal times the least index."""
    back = as_of(left, right, by, left_time, right_time, right_index, strict=True, bucket=bucket, prefix="_before")
    both = as_of(back, right, by, left_time, right_time, right_index, forward=True, bucket=bucket, prefix="_after")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    earlier: Column = F.col("_after_time").isNull() | (wide(left_time) - wide("_before_time") <= wide("_after_time") - wide(left_time))
    take = F.col("_before_time").isNotNull() & earlier
    return both.withColumn("nearest_time", F.when(take, F.col("_before_time")).otherwise(F.col("_after_time"))).withColumn("nearest_index", F.when(take, F.col("_before_index")).otherwise(F.col("_after_index"))).drop("_before_time", "_before_index", "_after_time", "_after_index")


def prefix_max(rows: DataFrame, by: list[str], time: str, value: str, name: str, bucket: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the greatest ``value`` among the rows of its key whose ``time`` is not later than its own.

    Rows of equal times count for each other; rows of a null time get null and
    count for none; null values count for none. ``bucket`` cuts the times of a
    key into spans that are worked on apart, with the greatest value of the
    spans before carried in.
    """
    span = [*by]
    if bucket:
        rows = rows.withColumn("_span", F.floor(F.col(time) / F.lit(bucket)))
        span.append("_span")
    known = F.when(F.col(time).isNotNull(), F.col(value))
    running = Window.partitionBy(*span).orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(name, F.when(F.col(time).isNotNull(), F.max(known).over(running)))
    if not bucket:
        return found
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy(*span).agg(F.max(known).alias("_most")).select(*span, F.max("_most").over(before).alias("_earlier"))
    return found.join(earlier, span, "left").withColumn(name, F.greatest(name, "_earlier")).drop("_span", "_earlier")


#: Bits of a digit of a fraction; a 32-bit remainder times such a digit fits in 63 bits.
DIGIT_BITS = 31


def order_key(time: Column) -> Column:
    """struct(s, f, g) in the exact order of media times (value, timescale) of whatever timescales: whole seconds, and three binary digits of the rest.

    Two fractions of denominators below 2^32 that differ do so by more than one
    part in 2^64, and the digits have 93 bits: so equal times of different
    timescales have equal keys and different times different ones, and no
    common denominator of all timescales is needed. Null times have null keys.
    """
    value, scale = time["value"].cast("long"), time["timescale"].cast("long")
    rest = F.pmod(value, scale)
    whole = F.call_function("div", value, scale) - F.when((value < 0) & (rest != 0), 1).otherwise(0)
    digits = []
    for _ in range(3):
        shifted = F.shiftleft(rest, DIGIT_BITS)
        digits.append(F.call_function("div", shifted, scale))
        rest = F.pmod(shifted, scale)
    return F.when(time.isNotNull(), F.struct(whole.alias("s"), F.shiftleft(digits[0], DIGIT_BITS).bitwiseOR(digits[1]).alias("f"), digits[2].alias("g")))


#: Type of an order key.
KEY = "struct<s:bigint,f:bigint,g:bigint>"


def as_of_times(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, right_index: str, *, forward: bool = False, strict: bool = False, greatest_index: bool = False, seconds: int | None = None, prefix: str = "found") -> DataFrame:
    """As ``as_of``, over media times struct(value, timescale) of several timescales, compared as exact fractions.

    Gives {prefix}_time, the right row's own time in its own timescale, and
    {prefix}_index. Of equal times the least index is taken, whatever their
    timescales, or with ``greatest_index`` the greatest. ``seconds`` cuts a key
    into spans of so many seconds that are worked on apart.
    """
    sign = 1 if greatest_index != forward else -1
    kind = f"struct<k:{KEY},i:bigint,t:{right.schema[right_time].dataType.simpleString()}>"
    own = left.select(*by, order_key(F.col(left_time)).alias("_k"), F.lit(None).cast(kind).alias("_best"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    named = right.where(F.col(right_time).isNotNull()).select(*by, order_key(F.col(right_time)).alias("_k"), F.col(right_index).alias("_i"), F.col(right_time).alias("_t"))
    best = F.struct(F.col("_k").alias("k"), (F.col("_i") * F.lit(sign)).alias("i"), F.col("_t").alias("t")).cast(kind)
    other = named.select(*by, "_k", best.alias("_best"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    side = F.when(F.col("_row").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    merged = own.unionByName(other).withColumn("_side", side)
    take = F.min if forward else F.max
    span = [*by]
    if seconds:
        merged = merged.withColumn("_span", F.coalesce(F.floor(F.col("_k.s") / F.lit(seconds)), F.lit(-(1 << 62))))
        span.append("_span")
    turn = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    running = Window.partitionBy(*span).orderBy(turn("_k"), F.col("_side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.withColumn("_found", take("_best").over(running))
    if seconds:
        before = Window.partitionBy(*by).orderBy(turn("_span")).rowsBetween(Window.unboundedPreceding, -1)
        spans = merged.groupBy(*span).agg(take("_best").alias("_own")).select(*span, take("_own").over(before).alias("_earlier"))
        carried = carried.join(spans, span, "left").withColumn("_found", F.coalesce("_found", "_earlier"))
    hit = F.col("_k").isNotNull()
    return carried.where("_row is not null").select("_row.*", F.when(hit, F.col("_found.t")).alias(f"{prefix}_time"), F.when(hit, F.col("_found.i") * F.lit(sign)).alias(f"{prefix}_index"))


def nearest_times(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, right_index: str, seconds: int | None = None) -> DataFrame:
    """``left`` with nearest_time and nearest_index over media times of several timescales; of two equally near times the earlier, of equal times the least index."""
    back = as_of_times(left, right, by, left_time, right_time, right_index, strict=True, seconds=seconds, prefix="_before")
    both = as_of_times(back, right, by, left_time, right_time, right_index, forward=True, seconds=seconds, prefix="_after")
    # 2t <= a + b, in whole seconds and remainders, so that no product passes 38 digits.
    scale = lambda c: F.col(f"{c}.timescale").cast("decimal(10,0)")
    rest = lambda c: F.pmod(F.col(f"{c}.value").cast("decimal(20,0)"), scale(c)).cast("decimal(10,0)")
    whole = lambda c: order_key(F.col(c))["s"].cast("decimal(20,0)")
    t, a, b = left_time, "_before_time", "_after_time"
    ahead = (2 * whole(t) - whole(a) - whole(b)).cast("decimal(24,0)")
    near = F.greatest(F.least(ahead, F.lit(2).cast("decimal(24,0)")), F.lit(-2).cast("decimal(24,0)")).cast("decimal(1,0)")
    ours = (near * scale(t) + 2 * rest(t)).cast("decimal(12,0)") * scale(a) * scale(b)
    theirs = (rest(a) * scale(b) + rest(b) * scale(a)).cast("decimal(22,0)") * scale(t)
    earlier = F.col(b).isNull() | F.when(ahead >= 2, False).when(ahead <= -2, True).otherwise(ours <= theirs)
    take = F.col(a).isNotNull() & earlier
    return both.withColumn("nearest_time", F.when(take, F.col(a)).otherwise(F.col(b))).withColumn("nearest_index", F.when(take, F.col("_before_index")).otherwise(F.col("_after_index"))).drop("_before_time", "_before_index", "_after_time", "_after_index")

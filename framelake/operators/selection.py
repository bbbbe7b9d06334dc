"""Values of wanted ranks, found by counting ranges instead of sorting or gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.storage import written

#: Ranges that a range is cut into in a round: 64-bit values need at most seven rounds.
CUTS = 1024

#: Groups times ranges of fixed width that are sent to all tasks; more are joined by a shuffle.
BROADCAST_RANGES = 100_000


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def values_at_ranks(rows: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """``ranks`` (by, name, rank) with found: the value at that place, from 1, of the values of the group in ascending order.

    ``by`` names at least one column. Values are whole numbers; null values do not count. Null where the group
    has no such place; groups may be null. In each round the range that a
    rank may lie in is cut, the rows in each cut are counted (added up on
    each task before anything moves) and the cut that holds the rank becomes
    the range, until it is one value. So neither one group nor one value
    needs a task of its own, and a round moves counts only.
    """
    # Nulls of the group columns are equal to each other here.
    keys = [f"_k{j}" for j in range(len(by))]
    own = rows.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("long").alias("_v"))
    ends = own.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    named = ranks.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), "name", F.col("rank").cast("long").alias("rank"))
    start = named.alias("r").join(ends.alias("e"), [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys], "left")
    inside = F.col("rank").between(1, F.col("_n"))
    wanted = written(start.select(*(F.col(f"r.{k}") for k in keys), "name", "rank", F.when(inside, F.col("rank")).alias("_left"), F.when(inside, F.col("_low")).alias("_low"), F.when(inside, F.col("_high")).alias("_high")))
    while True:
        still = wanted.where("_low < _high").select(*keys, "_low", "_high").distinct()
        n = still.count()
        if n == 0:
            break
        # The difference may pass 64 bits, a CUTS-th of it does not; a range of two values is cut in steps of one.
        step = F.call_function("div", _wide("_high") - _wide("_low"), F.lit(CUTS)) + 1
        ranges = still.select(*(F.col(k).alias(f"r{k}") for k in keys), F.col("_low").alias("_from"), F.col("_high").alias("_to"), step.alias("_step"))
        ranges = F.broadcast(ranges) if n <= BROADCAST_RANGES else ranges
        here = [own[k].eqNullSafe(F.col(f"r{k}")) for k in keys] + [F.col("_v").between(F.col("_from"), F.col("_to"))]
        cut = F.call_function("div", _wide("_v") - _wide("_from"), F.col("_step").cast("decimal(20,0)")).cast("long")
        counts = own.join(ranges, here).groupBy(*keys, "_from", "_step", cut.alias("_cut")).agg(F.count(F.lit(1)).alias("_count"))
        upto = Window.partitionBy(*keys, "_from").orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
        sums = counts.withColumn("_upto", F.sum("_count").over(upto))
        renamed = sums.select(*(F.col(k).alias(f"s{k}") for k in keys), "_from", "_step", "_cut", "_upto", "_count")
        holds = [wanted[k].eqNullSafe(F.col(f"s{k}")) for k in keys] + [F.col("_low") == F.col("_from"), F.col("_left") > F.col("_upto") - F.col("_count"), F.col("_left") <= F.col("_upto")]
        low = (_wide("_low") + F.col("_cut") * F.col("_step").cast("decimal(20,0)")).cast("long")
        last = (_wide("_low") + (F.col("_cut") + 1) * F.col("_step").cast("decimal(20,0)") - 1).cast("decimal(38,0)")
        narrowed = wanted.where("_low < _high").join(renamed, holds).select(*keys, "name", "rank", (F.col("_left") - F.col("_upto") + F.col("_count")).alias("_left"), low.alias("_low"), F.least(F.col("_high").cast("decimal(38,0)"), last).cast("long").alias("_high"))
        wanted = written(narrowed.unionByName(wanted.where("_low IS NULL OR _low = _high")))
    return wanted.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "name", "rank", F.col("_low").alias("found"))


def with_percentiles(totals: DataFrame, rows: DataFrame, by: list[str], value: str, count: str, percents: dict[str, int]) -> DataFrame:
    """``totals``, a row for each group with its ``count`` of values, with a column of each name: the value at rank ceil(count * percent / 100)."""
    rank = F.create_map(*(x for name, p in percents.items() for x in (F.lit(name), F.call_function("div", F.col(count) * p + 99, F.lit(100)))))
    ranks = totals.select(*by, F.explode(rank).alias("name", "rank"))
    found = values_at_ranks(rows, by, value, ranks).groupBy(*(F.col(c).alias(f"_f_{c}") for c in by)).pivot("name", list(percents)).agg(F.first("found"))
    return totals.join(found, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in by], "left").drop(*(f"_f_{c}" for c in by))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median) of whole numbers: the middle value, or the mean of the two middle ones; null where a group has none."""
    sizes = rows.groupBy(*by).agg(F.count(value).alias("_n"))
    places = F.create_map(F.lit("lower"), F.expr("(_n + 1) div 2"), F.lit("upper"), F.expr("_n div 2 + 1"))
    found = values_at_ranks(rows, by, value, sizes.select(*by, F.explode(places).alias("name", "rank")))
    # Without values the two places are 0 and 1, and neither is there.
    mean = (F.min("found").cast("double") + F.max("found").cast("double")) / 2
    return found.groupBy(*by).agg(mean.alias("median"))

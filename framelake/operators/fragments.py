"""Samples of movie fragments: data bases, defaults, places and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the bit of a sample's flags that says it is no sync sample.
NON_SYNC = 0x10000


def data_base(explicit: Column, base_is_moof: Column, moof_offset: Column) -> Column:
    """struct(base, error): the place that a fragment's data offsets count from; an explicit one and the flag exclude each other."""
    error = F.when(explicit.isNotNull() & base_is_moof, "invalid: two data bases").when(explicit.isNull() & ~base_is_moof, "unsupported: no data base")
    return F.struct(F.when(error.isNull(), F.coalesce(explicit, moof_offset)).cast("long").alias("base"), error.alias("error"))


def track_defaults(extends: DataFrame, track: list[str]) -> DataFrame:
    """``extends`` (track, description, duration, size, flags) with one row a track and an error where there are more, or no description."""
    per = extends.groupBy(*track).agg(F.count(F.lit(1)).alias("_n"), *(F.min(c).alias(c) for c in ("description", "duration", "size", "flags")))
    error = F.when(F.col("_n") > 1, "invalid: duplicate track").when(F.col("description") == 0, "invalid: no description")
    return per.withColumn("error", error).drop("_n")


def fragment_samples(samples: DataFrame, runs: DataFrame, defaults: DataFrame, fragment: list[str], track: list[str]) -> DataFrame:
    """Samples (fragment, track, run, k, duration, size, flags) with their place, sync mark and error.

    What a sample leaves null is that of its track in ``defaults``. ``runs``
    (fragment, run, base, data_offset) starts at its base and offset; without
    an offset it goes on where the run before it in the fragment ended, and
    the first must have one. A sample without a size or duration is an error
    and counts no bytes; its place is null, as that of all behind it in the
    fragment is not known.
    """
    known = defaults.select(*track, *(F.col(c).alias(f"_{c}") for c in ("duration", "size", "flags")))
    filled = samples.join(known, track, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in ("duration", "size", "flags")})
    opens = F.row_number().over(Window.partitionBy(*fragment, "run").orderBy("k")) == 1
    placed = placed_samples(filled.join(runs, [*fragment, "run"]).withColumn("opens", opens), fragment)
    return placed.select(*fragment, *track, "run", "k", "offset", "size", "duration", "sync", "error")


def placed_samples(rows: DataFrame, fragment: list[str]) -> DataFrame:
    """``rows`` (fragment, run, k, opens, base, data_offset, duration, size, flags) with offset, sync and error as in ``fragment_samples``; rows without k take no part.

    ``opens`` are the first samples of runs. All windows have the one order of
    a fragment, so the rows are sorted once: a place is the sum of the bytes
    before it from where the last start lies on that sum.
    """
    up_to = Window.partitionBy(*fragment).orderBy("run", "k").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("k").isNotNull() & F.coalesce((F.col("size") <= 0) | (F.col("duration") <= 0), F.lit(True))
    judged = rows.withColumn("_bad", bad).withColumn("_counts", F.when(F.col("_bad"), 0).otherwise(F.coalesce("size", F.lit(0))))
    summed = judged.withColumns({"_lost": F.count_if("_bad").over(up_to) > 0, "_before": F.sum("_counts").over(up_to) - F.col("_counts"), "_starts": F.col("opens") & F.col("data_offset").isNotNull()})
    # A start without a base is one as well, whose places are null.
    marked = summed.withColumn("_from", F.when(F.col("_starts"), F.struct((F.col("base") + F.col("data_offset") - F.col("_before")).alias("at"))))
    held = marked.withColumn("_start", F.last("_from", ignorenulls=True).over(up_to))
    error = (
        F.when(F.col("_start").isNull(), "unsupported: first run has no data offset")
        .when(F.coalesce(F.col("duration") <= 0, F.lit(True)), "invalid: sample has no duration")
        .when(F.coalesce(F.col("size") <= 0, F.lit(True)), "invalid: sample has no size")
        .when(F.col("flags").isNull(), "invalid: sample has no flags")
    )
    sync = F.col("flags").bitwiseAND(NON_SYNC) == 0
    found = held.withColumns({"offset": F.when(~F.col("_lost"), F.col("_start.at") + F.col("_before")).cast("long"), "sync": sync, "error": F.when(F.col("k").isNotNull(), error)})
    return found.drop("opens", "_starts", "_bad", "_counts", "_lost", "_before", "_from", "_start")

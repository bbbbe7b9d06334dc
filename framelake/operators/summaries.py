"""Summaries of streams: service times, counts, merges, caches.

Null group columns are one group, repeated rows count each time, and an empty
table gives an empty one. Sums leave out nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.selection import with_percentiles


def service_summary(rows: DataFrame, by: list[str], duration: str) -> DataFrame:
    """Per group: count, mean (whole, truncated), p50, p95, p99 by nearest rank, and max.

    Null durations do not count; a group of nothing else has a count of 0 and
    nulls. Durations are whole numbers. One pass adds up each group on every
    task; the ranks are found by counting ranges, so no group is gathered.
    """
    totals = rows.groupBy(*by).agg(
        F.count(duration).alias("n"),
        F.call_function("div", F.sum(duration), F.count(duration)).cast("long").alias("mean"),
        F.max(duration).alias("longest"),
    )
    ranked = with_percentiles(totals, rows, by, duration, "n", {"p50": 50, "p95": 95, "p99": 99})
    return ranked.select(*by, "n", "mean", "p50", "p95", "p99", "longest")


def merge_symbol_counts(parts: DataFrame, by: list[str], symbol: str, count: str) -> DataFrame:
    """Counts of symbols added up over tiles: partial sums on each task, then one row per symbol."""
    return parts.groupBy(*by, symbol).agg(F.sum(count).cast("long").alias("n"))


def cache_statistics(accesses: DataFrame, by: list[str], hit: str, size: str) -> DataFrame:
    """Hits, misses, and the bytes that misses fetched."""
    return accesses.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~F.col(hit)).alias("misses"), F.coalesce(F.sum(F.when(~F.col(hit), F.col(size))), F.lit(0)).cast("long").alias("fetched"))


def table_totals(durations: DataFrame, sizes: DataFrame, track: list[str]) -> DataFrame:
    """Per track samples and total (of its runs of time), sized and bytes (of its sizes), and agrees: whether both count the same samples.

    durations (track, count, delta) and sizes (track, size); a track that only
    one of them has counts 0 in the other. Null counts and sizes are no samples.
    """
    times = durations.select(*track, F.col("count").cast("long").alias("samples"), (F.col("count") * F.col("delta")).cast("long").alias("total"), F.lit(0).cast("long").alias("sized"), F.lit(0).cast("long").alias("bytes"))
    held = sizes.select(*track, F.lit(0).cast("long").alias("samples"), F.lit(0).cast("long").alias("total"), F.when(F.col("size").isNotNull(), 1).otherwise(0).cast("long").alias("sized"), F.col("size").cast("long").alias("bytes"))
    sums = times.unionByName(held).groupBy(*track).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("samples", "total", "sized", "bytes")))
    return sums.withColumn("agrees", F.col("samples") == F.col("sized"))


def completed_times(frames: DataFrame, stream: list[str], pts: str) -> DataFrame:
    """Latest time of the completed frames, and whether one has none."""
    return frames.groupBy(*stream).agg(F.max(pts).alias("last_pts"), F.bool_or(F.col(pts).isNull()).alias("some_missing"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once where they may stand once, with how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as an upsert in order leaves it; kept by a partial aggregate, without sorting groups."""
    others = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return last.select(*key, "_last.*")


def append_numbered(table: DataFrame, fragments: DataFrame, track: list[str], index: str) -> DataFrame:
    """Fragment samples behind the table's, numbered on; ``index`` runs from 0 in each."""
    sizes = table.groupBy(*track).agg((F.max(index) + 1).alias("_n"))
    moved = fragments.join(sizes, track, "left").withColumn(index, F.col(index) + F.coalesce("_n", F.lit(0))).drop("_n")
    return table.unionByName(moved)


def with_defaults(samples: DataFrame, fragments: DataFrame, tracks: DataFrame, fragment_key: list[str], track_key: list[str], values: list[str]) -> DataFrame:
    """``samples`` with each of ``values`` from the sample, else its fragment, else its track; null where none has it."""
    near = fragments.select(*fragment_key, *(F.col(v).alias(f"_f_{v}") for v in values))
    far = tracks.select(*track_key, *(F.col(v).alias(f"_t_{v}") for v in values))
    joined = samples.join(near, fragment_key, "left").join(far, track_key, "left")
    filled = {v: F.coalesce(v, f"_f_{v}", f"_t_{v}") for v in values}
    return joined.withColumns(filled).drop(*(f"_{k}_{v}" for v in values for k in "ft"))

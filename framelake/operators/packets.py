"""Packets of tracks: their times, what they refer to in small tables, checks over a whole track.

Tables that are looked up in have a key once; a row whose key is null, or not
there, keeps its columns and gets nulls or the error that its rule names.
Repeated rows are rows of their own. Grouped rules take null keys as one
group; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.streams import last_writers

#: The greatest bigint, at which sums of sizes stop.
MOST = (1 << 63) - 1


def packets(samples: DataFrame, timelines: DataFrame, track: list[str]) -> DataFrame:
    """``samples`` with pts and dts moved by the offset of their track, and its timescale.

    timelines: one row per track with offset and timescale. A track without one
    keeps its times and has no timescale.
    """
    joined = samples.join(timelines.select(*track, F.col("offset").alias("_offset"), "timescale"), track, "left")
    shift = F.coalesce("_offset", F.lit(0))
    return joined.withColumns({"pts": F.col("pts") + shift, "dts": F.col("dts") + shift}).drop("_offset")


def with_description(samples: DataFrame, descriptions: DataFrame, track: list[str], values: list[str]) -> DataFrame:
    """``samples`` with the ``values`` of the description they name, and an error where there is none."""
    known = descriptions.select(*track, "description", *values, F.lit(True).alias("_known"))
    joined = samples.join(known, [*track, "description"], "left")
    return joined.withColumn("error", F.when(F.col("_known").isNull(), "invalid: no such description")).drop("_known")


def track_by_index(requests: DataFrame, tracks: DataFrame, file: list[str], index: str, values: list[str]) -> DataFrame:
    """``requests`` with the ``values`` of the track at the index they ask for, and an error where there is none.

    tracks: the ``file`` columns, track_index from 0 and ``values``. A null index
    is out of range, as is any index of a file without tracks.
    """
    known = tracks.select(*file, F.col("track_index").alias(index), *values, F.lit(True).alias("_known"))
    joined = requests.join(known, [*file, index], "left")
    return joined.withColumn("error", F.when(F.col("_known").isNull(), "invalid: track index is out of range")).drop("_known")


def fragments_of_tracks(fragments: DataFrame, tracks: DataFrame, defaults: DataFrame, values: list[str]) -> DataFrame:
    """``fragments`` (track_id) with their track's defaults as default_<value>, and an error where the track is unknown.

    tracks: track_id and descriptions, a count; fragments of tracks without
    descriptions are left out. Tracks need no defaults.
    """
    found = fragments.join(tracks.select("track_id", F.col("descriptions").alias("_n")), "track_id", "left").where("_n is null or _n > 0")
    named = defaults.select("track_id", *(F.col(v).alias(f"default_{v}") for v in values))
    return found.join(named, "track_id", "left").withColumn("error", F.when(F.col("_n").isNull(), "invalid: unknown track")).drop("_n")


def keeps_description(samples: DataFrame, track: list[str], description: str) -> DataFrame:
    """Per track whether all samples name one description; a null is one too."""
    value = F.struct(F.col(description))
    return samples.groupBy(*track).agg((F.min(value) == F.max(value)).alias("constant"))


def sync_index(samples: DataFrame, track: list[str], time: str, index: str, sync: str) -> DataFrame:
    """The sync samples of each track by time and then index, with their position from 0."""
    order = Window.partitionBy(*track).orderBy(time, index)
    return samples.where(sync).withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def is_shown(show: Column, show_existing: Column) -> Column:
    return F.coalesce(show, F.lit(False)) | F.coalesce(show_existing, F.lit(False))


def visible_bytes(width: Column, height: Column) -> Column:
    """Bytes of a picture's visible part with two chroma planes of half its width and height."""
    half = lambda x: F.call_function("div", x + 1, F.lit(2))
    return (width * height + 2 * half(width) * half(height)).cast("long")


def retained_bytes(held: DataFrame, by: list[str], size: str) -> DataFrame:
    """Bytes that each buffer holds; what is shared counts each time, and the sum stops at the greatest bigint."""
    return held.groupBy(*by).agg(F.least(F.coalesce(F.sum(F.col(size).cast("decimal(38,0)")), F.lit(0)), F.lit(MOST)).cast("long").alias("retained"))


def resolve_references(frames: DataFrame, stream: list[str], order: list[str], index: str, refresh: str, slots: list[str]) -> DataFrame:
    """``frames`` with ref0.. : the frame that stands in each of the named slots before this one, and an error if one is empty."""
    held = [f"slot{k}" for k in range(8)]
    written = last_writers(frames, stream, order, index, refresh)
    table = F.array(*held)
    found = written.withColumns({f"ref{k}": F.try_element_at(table, (F.col(s) + 1).cast("int")) for k, s in enumerate(slots)})
    missing = F.greatest(*(F.col(f"ref{k}").isNull() for k in range(len(slots)))) if len(slots) > 1 else F.col("ref0").isNull()
    return found.withColumn("error", F.when(missing, "invalid: missing reference")).drop(*held)

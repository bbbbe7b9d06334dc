"""Movie, track and media headers of files, with what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.scalars import big_endian, track_kind
from framelake.operators.tracks import of_track, track_numbers
from framelake.sources.mp4 import box_payloads


def _duration_header(payload: Column) -> tuple[Column, Column, Column]:
    """(timescale, duration, error) of a movie or media header; a duration of all ones is unknown and null."""
    version = big_endian(payload, 0, 1)
    scale = F.when(version == 1, big_endian(payload, 20, 4)).otherwise(big_endian(payload, 12, 4))
    long_hex = F.hex(F.substring(payload, 25, 8))
    # A 64-bit duration over the greatest bigint cannot be held; all ones among them are the unknown one.
    long_duration = F.when((F.length(long_hex) == 16) & (long_hex < "8"), F.conv(long_hex, 16, 10).cast("long"))
    short = big_endian(payload, 16, 4)
    duration = F.when(version == 1, long_duration).otherwise(F.when(short < (1 << 32) - 1, short))
    complete = F.length(payload) >= F.when(version == 1, 32).otherwise(20)
    error = (
        F.when(version > 1, "unsupported: version of the header")
        .when(~F.coalesce(complete, F.lit(False)), "invalid: truncated header")
        .when(scale == 0, "invalid: timescale is zero")
        .when((version == 1) & (long_hex >= "8") & (long_hex != "F" * 16), "unsupported: duration over 63 bits")
    )
    return scale, duration, error


def movie_headers(files: DataFrame) -> DataFrame:
    """(path, timescale, duration, error) of the movie header of each file that has one; more than one is an error."""
    found = box_payloads(files, ["mvhd"])
    scale, duration, error = _duration_header(F.col("payload"))
    rows = found.select("path", scale.alias("timescale"), duration.alias("duration"), error.alias("error"))
    one = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in ("timescale", "duration", "error")))
    wrong = F.when(F.col("_n") > 1, "invalid: more than one mvhd box").otherwise(F.col("error"))
    return one.select("path", *(F.when(wrong.isNull(), F.col(c)).alias(c) for c in ("timescale", "duration")), wrong.alias("error"))


def track_header_fields(files: DataFrame) -> DataFrame:
    """(path, track, id, flags, width, height, timescale, duration, handler, kind, error) of the tracks of files.

    Width and height are the display size in 16.16 fixed point. A track without
    a track, media or handler header, with more than one, or with one that
    cannot be read has the error and nulls; of several errors the first in
    that order.
    """
    rows = of_track(box_payloads(files, ["tkhd", "mdhd", "hdlr"]).select("path", "parent", F.col("kind").alias("_box"), "payload"), track_numbers(files))
    grouped = rows.groupBy("path", "track").agg(*(f(F.when(F.col("_box") == kind, F.col("payload"))).alias(f"_{name}{kind}") for kind in ("tkhd", "mdhd", "hdlr") for f, name in ((F.count, "n_"), (F.max, ""))))
    tracks = track_numbers(files).select("path", "track").join(grouped, ["path", "track"], "left")
    head, media, handler = F.col("_tkhd"), F.col("_mdhd"), F.col("_hdlr")
    version = big_endian(head, 0, 1)
    ident = F.when(version == 1, big_endian(head, 20, 4)).otherwise(big_endian(head, 12, 4))
    fixed = F.when(version == 1, 36).otherwise(24)
    scale, duration, media_error = _duration_header(media)
    counts = F.coalesce(*(F.when(F.coalesce(F.col(f"_n_{k}"), F.lit(0)) == 0, f"invalid: track has no {k} box").when(F.col(f"_n_{k}") > 1, f"invalid: more than one {k} box") for k in ("tkhd", "mdhd", "hdlr")))
    error = F.coalesce(
        counts,
        F.when(version > 1, "unsupported: version of the track header").when(F.coalesce(ident, F.lit(-1)) < 0, "invalid: truncated track header").when(ident == 0, "invalid: track id is zero").when(F.length(head) < fixed + 60, "invalid: truncated track header"),
        media_error,
        F.when(F.length(handler) < 12, "invalid: truncated handler"),
    )
    last = lambda back: F.conv(F.hex(F.substring(head, -back, 4)), 16, 10).cast("long")
    name = F.decode(F.substring(handler, 9, 4), "ISO-8859-1")
    values = {"id": ident, "flags": big_endian(head, 1, 3), "width": last(8), "height": last(4), "timescale": scale, "duration": duration, "handler": name, "kind": track_kind(name)}
    judged = tracks.withColumn("error", error)
    return judged.select("path", "track", *(F.when(F.col("error").isNull(), v).alias(k) for k, v in values.items()), "error")

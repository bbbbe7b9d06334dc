"""Raw tables of MP4 tracks out of their boxes, ready for the operators on runs.

``files`` are (path, content), or what ``sources.mp4.parsed`` makes of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.scalars import big_endian, track_kind
from framelake.operators.runs import fuse_sample_tables, merged
from framelake.sources.mp4 import box_payloads, boxes, full_box_entries, parsed
from framelake.storage import written

#: Boxes of runs or lists, with the bytes of an entry and its columns as (name, offset, size).
TABLES = {
    "stts": (8, [("count", 0, 4), ("delta", 4, 4)]),
    "ctts": (8, [("count", 0, 4), ("shift", 4, 4)]),
    "stsc": (12, [("first_chunk", 0, 4), ("samples_per_chunk", 4, 4), ("description", 8, 4)]),
    "stco": (4, [("chunk_offset", 0, 4)]),
    "co64": (8, [("chunk_offset", 0, 8)]),
    "stss": (4, [("sample_number", 0, 4)]),
}


def track_numbers(files: DataFrame) -> DataFrame:
    """(path, track, offset, size) of the track boxes of each file, numbered from 0."""
    found = boxes(files).where("error is null and kind = 'trak'")
    return found.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("offset")) - 1).alias("track"), "offset", "size")


def of_track(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows (path, parent, ...) with the track whose box holds them."""
    spans = tracks.select(F.col("path").alias("_p"), "track", F.col("offset").alias("_from"), (F.col("offset") + F.col("size")).alias("_to"))
    inside = (rows.path == spans._p) & (rows.parent >= spans._from) & (rows.parent < spans._to)
    return rows.join(merged(spans), inside).drop("_p", "_from", "_to")


def raw_table(files: DataFrame, kind: str) -> DataFrame:
    """(path, track, run from 1, columns) of a table box; ``chunk`` and ``run`` both number the entries."""
    width, columns = TABLES[kind]
    rows = full_box_entries(of_track(box_payloads(files, [kind]), track_numbers(files)), width, ["path", "track"])
    values = [big_endian(F.col("data"), at, size).alias(name) for name, at, size in columns]
    if kind == "ctts":
        # From version 1 on the shifts are signed.
        values[1] = F.when(F.col("version") > 0, _signed(big_endian(F.col("data"), 4, 4))).otherwise(big_endian(F.col("data"), 4, 4)).alias("shift")
    return rows.select("path", "track", (F.col("entry") + 1).alias("run"), (F.col("entry") + 1).alias("chunk"), *values)


def _signed(number: Column) -> Column:
    """An unsigned number of 32 bits read as a signed one."""
    return F.when(number >= 1 << 31, number - (1 << 32)).otherwise(number)


def edit_lists(files: DataFrame) -> DataFrame:
    """(path, track, ordinal, segment_duration, media_time, rate_int, rate_fraction, error) of the edit lists.

    A media time of -1 is an empty edit. A list with flags, of an unknown
    version, of another length than its count says or with a time under -1
    gives one row with its error and nulls.
    """
    found = of_track(box_payloads(files, ["elst"]).select("path", "parent", "payload"), track_numbers(files))
    at = lambda first, size: big_endian(F.col("payload"), first, size)
    wide = lambda first: F.conv(F.hex(F.expr(f"substring(payload, cast({first} + 1 as int), 8)")), 16, -10).cast("long")
    narrow = lambda first, size: F.conv(F.hex(F.expr(f"substring(payload, cast({first} + 1 as int), {size})")), 16, 10).cast("long")
    sized = found.withColumns({"_version": at(0, 1), "_flags": at(1, 3), "_n": at(4, 4)}).withColumn("_width", F.when(F.col("_version") == 0, 12).otherwise(20))
    shape = F.when((F.col("_version") > 1) | (F.col("_flags") != 0), "unsupported version or flags").when(F.length("payload") != 8 + F.col("_n") * F.col("_width"), "length differs from count")
    shaped = sized.withColumn("_shape", shape)
    each = shaped.withColumn("ordinal", F.explode_outer(F.when(F.col("_shape").isNull() & (F.col("_n") > 0), F.expr("sequence(0L, _n - 1)")))).where("_n > 0 or _shape is not null")
    first, old = "8 + ordinal * _width", F.col("_version") == 0
    half = lambda x: F.when(x >= 1 << 15, x - (1 << 16)).otherwise(x)
    rows = each.select(
        "path",
        "track",
        "ordinal",
        F.when(old, narrow(first, 4)).otherwise(wide(first)).alias("segment_duration"),
        F.when(old, _signed(narrow(f"{first} + 4", 4))).otherwise(wide(f"{first} + 8")).alias("media_time"),
        half(narrow(f"{first} + _width - 4", 2)).alias("rate_int"),
        half(narrow(f"{first} + _width - 2", 2)).alias("rate_fraction"),
        F.col("_shape").alias("error"),
    )
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("media_time") < -1, "media time under -1")))


#: Sample entries of video, with the box that holds their configuration, and the bytes before their boxes.
VIDEO_ENTRIES = {"avc1": "avcC", "avc3": "avcC", "vp09": "vpcC"}
VIDEO_ENTRY_BYTES = 78


def sample_descriptions(files: DataFrame) -> DataFrame:
    """(path, track, ordinal, format, width, height, configuration, profile, level, bit_depth, error) of the sample descriptions.

    Formats other than those of VIDEO_ENTRIES keep their name and nulls. The
    last three values are those of a VP9 configuration. A list whose version or
    count is wrong gives the error in each of its rows, an empty one that should
    not be gives one row; what cannot be read of an entry is its error and nulls.
    """
    payload, config = F.col("payload"), F.col("configuration")
    found = box_payloads(files, ["stsd"]).select("path", "parent", "offset", "payload")
    lists = of_track(found, track_numbers(files)).select("path", "track", F.col("offset").alias("_list"), big_endian(payload, 0, 1).alias("_version"), big_endian(payload, 4, 4).alias("_n"))
    entries = boxes(files).select("path", F.col("parent").alias("_list"), F.col("offset").alias("_entry"), F.col("kind").alias("format"), F.col("error").alias("_broken"))
    heads = box_payloads(files, [*VIDEO_ENTRIES]).select("path", F.col("offset").alias("_entry"), payload.alias("_head"))
    held = box_payloads(files, ["avcC", "vpcC"]).groupBy("path", F.col("parent").alias("_entry"), F.col("kind").alias("_box"))
    configurations = held.agg(F.count(F.lit(1)).alias("_configurations"), F.min("payload").alias("configuration"))
    box = F.coalesce(*(F.when(F.col("format") == k, v) for k, v in VIDEO_ENTRIES.items()))
    rows = lists.join(entries, ["path", "_list"], "left").withColumn("_box", box).join(heads, ["path", "_entry"], "left").join(configurations, ["path", "_entry", "_box"], "left")
    whole = Window.partitionBy("path", "track", "_list")
    is_vp9 = F.col("format") == "vp09"
    error = (
        F.when(F.coalesce(F.col("_version") != 0, F.lit(True)), "unsupported: version")
        .when(F.coalesce(F.count("_entry").over(whole) != F.col("_n"), F.lit(True)), "invalid: count of entries differs")
        .when(F.col("_broken").isNotNull(), F.col("_broken"))
        .when(F.col("_box").isNotNull() & (F.length("_head") < VIDEO_ENTRY_BYTES), "invalid: truncated entry")
        .when(F.col("_box").isNotNull() & config.isNull(), "invalid: no configuration")
        .when(F.col("_configurations") > 1, "invalid: more than one configuration")
        .when(is_vp9 & (F.length(config) < 12), "invalid: truncated configuration")
        .when(is_vp9 & (big_endian(config, 0, 1) != 1), "unsupported: version of the configuration")
        .when(is_vp9 & (big_endian(config, 1, 3) != 0), "invalid: flags of the configuration")
        .when(is_vp9 & (F.length(config) != 12 + big_endian(config, 10, 2)), "invalid: length of the configuration")
    )
    listed = rows.withColumns({"ordinal": (F.row_number().over(whole.orderBy("_entry")) - 1).cast("long"), "error": error}).where("_entry is not null or error is not null")
    sound = lambda x: F.when(F.col("error").isNull() & F.col("_box").isNotNull(), x)
    values = {"width": big_endian(F.col("_head"), 24, 2), "height": big_endian(F.col("_head"), 26, 2), "configuration": F.hex(config)}
    of_vp9 = {"profile": big_endian(config, 4, 1), "level": big_endian(config, 5, 1), "bit_depth": F.shiftright(big_endian(config, 6, 1), 4)}
    return listed.select("path", "track", "ordinal", "format", *(sound(v).alias(k) for k, v in values.items()), *(sound(F.when(is_vp9, v)).alias(k) for k, v in of_vp9.items()), "error")


def sample_sizes(files: DataFrame) -> DataFrame:
    """(path, track, sample_index, size): one size for all samples, or a list of them."""
    found = box_payloads(files, ["stsz"])
    payload = F.col("payload")
    sized = of_track(found.select("path", "parent", "payload"), track_numbers(files))
    sized = sized.select("path", "track", "payload", big_endian(payload, 4, 4).alias("_one"), big_endian(payload, 8, 4).alias("_n")).where("_n > 0")
    # Cut into pieces before rows are made of it, so that no row copies the whole list.
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda k: F.substring(payload, (13 + 4 * k).cast("int"), F.lit(4)))
    each = sized.select("path", "track", "_one", F.posexplode(own).alias("sample_index", "_own"))
    size = F.when(F.col("_one") > 0, F.col("_one")).otherwise(F.conv(F.hex("_own"), 16, 10).cast("long"))
    return each.select("path", "track", F.col("sample_index").cast("long").alias("sample_index"), size.alias("size"))


def compact_sizes(rows: DataFrame, data: str, bits: str, count: str) -> DataFrame:
    """``rows`` with sample_index and size from packed sizes of 4, 8 or 16 bits; of two in a byte the upper comes first."""
    each = rows.withColumn("sample_index", F.explode(F.expr(f"sequence(0L, {count} - 1)")))
    at = f"sample_index * {bits} div 8"
    number = F.conv(F.hex(F.expr(f"substring({data}, cast({at} + 1 as int), greatest({bits} div 8, 1))")), 16, 10).cast("long")
    nibble = F.when(F.col("sample_index") % 2 == 0, F.shiftright(number, 4)).otherwise(number.bitwiseAND(15))
    return each.withColumn("size", F.when(F.col(bits) == 4, nibble).otherwise(number))


def track_headers(files: DataFrame) -> DataFrame:
    """(path, track, handler, kind, timescale) of each track."""
    found = of_track(box_payloads(files, ["hdlr", "mdhd"]).select("path", "parent", F.col("kind").alias("_box"), "payload"), track_numbers(files))
    version = big_endian(F.col("payload"), 0, 1)
    scale = F.when(version == 1, big_endian(F.col("payload"), 20, 4)).otherwise(big_endian(F.col("payload"), 12, 4))
    handler = F.decode(F.substring("payload", 9, 4), "ISO-8859-1")
    merged = found.groupBy("path", "track").agg(F.max(F.when(F.col("_box") == "hdlr", handler)).alias("handler"), F.max(F.when(F.col("_box") == "mdhd", scale)).alias("timescale"))
    return merged.select("path", "track", "handler", track_kind(F.col("handler")).alias("kind"), "timescale")


def first_video_track(headers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, track) of the first track of video that has samples."""
    filled = sizes.select("path", "track").distinct()
    return headers.where("kind = 'Video'").join(filled, ["path", "track"], "left_semi").groupBy("path").agg(F.min("track").alias("track"))


def samples_of_files(files: DataFrame) -> DataFrame:
    """The fused sample rows of every track of the files, each of which is read once."""
    files = written(parsed(files, [*TABLES, "stsz"])) if "content" in files.columns else files
    key = ["path", "track"]
    offsets = raw_table(files, "stco").select(*key, "chunk", "chunk_offset").unionByName(raw_table(files, "co64").select(*key, "chunk", "chunk_offset"))
    marks = raw_table(files, "stss").select(*key, "sample_number")
    fused = fuse_sample_tables(raw_table(files, "stts"), raw_table(files, "ctts"), offsets, raw_table(files, "stsc"), sample_sizes(files), marks, key)
    listed = of_track(boxes(files).where("error is null and kind = 'stss'").select("path", "parent"), track_numbers(files)).select(*key, F.lit(True).alias("_listed")).distinct()
    # Without the list of sync samples every sample is one; an empty list means that none is.
    return fused.join(listed, key, "left").withColumn("sync", F.col("sync") | F.col("_listed").isNull()).drop("_listed")

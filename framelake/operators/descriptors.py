"""Nested descriptors with lengths of one to four bytes, and the audio entries that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.audio import audio_config
from framelake.functions.boxes import let
from framelake.functions.scalars import big_endian
from framelake.operators.tracks import of_track, track_numbers
from framelake.sources.mp4 import box_payloads, parsed
from framelake.storage import written

#: Tags of descriptors, the object type of MPEG-4 audio, and the type of audio streams.
STREAM, DECODER, SPECIFIC = 3, 4, 5
MPEG4_AUDIO, AUDIO_STREAM = 0x40, 5

#: Fixed value: bytes of an audio entry before its boxes.
AUDIO_ENTRY_BYTES = 28


def _byte(data: Column, at: Column) -> Column:
    """The byte at an offset from 0; null past the end."""
    part = F.substring(data, at + 1, F.lit(1))
    return F.when((at >= 0) & (at < F.length(data)), F.conv(F.hex(part), 16, 10).cast("int"))


def descriptor_at(data: Column, at: Column) -> Column:
    """struct(tag, start, end, error) of the descriptor that begins at ``at``: where its body lies.

    The length is one to four bytes of seven bits, greatest first; the upper bit says that one more follows.
    """
    read = F.struct(*[_byte(data, at + k).alias(f"b{k}") for k in range(5)])

    def placed(b: Column) -> Column:
        low = lambda k: b[f"b{k}"].bitwiseAND(127)
        value = [low(1)]
        for k in (2, 3, 4):
            value.append(value[-1] * 128 + low(k))
        ends = [b[f"b{k}"] < 128 for k in (1, 2, 3, 4)]
        length = F.coalesce(*(F.when(e, v) for e, v in zip(ends, value, strict=True)))
        width = F.coalesce(*(F.when(e, F.lit(k + 1)) for k, e in enumerate(ends)))
        start = at + 1 + width
        # Bytes are null past the end, and nothing stands behind a null.
        error = (
            F.when(b["b0"].isNull(), "invalid: truncated descriptor")
            .when(length.isNull() & b["b4"].isNotNull(), "invalid: length is over four bytes")
            .when(length.isNull(), "invalid: truncated length")
            .when(start + length > F.length(data), "invalid: truncated body")
        )
        return F.struct(b["b0"].alias("tag"), start.alias("start"), (start + length).alias("end"), error.alias("error"))

    return let(read, placed)


def find_descriptor(data: Column, at: Column, tag: int) -> Column:
    """struct(start, end, error) of the first descriptor of a tag among those from ``at`` on; nulls without one, an error where one before it cannot be read."""
    kind = "struct<at:int,start:int,end:int,error:string>"
    state = F.struct(at.cast("int").alias("at"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("error")).cast(kind)

    def step(s: Column, _: Column) -> Column:
        def seen(d: Column) -> Column:
            hit = d["error"].isNull() & (d["tag"] == tag)
            return F.struct(d["end"].alias("at"), F.when(hit, d["start"]).alias("start"), F.when(hit, d["end"]).alias("end"), d["error"].alias("error")).cast(kind)

        over = s["start"].isNotNull() | s["error"].isNotNull() | (s["at"] >= F.length(data))
        return F.when(over, s).otherwise(let(descriptor_at(data, s["at"]), seen))

    # Each descriptor has two bytes at least.
    found = F.aggregate(F.sequence(F.lit(0), F.greatest(F.call_function("div", F.length(data) - at, F.lit(2)).cast("int"), F.lit(0))), state, step)
    return let(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["error"].alias("error")))


def with_specific_config(rows: DataFrame, payload: str) -> DataFrame:
    """``rows`` with config, the decoder's own configuration in a stream descriptor box (version, flags, descriptors), and config_error.

    Each level is a column of its own, so it is worked out once a row. A null
    payload is a truncated one; the first fault from the outside in is the error.
    """
    data = F.substring(F.col(payload), F.lit(5), F.greatest(F.length(payload) - 4, F.lit(0)))
    body = lambda whole, found: F.substring(F.col(whole), F.col(f"{found}.start") + 1, F.col(f"{found}.end") - F.col(f"{found}.start"))
    levels = rows.withColumn("_data", F.coalesce(data, F.unhex(F.lit("")))).withColumn("_root", descriptor_at(F.col("_data"), F.lit(0))).withColumn("_body", body("_data", "_root"))
    flags = _byte(F.col("_body"), F.lit(2))
    has = lambda bit: flags.bitwiseAND(bit) > 0
    url = 3 + F.when(has(0x80), 2).otherwise(0)
    after = url + F.when(has(0x40), 1 + _byte(F.col("_body"), url)).otherwise(0) + F.when(has(0x20), 2).otherwise(0)
    levels = levels.withColumn("_after", after).withColumn("_decoder", find_descriptor(F.col("_body"), F.col("_after"), DECODER)).withColumn("_inner", body("_body", "_decoder"))
    levels = levels.withColumn("_specific", find_descriptor(F.col("_inner"), F.lit(13), SPECIFIC)).withColumn("config", body("_inner", "_specific"))
    kind = _byte(F.col("_inner"), F.lit(1))
    error = (
        F.when(F.coalesce(F.length(payload), F.lit(0)) < 4, "invalid: truncated box")
        .when(big_endian(F.col(payload), 0, 4) != 0, "invalid: version or flags")
        .when(F.col("_root.error").isNotNull(), F.col("_root.error"))
        .when((F.col("_root.tag") != STREAM) | (F.col("_root.end") != F.length("_data")), "invalid: not one whole stream descriptor")
        .when(F.length("_body") < 3, "invalid: truncated stream descriptor")
        .when(F.col("_after").isNull() | (F.col("_after") > F.length("_body")), "invalid: flags pass the stream descriptor")
        .when(F.col("_decoder.error").isNotNull(), F.col("_decoder.error"))
        .when(F.col("_decoder.start").isNull(), "invalid: no decoder configuration")
        .when(F.length("_inner") < 13, "invalid: truncated decoder configuration")
        .when(_byte(F.col("_inner"), F.lit(0)) != MPEG4_AUDIO, "unsupported: object type")
        .when((F.shiftright(kind, 2) != AUDIO_STREAM) | (kind % 2 == 0), "invalid: no audio stream")
        .when(F.col("_specific.error").isNotNull(), F.col("_specific.error"))
        .when(F.col("_specific.start").isNull(), "invalid: no specific configuration")
        .when(F.length("config") == 0, "invalid: empty specific configuration")
    )
    judged = levels.withColumn("config_error", error).withColumn("config", F.when(F.col("config_error").isNull(), F.col("config")))
    return judged.drop("_data", "_root", "_body", "_after", "_decoder", "_inner", "_specific")


def audio_entries(files: DataFrame) -> DataFrame:
    """(path, track, ordinal, channels, sample_bits, rate, configuration, error) of the mp4a entries of files, numbered from 0 in each track.

    An entry must have version 0, channels, a whole rate, one stream descriptor
    box, and a configuration of the same rate and channels that is supported.
    """
    files = written(parsed(files, ["mp4a", "esds"])) if "content" in files.columns else files
    entries = of_track(box_payloads(files, ["mp4a"]).select("path", "parent", "offset", F.col("payload").alias("_head")), track_numbers(files))
    inner = box_payloads(files, ["esds"]).groupBy("path", F.col("parent").alias("offset")).agg(F.count(F.lit(1)).alias("_n"), F.min("payload").alias("_esds"))
    rows = with_specific_config(entries.join(inner, ["path", "offset"], "left"), "_esds").withColumn("_c", audio_config(F.col("config")))
    head = F.col("_head")
    channels, bits, fixed = big_endian(head, 16, 2), big_endian(head, 18, 2), big_endian(head, 24, 4)
    error = (
        F.when(F.length(head) < AUDIO_ENTRY_BYTES, "invalid: truncated entry")
        .when(big_endian(head, 8, 2) != 0, "unsupported: version of the entry")
        .when(channels == 0, "invalid: no channels")
        .when(fixed % 65536 != 0, "unsupported: rate is not whole")
        .when(fixed == 0, "invalid: rate is zero")
        .when(F.col("_n").isNull(), "invalid: no esds box")
        .when(F.col("_n") > 1, "invalid: more than one esds box")
        .when(F.col("config_error").isNotNull(), F.col("config_error"))
        .when(F.col("_c").isNull(), "unsupported: audio configuration")
        .when(F.col("_c.rate") != F.shiftright(fixed, 16), "invalid: rates differ")
        .when(F.col("_c.channels") != channels, "invalid: channels differ")
    )
    w = Window.partitionBy("path", "track").orderBy("offset")
    judged = rows.withColumns({"error": error, "ordinal": (F.row_number().over(w) - 1).cast("long")})
    sound = lambda x, name: F.when(F.col("error").isNull(), x).alias(name)
    return judged.select("path", "track", "ordinal", sound(channels, "channels"), sound(bits, "sample_bits"), sound(F.shiftright(fixed, 16), "rate"), sound(F.hex("config"), "configuration"), "error")

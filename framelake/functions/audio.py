"""Audio rules as column expressions: durations, layouts, and samples of companded codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sampling rates by index.
RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]


def frames_of_duration(value: Column, timescale: Column, rate: int) -> Column:
    """Sample frames of a duration, truncated; null for a negative one."""
    return F.when(value >= 0, F.call_function("div", value.cast("decimal(19,0)") * F.lit(rate), timescale.cast("decimal(10,0)")).cast("long"))


def duration_of_frames(frames: Column, rate: Column) -> Column:
    """struct(value, timescale): the exact time that sample frames take; null without frames or a positive rate."""
    return F.when(frames.isNotNull() & (rate > 0), F.struct(frames.cast("long").alias("value"), rate.cast("long").alias("timescale")))


def duration_fits(frames: Column, value: Column, timescale: Column, rate: int) -> Column:
    """Whether a duration agrees with its frames to within one of them."""
    difference = F.abs(value.cast("decimal(19,0)") * F.lit(rate) - frames.cast("decimal(19,0)") * timescale.cast("decimal(10,0)"))
    return difference <= timescale


def audio_config(data: Column) -> Column:
    """struct(object_type, rate, channels) of an audio configuration; null if it is not supported.

    Supported are object type 2, a rate by index or in 24 bits of its own, and
    one or two channels.
    """
    bits = lambda size, shift, mask: F.shiftright(F.conv(F.hex(F.substring(data, 1, size)), 16, 10).cast("long"), shift).bitwiseAND(mask).cast("int")
    kind, index = bits(2, 11, 31), bits(2, 7, 15)
    own = (index == 15) & (F.length(data) >= 5)
    rate = F.when(own, bits(5, 7, 0xFFFFFF)).otherwise(F.try_element_at(F.array(*map(F.lit, RATES)), index + 1))
    channels = F.when(own, bits(5, 3, 15)).otherwise(bits(2, 3, 15))
    fits = (F.length(data) >= 2) & (kind == 2) & (rate > 0) & channels.isin(1, 2)
    return F.when(fits, F.struct(kind.alias("object_type"), rate.alias("rate"), channels.alias("channels")))


def layout(channels: Column) -> Column:
    return F.when(channels == 1, "Mono").when(channels == 2, "Stereo").otherwise(F.concat(F.lit("Discrete"), channels.cast("string")))


def mu_law(code: Column) -> Column:
    """Sample in -1..1 of a mu-law code from 0 to 255."""
    flipped = F.bitwise_not(code).bitwiseAND(255)
    exponent, mantissa = F.shiftright(flipped, 4).bitwiseAND(7), flipped.bitwiseAND(15)
    size = ((2 * mantissa + 33) * F.pow(F.lit(2.0), exponent) - 33) * 4
    return F.when(flipped >= 128, -size).otherwise(size) / F.lit(32768.0)


def a_law(code: Column) -> Column:
    """Sample in -1..1 of an A-law code from 0 to 255."""
    flipped = code.bitwiseXOR(0x55)
    exponent, mantissa = F.shiftright(flipped, 4).bitwiseAND(7), flipped.bitwiseAND(15)
    size = F.when(exponent == 0, (2 * mantissa + 1) * F.lit(8.0)).otherwise((2 * mantissa + 33) * F.pow(F.lit(2.0), exponent - 1) * 8)
    return F.when(flipped >= 128, size).otherwise(-size) / F.lit(32768.0)


def pcm(value: Column, bits: int) -> Column:
    """Signed whole number of ``bits`` bits to -1..1."""
    return value.cast("double") / F.lit(float(1 << (bits - 1)))


#: Codecs whose data must be given.
NEED_DATA = ("aac", "alac", "flac", "vorbis")


def decoder_config_error(codec: Column, rate: Column, channels: Column, data: Column, bits: Column, coded_bits: Column, packet_frames: Column, block_frames: Column) -> Column:
    """What forbids the configuration of an audio decoder, or null; data, widths and frame counts may be null where they are not given."""
    return (
        F.when(rate == 0, "invalid: rate is zero")
        .when(channels == 0, "invalid: no channels")
        .when(F.length(data) == 0, "invalid: codec data is empty")
        .when(codec.isin(*NEED_DATA) & data.isNull(), "invalid: codec needs data")
        .when(F.coalesce(bits == 0, F.lit(False)) | F.coalesce(coded_bits == 0, F.lit(False)), "invalid: sample width is zero")
        .when(coded_bits > bits, "invalid: coded width exceeds the decoded one")
        .when(F.coalesce(packet_frames == 0, F.lit(False)) | F.coalesce(block_frames == 0, F.lit(False)), "invalid: frame count is zero")
        .when(codec.startswith("adpcm") & (packet_frames.isNull() | block_frames.isNull()), "invalid: codec needs frame counts")
    )

"""Scalar rules of containers and streams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(data: Column, offset: int, size: int) -> Column:
    """An unsigned number of ``size`` bytes at ``offset`` (from 0); null past the end."""
    part = F.substring(data, offset + 1, size)
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def four_cc(data: Column) -> Column:
    """Four bytes as text where all are printable, else as hex."""
    text = F.decode(data, "ISO-8859-1")
    return F.when(text.rlike(r"^[\x20-\x7e]{4}$"), text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(data))))


def content_range(header: Column) -> Column:
    """struct(first, last, total) of ``bytes first-last/total``; total is null for ``*``; null where it is malformed."""
    pattern = r"^bytes (\d{1,18})-(\d{1,18})/(\d{1,18}|\*)\z"
    first, last, total = (F.regexp_extract(header, pattern, k) for k in (1, 2, 3))
    number = lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long")
    parsed = F.struct(number(first).alias("first"), number(last).alias("last"), F.when(total != "*", number(total)).alias("total"))
    sound = (parsed["first"] <= parsed["last"]) & (parsed["total"].isNull() | (parsed["last"] < parsed["total"]))
    return F.when(header.rlike(pattern) & sound, parsed)


def nal_header(first_byte: Column) -> Column:
    """struct(ref_idc, type) of the first byte of a unit; null where the forbidden bit is set."""
    ref_idc = F.shiftright(first_byte, 5).bitwiseAND(3)
    return F.when((first_byte >= 0) & (first_byte < 128), F.struct(ref_idc.alias("ref_idc"), first_byte.bitwiseAND(31).alias("type")))


def unit_length_size(record: Column) -> Column:
    """Bytes of the length before each unit, from a decoder configuration; null where it is too short."""
    return F.when(F.length(record) >= 7, big_endian(record, 4, 1).bitwiseAND(3) + 1).cast("int")


def nal_kind(unit_type: Column) -> Column:
    """What a decoder does with a unit of this type."""
    return (
        F.when(unit_type.isin(1, 5), "slice")
        .when(unit_type.isin(2, 3, 4, 20, 21), "unsupported")
        .when(unit_type == 7, "sequence_parameters")
        .when(unit_type == 8, "picture_parameters")
        .when(unit_type == 9, "delimiter")
        .when(unit_type == 10, "end_of_sequence")
        .when(unit_type == 11, "end_of_stream")
        .otherwise("ignored")
    )


def track_kind(handler: Column) -> Column:
    return F.when(handler == "vide", "Video").when(handler == "soun", "Audio").when(handler.isin("sbtl", "subt", "text", "clcp"), "Subtitle").when(handler == "meta", "Metadata").otherwise("Unknown")


def is_mp4(path: Column, content: Column) -> Column:
    """By name, or by the kind of the first box."""
    kind = F.decode(F.substring(content, 5, 4), "ISO-8859-1")
    return F.lower(path).rlike(r"\.(mp4|mov|m4v)$") | F.coalesce(kind.isin("ftyp", "moov", "free", "wide"), F.lit(False))


def chroma_qp(luma_qp: Column, offset: int) -> Column:
    """Quantizer of chroma: equal to the shifted luma one below 30, by table from there."""
    table = [29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39]  # fixed values
    index = F.least(F.greatest(luma_qp + F.lit(offset), F.lit(0)), F.lit(51))
    return F.when(index < 30, index).otherwise(F.element_at(F.array(*map(F.lit, table)), F.greatest(index - 29, F.lit(1)).cast("int")))


#: Planes of a pixel format, and how often its chroma is halved across and down; null without chroma planes.
PIXEL_FORMATS = {"nv12": (2, 1, 1), "p010": (2, 1, 1), "bgra8": (1, None, None), "rgba8": (1, None, None), "i420": (3, 1, 1), "i422": (3, 1, 0), "i440": (3, 0, 1), "i444": (3, 0, 0)}


def pixel_layout(name: Column, across: Column, down: Column) -> Column:
    """struct(planes, across, down, is_420) of a pixel format; ``across`` and ``down`` are those of planar 16-bit ones. Null for unknown names."""
    of = lambda k: F.coalesce(*(F.when(name == n, F.lit(v[k])) for n, v in PIXEL_FORMATS.items()))
    wide = name == "planar_yuv16"
    planes = F.when(wide, F.lit(3)).otherwise(of(0))
    halved = [F.when(wide, own.cast("int")).otherwise(of(k).cast("int")) for k, own in ((1, across), (2, down))]
    is_420 = F.coalesce((halved[0] == 1) & (halved[1] == 1), F.lit(False))
    return F.when(planes.isNotNull(), F.struct(planes.alias("planes"), halved[0].alias("across"), halved[1].alias("down"), is_420.alias("is_420")))


#: Matrix, primaries and transfer of each colour space of VP9, by its number; a number in brackets is passed on as it is.
VP9_COLOURS = [
    ("bt601", "unspecified", "unspecified"),
    ("bt709", "bt709", "bt709"),
    ("smpte170m", "bt601_525", "smpte170m"),
    ("other(7)", "other(7)", "other(7)"),
    ("bt2020_ncl", "bt2020", "bt2020_10"),
    ("unspecified", "unspecified", "unspecified"),
    ("other(0)", "other(11)", "unspecified"),
    ("identity", "bt709", "srgb"),
]


def vp9_colour(number: Column) -> Column:
    """struct(matrix, primaries, transfer) of a VP9 colour space: 0 BT.601, 1 BT.709, 2 SMPTE-170, 3 SMPTE-240, 4 BT.2020, 5 reserved, 6 SMPTE-431, 7 sRGB; null beyond."""
    table = F.array(*(F.struct(F.lit(m).alias("matrix"), F.lit(p).alias("primaries"), F.lit(t).alias("transfer")) for m, p, t in VP9_COLOURS))
    return F.when(number.between(0, 7), F.get(table, number.cast("int")))


def implicit_weight(current: Column, first: Column, second: Column) -> Column:
    """Weight of the second reference (of 64 in all) from picture order counts; 32 where the rule does not apply."""
    clip = lambda x: F.least(F.greatest(x, F.lit(-128)), F.lit(127)).cast("long")
    toward_zero = lambda a, b: F.call_function("div", a, b)
    distance, part = clip(second - first), clip(current - first)
    scale = toward_zero(F.lit(16384) + toward_zero(F.abs(distance), F.lit(2)), F.when(distance != 0, distance))
    weight = F.shiftright(part * scale + 32, 8)
    return F.when((second == first) | weight.isNull() | (weight < -64) | (weight > 128), F.lit(32)).otherwise(weight).cast("int")


def tile_bounds(index: Column, blocks: Column, tiles_log2: Column) -> Column:
    """struct(first, end) of a tile, in blocks of eight samples of ``blocks`` in all; tiles begin at whole superblocks of eight blocks."""
    superblocks = F.ceil(blocks / 8).cast("long")
    start = lambda k: F.least(F.call_function("shiftright", k * superblocks, tiles_log2.cast("int")) * 8, blocks.cast("long"))
    return F.struct(start(index).alias("first"), start(index + 1).alias("end"))


def tile_ranges(frame: str, start: str, tiles: str) -> Column:
    """struct(ranges, error) of the byte ranges (first, end) of a frame's tiles behind its headers, from the names of columns.

    Each tile but the last follows its size in four bytes; the last takes the
    rest. The ranges up to an error are kept. A null gives null.
    """
    head = f"if(k = {tiles}, 0, 4)"
    size = f"if(k = {tiles}, length({frame}) - s.at, cast(conv(hex(substring({frame}, cast(s.at + 1 as int), 4)), 16, 10) as bigint))"
    error = f"case when s.at + {head} > length({frame}) then 'truncated: tile size' when {size} = 0 then 'invalid: empty tile' when s.at + {head} + {size} > length({frame}) then 'truncated: tile payload' end"
    step = f"""if(s.error is not null, s, if({error} is not null, named_struct('at', s.at, 'ranges', s.ranges, 'error', {error}),
        named_struct('at', s.at + {head} + {size}, 'ranges', concat(s.ranges, array(named_struct('first', s.at + {head}, 'end', s.at + {head} + {size}))), 'error', cast(null as string))))"""
    begin = f"named_struct('at', cast({start} as bigint), 'ranges', cast(array() as array<struct<first: bigint, end: bigint>>), 'error', if({start} > length({frame}), 'truncated: tile payload', cast(null as string)))"
    return F.expr(f"if({frame} is null, null, aggregate(sequence(1, {tiles}), {begin}, (s, k) -> {step}, s -> named_struct('ranges', s.ranges, 'error', s.error)))")


def video_format_error(pixels: Column, bit_depth: Column, across: Column, down: Column, coded: tuple[Column, Column], visible: tuple[Column, Column, Column, Column], display: tuple[Column, Column]) -> Column:
    """What forbids a video format, or null: layout of planar 16-bit pixels, then empty sizes, then the visible (x, y, width, height) beyond the coded size."""
    x, y, width, height = (v.cast("long") for v in visible)
    layout = (pixels == "planar_yuv16") & (~bit_depth.between(9, 16) | (across > 1) | (down > 1))
    empty = lambda size: (size[0] == 0) | (size[1] == 0)
    return (
        F.when(layout, "invalid: depth or subsampling")
        .when(empty(coded), "invalid: coded size is empty")
        .when(empty((width, height)), "invalid: visible rectangle is empty")
        .when(empty(display), "invalid: display size is empty")
        .when(F.greatest(x + width, y + height) >= 1 << 32, "invalid: overflow")
        .when((x + width > coded[0]) | (y + height > coded[1]), "invalid: visible rectangle exceeds the coded size")
    )

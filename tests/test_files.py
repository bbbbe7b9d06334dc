"""Box files read by ranges, raw media files, descriptors and headers, against bytes made by plain Python."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from framelake.functions import scalars
from framelake.functions import time as media
from framelake.operators import descriptors, headers, tracks
from framelake.plans import byte_queries
from framelake.plans import queries as media_queries
from framelake.sources import mp4, mp4_files, raw_files

SMALL = "/root/testdata/sf0.001"


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def file(spark, *contents):
    return spark.createDataFrame([(f"f{k}", bytearray(c)) for k, c in enumerate(contents)], "path string, content binary")


def test_deep_nesting_is_a_row_and_not_a_crash(spark):
    deep = b""
    for _ in range(1500):
        deep = box(b"moov", deep)
    rows = mp4.boxes(file(spark, deep, b"")).collect()
    assert len(rows) == mp4.MOST_DEPTH + 1
    assert [r.error for r in rows if r.error] == ["invalid: nested too deep"]


def test_boxes_come_before_those_they_hold():
    inner = box(b"trak", box(b"tkhd", b"abcd"), box(b"free"))
    data = box(b"ftyp", b"isom") + box(b"moov", inner, box(b"trak")) + box(b"free")
    assert [(r[0], r[2], r[4], r[5]) for r in mp4.box_rows(data)] == [(0, "ftyp", 0, -1), (12, "moov", 0, -1), (20, "trak", 1, 12), (28, "tkhd", 2, 20), (40, "free", 2, 20), (48, "trak", 1, 12), (56, "free", 0, -1)]


def test_files_are_read_by_ranges(spark, tmp_path):
    """Files of table columns with a megabyte of media each: what is read is a small part, and the same as from whole contents."""
    spark.dataSource.register(mp4_files.BoxSource)
    movies = [(r.path, bytes(r.content)) for r in byte_queries.movie_files(spark, SMALL).collect()]
    for path, content in movies:
        (tmp_path / f"{path}.mp4").write_bytes(box(b"mdat", bytes(1 << 20)) + content)
    found = spark.read.format("mp4_boxes").option("kinds", "stts,stsz").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == len(movies)
    rows = found.collect()
    assert not [r for r in rows if r.error]
    read = {r.path: r.bytes_read for r in rows}
    assert all(n < len(content) for n, (_, content) in zip((read[str(tmp_path / f"{p}.mp4")] for p, _ in movies), movies, strict=True))
    whole = mp4.parsed(spark.createDataFrame([(str(tmp_path / f"{p}.mp4"), bytearray((tmp_path / f"{p}.mp4").read_bytes())) for p, _ in movies], "path string, content binary"), ["stts", "stsz"]).collect()
    key = lambda rows: sorted((r.path, r.offset, r.kind, r.payload and bytes(r.payload)) for r in rows)
    assert key(rows) == key(whole)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    narrow = spark.read.format("mp4_boxes").option("kinds", "stts,stsz").option("pushdown", "true").load(str(tmp_path)).where("kind = 'stts'").collect()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert key(narrow) == [r for r in key(rows) if r[2] == "stts"] and max(r.bytes_read for r in narrow) < max(read.values())
    stored = found.drop("bytes_read")
    assert tracks.raw_table(stored, "stts").count() == spark.read.parquet(f"{SMALL}/part.parquet").count()


def test_a_movie_has_one_moov_and_one_header(spark, tmp_path):
    spark.dataSource.register(mp4_files.BoxSource)
    head = box(b"mvhd", bytes(12))
    cases = {"none": box(b"ftyp"), "two": box(b"moov", head) * 2, "bare": box(b"moov", box(b"trak")), "double": box(b"moov", head, head), "good": box(b"moov", head), "cut": box(b"moov", head)[:-2], "empty": b""}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    found = spark.read.format("mp4_boxes").load(str(tmp_path)).where("error IS NOT NULL")
    errors = {}
    for r in found.collect():
        errors.setdefault(r.path.rsplit("/", 1)[1], []).append(r.error)
    assert errors == {"none": ["invalid: no moov box"], "two": ["invalid: more than one moov box"], "bare": ["invalid: moov has no mvhd box"], "double": ["invalid: more than one mvhd box"], "cut": ["invalid: size out of bounds", "invalid: no moov box"], "empty": ["invalid: no moov box"]}
    with pytest.raises(Exception, match="missing"):
        spark.read.format("mp4_boxes").load(str(tmp_path / "missing")).count()


def test_headers_of_both_versions(spark):
    def track(tkhd, mdhd, hdlr=box(b"hdlr", bytes(8), b"vide", bytes(13)), more=b""):
        return box(b"moov", box(b"trak", tkhd, box(b"mdia", mdhd, hdlr), more))

    new = box(b"tkhd", b"\1\0\0\3", bytes(16), struct.pack(">I", 9), bytes(12 + 52), struct.pack(">II", 5, 6))
    old = box(b"tkhd", bytes(12), struct.pack(">I", 2), bytes(8 + 52), struct.pack(">II", 7, 8))
    long = box(b"mdhd", b"\1\0\0\0", bytes(16), struct.pack(">IQ", 90000, 1 << 40), bytes(4))
    unknown = box(b"mdhd", b"\1\0\0\0", bytes(16), struct.pack(">IQ", 1, (1 << 64) - 1), bytes(4))
    zero = box(b"mdhd", bytes(12), struct.pack(">II", 0, 1), bytes(4))
    got = headers.track_header_fields(file(spark, track(new, long), track(old, unknown), track(old, zero), track(old, unknown, b""), track(old + old, unknown))).orderBy("path").collect()
    nothing = (None,) * 6
    assert [(r.id, r.flags, r.width, r.height, r.timescale, r.duration, r.error) for r in got] == [
        (9, 3, 5, 6, 90000, 1 << 40, None), (2, 0, 7, 8, 1, None, None), (*nothing, "invalid: timescale is zero"), (*nothing, "invalid: track has no hdlr box"), (*nothing, "invalid: more than one tkhd box"),
    ]


def test_descriptors_survive_any_bytes(spark):
    whole = bytes.fromhex("00000000" "0316" "000000" "0411" "4015" + "00" * 11 + "0502" "1190")
    cases = [None, b"", *(whole[:n] for n in range(len(whole) + 1)), *(whole[:n] + b"\xff" + whole[n + 1 :] for n in range(4, len(whole)))]
    rows = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(cases)], "k int, p binary")
    got = {r.k: r for r in descriptors.with_specific_config(rows, "p").collect()}
    assert len(got) == len(cases) and all((r.config is None) == (r.config_error is not None) for r in got.values())
    assert got[2 + len(whole)].config == bytearray(b"\x11\x90")


def test_text_with_a_line_feed_behind_is_refused(spark):
    row = spark.range(1).select(media.parse_seconds(F.lit("12\n")).alias("t"), scalars.content_range(F.lit("bytes 0-0/10\n")).alias("r"), media.parse_seconds(F.lit("00000000000000000000000001.50")).alias("u")).first()
    assert row.t is None and row.r is None and tuple(row.u) == (150, 100)
    words = spark.createDataFrame([(x,) for x in (".5", "-1", "x", "9223372036854775807", "9223372036854775808", "9223372036.854775808", "1.0000000000", "1.")], "x string")
    assert [tuple(r.t) if r.t else None for r in words.select(media.parse_seconds(F.col("x")).alias("t")).collect()] == [None, None, None, ((1 << 63) - 1, 1), None, None, None, (1, 1)]


def test_raw_files_hold_their_streams_in_order(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("concat('u', user_id % 7) as stream", "event_id as position", "cast(event_id as string) as text", "array(cast(value as float), cast(event_id as float)) as samples")
    raw_files.write_raw(events.select("stream", "position", F.col("text").cast("binary").alias("data")).repartition(5), str(tmp_path / "frames"), ".nv12")
    raw_files.write_raw(events.select("stream", "position", "samples"), str(tmp_path / "pcm"), ".f32")
    rows = sorted(tuple(r) for r in events.collect())
    for s in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == s]
        assert (tmp_path / "frames" / f"{s}.nv12").read_bytes() == "".join(r[2] for r in own).encode()
        assert (tmp_path / "pcm" / f"{s}.f32").read_bytes() == b"".join(struct.pack("<2f", *r[3]) for r in own)
    assert len(list((tmp_path / "frames").iterdir())) == len({r[0] for r in rows})


def test_a_failed_sink_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('s', id % 4) as stream", "id as position", "case when id = 27 then array(cast(raise_error('spoilt') as float)) else array(1f) end as samples")
    with pytest.raises(Exception, match="spoilt"):
        raw_files.write_raw(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="no file name"):
        raw_files.write_raw(spark.createDataFrame([("../x", 0, bytearray(b"a"))], "stream string, position long, data binary"), str(tmp_path / "out"))
    assert not list(tmp_path.rglob("*x*"))


def test_planes_that_are_too_short_show_nothing(spark):
    at = "struct<first_row:bigint,byte_offset:bigint,row_bytes:bigint,rows:bigint>"
    rows = spark.createDataFrame([(bytearray(b"abcdef"), (0, 1, 2, 2)), (bytearray(b"abcde"), (0, 1, 2, 2)), (bytearray(b"abcdef"), (5, 0, 0, 0)), (None, (0, 0, 1, 1)), (bytearray(b"a"), None)], f"p binary, l {at}")
    got = [r.v and bytes(r.v) for r in rows.select(raw_files.visible_rows("p", F.lit(0).cast("long"), F.lit(3).cast("long"), "l").alias("v")).collect()]
    assert got == [b"bcef", None, bytearray(b""), None, None]


def test_small_files_of_the_fixture(spark):
    """The five samples of a small file, with unsigned and with signed shifts."""
    files = spark.createDataFrame([("a", bytearray(media_queries.sample_file())), ("b", bytearray(media_queries.sample_file(1)))], "path string, content binary")
    got = {(r.path, r.sample_index): (r.offset, r.size, r.dts, r.pts, r.duration, r.sync) for r in tracks.samples_of_files(files).collect()}
    want = [(1000, 10, 0, 10, 100, True), (1010, 11, 100, 110, 100, False), (2000, 12, 200, 220, 100, False), (2012, 13, 300, 320, 50, True), (2025, 14, 350, 370, 50, False)]
    assert [got["a", k] for k in range(5)] == want
    assert [got["b", k][3] for k in range(5)] == [10, 110, 198, 298, 348]


def test_chunks_that_lie_behind_four_bytes(spark, tmp_path):
    """Places of 5000 a key: those of the first file fit in four bytes, the second has some on both sides, the third all behind."""
    keys = [858959, 858993, 858994, 859000, 1 << 32]
    spark.createDataFrame([(k, 2) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    files = byte_queries.movie_files(spark, str(tmp_path))
    kinds = {(r.path, r.kind) for r in mp4.boxes(files).where("kind in ('stco', 'co64')").collect()}
    assert kinds == {("part-21473", "stco"), ("part-21474", "co64"), ("part-21475", "co64"), (f"part-{(1 << 32) // 40}", "co64")}
    got = sorted(r.offset for r in byte_queries.samples_of_files(spark, str(tmp_path)).where("sync").collect())
    assert got == [5000 * k for k in keys]

"""Queries whose bytes are made of the columns of the supplied tables, so that SQL over the same columns says what must be read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import audio, boxes, scalars
from framelake.functions import time as media
from framelake.operators import descriptors, fragment_bytes, headers, runs, tracks
from framelake.plans.queries import _events, _table, query
from framelake.sources import bits, bitstreams, mp4, raw_files, slices
from framelake.sources import frame_heads as frame_heads_
from framelake.storage import written


def _zeros(n):
    return F.unhex(F.repeat(F.lit("00"), n.cast("int") if hasattr(n, "cast") else n))


def _orders(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o"), F.col("o_custkey").cast("long").alias("c"))


@query(
    "a5_boxes",
    """WITH k AS (SELECT o_orderkey AS o, o_custkey AS c, 36 + o_orderkey % 20 + o_custkey % 9 AS t FROM orders)
    SELECT 'o' || o AS path, x."offset", x.size, x.kind, x.header_size, x.depth, x.parent, x.error FROM (
      SELECT o, unnest(list_concat([
        struct_pack("offset" := CAST(0 AS BIGINT), size := CAST(12 AS BIGINT), kind := 'ftyp', header_size := 8, depth := 0, parent := CAST(-1 AS BIGINT), error := CAST(NULL AS VARCHAR)),
        struct_pack("offset" := 12, size := 8 + o % 20, kind := 'free', header_size := 8, depth := 0, parent := -1, error := NULL),
        struct_pack("offset" := 20 + o % 20, size := 16 + c % 9, kind := 'mdat', header_size := 16, depth := 0, parent := -1, error := NULL)],
        CASE o % 7
          WHEN 0 THEN [struct_pack("offset" := t, size := 5, kind := NULL, header_size := 0, depth := 0, parent := -1, error := 'invalid: truncated header')]
          WHEN 1 THEN [struct_pack("offset" := t, size := 8, kind := 'skip', header_size := 8, depth := 0, parent := -1, error := 'invalid: size out of bounds')]
          WHEN 2 THEN [struct_pack("offset" := t, size := 28, kind := 'moov', header_size := 8, depth := 0, parent := -1, error := NULL),
                       struct_pack("offset" := t + 8, size := 20, kind := 'trak', header_size := 8, depth := 1, parent := t, error := NULL),
                       struct_pack("offset" := t + 16, size := 12, kind := 'tkhd', header_size := 8, depth := 2, parent := t + 8, error := NULL)]
          WHEN 3 THEN [struct_pack("offset" := t, size := 8 + c % 5, kind := 'wide', header_size := 8, depth := 0, parent := -1, error := NULL)]
          ELSE [] END)) AS x FROM k)""",
)
def box_scan(spark, sf_dir):
    o, c = F.col("o"), F.col("c")
    last = (
        F.when(o % 7 == 0, _zeros(5)).when(o % 7 == 1, F.concat(boxes.number(F.lit(100), 4), F.lit("skip").cast("binary")))
        .when(o % 7 == 2, boxes.box("moov", boxes.box("trak", boxes.box("tkhd", _zeros(4)))))
        .when(o % 7 == 3, F.concat(_zeros(4), F.lit("wide").cast("binary"), _zeros(c % 5))).otherwise(_zeros(0))
    )
    long_box = F.concat(boxes.number(F.lit(1), 4), F.lit("mdat").cast("binary"), boxes.number(16 + c % 9, 8), _zeros(c % 9))
    content = F.concat(boxes.box("ftyp", boxes.number(o, 4)), boxes.box("free", _zeros(o % 20)), long_box, last)
    return mp4.boxes(_orders(spark, sf_dir).select(F.concat(F.lit("o"), o).alias("path"), content.alias("content")))


#: Parts of so many keys make a file, with a track of the even and one of the odd keys, and a run and a chunk for each part.
FILE_KEYS = 40

_RUNS = f"""r AS (
      SELECT p_partkey // {FILE_KEYS} AS f, p_partkey AS run, p_partkey % 2 AS odd, p_size AS n, 1 + p_partkey % 7 AS delta, p_partkey % 5 - 2 * (p_partkey // {FILE_KEYS} % 2) AS shift,
             10 + p_partkey % 90 AS size_, dense_rank() OVER (PARTITION BY p_partkey // {FILE_KEYS} ORDER BY p_partkey % 2) - 1 AS track FROM part)"""


def _file_runs(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey").cast("long")
    file = F.call_function("div", key, F.lit(FILE_KEYS))
    return _table(spark, sf_dir, "part").select(file.alias("f"), key.alias("run"), (key % 2).alias("odd"), F.col("p_size").cast("long").alias("n"), (1 + key % 7).alias("delta"), (key % 5 - 2 * (file % 2)).alias("shift"), (10 + key % 90).alias("size"))


def movie_files(spark, sf_dir) -> DataFrame:
    """(path, content): parts as MP4 files of two tracks, with headers, edit lists, descriptions and sample tables."""
    w = Window.partitionBy("f", "odd").orderBy("run")
    placed = _file_runs(spark, sf_dir).withColumns({"chunk": F.row_number().over(w), "before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    f, odd, n = F.col("f"), F.col("odd"), F.col("n")
    four = lambda *values: F.concat(*(boxes.number_hex(v, 4) for v in values))
    # Places of chunks take eight bytes in all of a file where its last may not fit in four.
    far = 5000 * (FILE_KEYS * (f + 1) - 1) >= 1 << 32
    place = 5000 * F.col("run")
    sizes = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: boxes.number_hex(F.col("size") + k % 3, 4)), "")
    entries = {"stts": four(n, F.col("delta")), "ctts": four(n, F.col("shift")), "stsc": four(F.col("chunk"), n, F.lit(1)), "chunks": F.when(far, boxes.number_hex(place, 8)).otherwise(four(place)), "stss": four(F.col("before") + 1), "stsz": sizes}
    listed = placed.groupBy("f", "odd").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("run", *(v.alias(k) for k, v in entries.items())))).alias("e"))
    of = lambda kind: F.transform("e", lambda x: x[kind])
    table = lambda kind, version=0: boxes.table_box(kind, of(kind), version=version)
    sized = boxes.full_box("stsz", _zeros(4), boxes.number(n, 4), F.unhex(F.array_join(of("stsz"), "")))
    video, sound = (f + odd) % 3 > 0, (f + odd) % 3 == 0
    entry = F.when(video, boxes.box("avc1", _zeros(24), boxes.number(16 + f % 100, 2), boxes.number(8 + odd, 2), _zeros(50), boxes.box("avcC", boxes.number(f, 2)))).otherwise(boxes.box("mp4a", _zeros(28)))
    described = boxes.full_box("stsd", boxes.number(F.lit(1), 4), entry)
    duration = F.when(f % 5 == 0, (1 << 32) - 1).otherwise(f * 10)
    wide = f % 2
    identity = F.when((f % 13 == 0) & (odd == 1), 0).otherwise(odd + 1)
    track = boxes.full_box("tkhd", _zeros(8 + 8 * wide), boxes.number(identity, 4), _zeros(8 + 4 * wide + 52), boxes.number((16 + f % 100) * 65536, 4), boxes.number((8 + odd) * 65536, 4), version=wide, flags=7)
    head = F.concat(boxes.full_box("mdhd", _zeros(8), boxes.number(1000 + f, 4), boxes.number(duration, 4), _zeros(4)), boxes.full_box("hdlr", _zeros(4), F.when(sound, F.lit("soun")).otherwise(F.lit("vide")).cast("binary"), _zeros(13)))
    tables = boxes.box("stbl", described, table("stts"), table("ctts", wide), table("stsc"), sized, F.when(far, boxes.table_box("co64", of("chunks"))).otherwise(boxes.table_box("stco", of("chunks"))), table("stss"))
    edits = F.array(F.concat(boxes.number_hex(100 + f, 4), boxes.number_hex(F.lit(-1), 4), four(F.lit(65536))), F.concat(four(1000 + f, f % 7, F.lit(65536))))
    edit = F.when(odd == 0, boxes.box("edts", boxes.table_box("elst", edits))).otherwise(_zeros(0))
    whole = listed.select("f", "odd", F.hex(boxes.box("trak", track, edit, boxes.box("mdia", head, boxes.box("minf", tables)))).alias("trak"))
    movies = whole.groupBy("f").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("odd", "trak"))), lambda x: x["trak"]), "").alias("traks"))
    movie = boxes.full_box("mvhd", _zeros(8), boxes.number(600 + f, 4), boxes.number(f * 3, 4), _zeros(80))
    content = F.concat(boxes.box("ftyp", F.lit("isom").cast("binary")), boxes.box("mdat", _zeros(100)), boxes.box("moov", movie, F.unhex("traks")))
    return movies.select(F.concat(F.lit("part-"), f).alias("path"), content.alias("content"))


_SAMPLES = f"""WITH {_RUNS}, s AS (SELECT *, unnest(range(1, n + 1)) AS k FROM r)
    SELECT {{}}, CAST(row_number() OVER w - 1 AS BIGINT) AS sample_index, CAST(5000 * run + sum(size_ + k % 3) OVER (PARTITION BY run ORDER BY k) - (size_ + k % 3) AS BIGINT) AS "offset", CAST(size_ + k % 3 AS BIGINT) AS size,
           CAST(sum(delta) OVER w - delta AS BIGINT) AS dts, CAST(sum(delta) OVER w - delta + shift AS BIGINT) AS pts, CAST(delta AS BIGINT) AS duration, CAST(1 AS BIGINT) AS description, k = 1 AS sync
    FROM s WINDOW w AS (PARTITION BY f, odd ORDER BY run, k)"""


@query("a6_samples_of_files", _SAMPLES.format("'part-' || f AS path, CAST(track AS INTEGER) AS track"))
def samples_of_files(spark, sf_dir):
    """All sample tables of the files, read from their bytes and fused (A6, B2-B5, B7-B10, B18 within)."""
    found = tracks.samples_of_files(movie_files(spark, sf_dir))
    return found.select("path", F.col("track").cast("int").alias("track"), *(F.col(c).cast("long").alias(c) for c in ("sample_index", "offset", "size", "dts", "pts", "duration", "description")), "sync")


@query("b1_sample_table_fusion", _SAMPLES.format("f, odd"))
def sample_table_fusion(spark, sf_dir):
    """The same tables as columns, by file and track."""
    r = _file_runs(spark, sf_dir)
    key = ["f", "odd"]
    w = Window.partitionBy(*key).orderBy("run")
    numbered = r.withColumns({"chunk": F.row_number().over(w), "first": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    each = numbered.select(*key, "first", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    fused = runs.fuse_sample_tables(
        r.select(*key, "run", F.col("n").alias("count"), "delta"), r.select(*key, "run", F.col("n").alias("count"), "shift"), numbered.select(*key, "chunk", (5000 * F.col("run")).alias("chunk_offset")),
        numbered.select(*key, F.col("chunk").alias("first_chunk"), F.col("n").alias("samples_per_chunk"), F.lit(1).alias("description")),
        each.select(*key, (F.col("first") + F.col("k") - 1).alias("sample_index"), (F.col("size") + F.col("k") % 3).alias("size")), numbered.select(*key, (F.col("first") + 1).alias("sample_number")), key,
    )
    return fused.select(*key, *(F.col(c).cast("long").alias(c) for c in ("sample_index", "offset", "size", "dts", "pts", "duration", "description")), "sync")


@query(
    "b16_edit_lists",
    f"WITH {_RUNS} SELECT 'part-' || f AS path, CAST(track AS INTEGER) AS track, CAST(ordinal AS BIGINT) AS ordinal, CAST(CASE ordinal WHEN 0 THEN 100 + f ELSE 1000 + f END AS BIGINT) AS segment_duration, CAST(CASE ordinal WHEN 0 THEN -1 ELSE f % 7 END AS BIGINT) AS media_time, "
    "CAST(1 AS BIGINT) AS rate_int, CAST(0 AS BIGINT) AS rate_fraction, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT f, track, odd FROM r), range(2) t(ordinal) WHERE odd = 0",
)
def edit_lists(spark, sf_dir):
    found = tracks.edit_lists(movie_files(spark, sf_dir))
    return found.select("path", F.col("track").cast("int").alias("track"), *(F.col(c).cast("long").alias(c) for c in ("ordinal", "segment_duration", "media_time", "rate_int", "rate_fraction")), "error")


_TRACKS = f"{_RUNS}, k AS (SELECT DISTINCT f, odd, track, (f + odd) % 3 > 0 AS video FROM r)"


@query(
    "b18_track_headers",
    f"""WITH {_TRACKS}, e AS (SELECT *, CASE WHEN f % 13 = 0 AND odd = 1 THEN 'invalid: track id is zero' END AS error FROM k)
    SELECT 'part-' || f AS path, CAST(track AS INTEGER) AS track, CASE WHEN error IS NULL THEN odd + 1 END AS id, CASE WHEN error IS NULL THEN CAST(7 AS BIGINT) END AS flags, CASE WHEN error IS NULL THEN (16 + f % 100) * 65536 END AS width,
           CASE WHEN error IS NULL THEN (8 + odd) * 65536 END AS height, CASE WHEN error IS NULL THEN 1000 + f END AS timescale, CASE WHEN error IS NULL AND f % 5 > 0 THEN f * 10 END AS duration,
           CASE WHEN error IS NULL THEN CASE WHEN video THEN 'vide' ELSE 'soun' END END AS handler, CASE WHEN error IS NULL THEN CASE WHEN video THEN 'Video' ELSE 'Audio' END END AS kind, error FROM e""",
)
def track_headers(spark, sf_dir):
    found = headers.track_header_fields(written(mp4.parsed(movie_files(spark, sf_dir), ["tkhd", "mdhd", "hdlr"])))
    return found.withColumn("track", F.col("track").cast("int"))


@query("b18_movie_headers", f"SELECT DISTINCT 'part-' || (p_partkey // {FILE_KEYS}) AS path, 600 + p_partkey // {FILE_KEYS} AS timescale, 3 * (p_partkey // {FILE_KEYS}) AS duration, CAST(NULL AS VARCHAR) AS error FROM part")
def movie_headers(spark, sf_dir):
    return headers.movie_headers(movie_files(spark, sf_dir))


@query("c3_first_video_track", f"WITH {_TRACKS} SELECT 'part-' || f AS path, CAST(min(track) AS INTEGER) AS track FROM k WHERE video GROUP BY f")
def first_video_track(spark, sf_dir):
    files = written(mp4.parsed(movie_files(spark, sf_dir), ["hdlr", "mdhd", "stsz"]))
    return tracks.first_video_track(tracks.track_headers(files), tracks.sample_sizes(files)).withColumn("track", F.col("track").cast("int"))


@query(
    "b19_sample_descriptions",
    f"""WITH {_TRACKS} SELECT 'part-' || f AS path, CAST(track AS INTEGER) AS track, CAST(0 AS BIGINT) AS ordinal, CASE WHEN video THEN 'avc1' ELSE 'mp4a' END AS format, CASE WHEN video THEN 16 + f % 100 END AS width, CASE WHEN video THEN 8 + odd END AS height,
    CASE WHEN video THEN printf('%04X', f) END AS configuration, CAST(NULL AS BIGINT) AS profile, CAST(NULL AS BIGINT) AS level, CAST(NULL AS BIGINT) AS bit_depth, CAST(NULL AS VARCHAR) AS error FROM k""",
)
def sample_descriptions(spark, sf_dir):
    files = written(mp4.parsed(movie_files(spark, sf_dir), ["stsd", "avcC", "vpcC", *tracks.VIDEO_ENTRIES]))
    found = tracks.sample_descriptions(files)
    return found.withColumns({"track": F.col("track").cast("int"), **{c: F.col(c).cast("long") for c in ("ordinal", "width", "height", "profile", "level", "bit_depth")}})


@query(
    "b6_compact_sizes",
    """WITH k AS (SELECT o_orderkey AS o, o_custkey AS c FROM orders)
    SELECT o AS id, CAST(4 AS INTEGER) AS bits, CAST(i AS BIGINT) AS sample_index, CAST(substr(lpad(CAST(o AS VARCHAR), 10, '0'), CAST(i + 1 AS INTEGER), 1) AS BIGINT) AS size FROM k, range(9) t(i) WHERE o % 3 = 0
    UNION ALL SELECT o, 8, i, CASE i WHEN 0 THEN o % 256 ELSE c % 256 END FROM k, range(2) t(i) WHERE o % 3 = 1
    UNION ALL SELECT o, 16, i, CASE i WHEN 0 THEN o % 65536 ELSE c % 65536 END FROM k, range(2) t(i) WHERE o % 3 = 2""",
)
def compact_sizes(spark, sf_dir):
    """Digits of order keys as sizes of four bits, an odd number of them, and keys as sizes of one or two bytes."""
    o, c = F.col("o"), F.col("c")
    kind = o % 3
    data = F.when(kind == 0, F.unhex(F.lpad(o.cast("string"), 10, "0"))).when(kind == 1, F.concat(boxes.number(o, 1), boxes.number(c, 1))).otherwise(F.concat(boxes.number(o, 2), boxes.number(c, 2)))
    rows = _orders(spark, sf_dir).select(o.alias("id"), data.alias("data"), F.when(kind == 0, 4).when(kind == 1, 8).otherwise(16).alias("bits"), F.when(kind == 0, 9).otherwise(2).cast("long").alias("n"))
    return tracks.compact_sizes(rows, "data", "bits", "n").select("id", "bits", "sample_index", "size")


_UNITS = "SELECT id, CAST(unit AS INTEGER) AS unit, CAST(stream_offset AS BIGINT) AS stream_offset, upper(data) AS data, error FROM"


@query(
    "a7_byte_stream_units",
    f"""WITH k AS (SELECT o_orderkey AS id, '67' || hex(CAST(o_orderkey AS VARCHAR)) AS a, '68' || hex(CAST(o_custkey AS VARCHAR)) AS b, o_orderkey % 4 AS z FROM orders)
    {_UNITS} (
      SELECT id, 0 AS unit, z + 3 AS stream_offset, a AS data, NULL AS error FROM k WHERE id % 11 > 0 UNION ALL
      SELECT id, 1, z + 3 + len(a) // 2 + z + 3, b, NULL FROM k WHERE id % 11 > 1 UNION ALL
      SELECT id, 1, z + 3 + len(a) // 2 + z + 3, '', 'invalid: empty unit' FROM k WHERE id % 11 = 1 UNION ALL
      SELECT id, 0, 0, '', 'invalid: no start code' FROM k WHERE id % 11 = 0)""",
)
def byte_stream_units(spark, sf_dir):
    """Digits of keys as units behind start codes with up to three more zeros; some streams have a gap, some no code."""
    o, c = F.col("o"), F.col("c")
    code = F.concat(_zeros(o % 4), F.unhex(F.lit("000001")))
    a, b = F.concat(F.unhex(F.lit("67")), o.cast("string").cast("binary")), F.concat(F.unhex(F.lit("68")), c.cast("string").cast("binary"))
    data = F.when(o % 11 == 0, a).when(o % 11 == 1, F.concat(code, a, code, code, b)).otherwise(F.concat(code, a, code, b, _zeros(o % 4)))
    return bitstreams.split_packets(_orders(spark, sf_dir).select(o.alias("id"), data.alias("data")), bitstreams.start_code_units).selectExpr("id", "unit", "stream_offset", "hex(data) as data", "error")


@query(
    "a8_prefixed_units",
    f"""WITH k AS (SELECT o_orderkey AS id, hex(CAST(o_orderkey AS VARCHAR)) AS a, hex(CAST(o_custkey AS VARCHAR)) AS b FROM orders)
    {_UNITS} (
      SELECT id, 0 AS unit, 4 AS stream_offset, a AS data, NULL AS error FROM k UNION ALL
      SELECT id, 1, CASE WHEN id % 5 = 0 THEN 4 + len(a) // 2 ELSE 8 + len(a) // 2 END, CASE WHEN id % 5 = 0 THEN '' ELSE b END, CASE WHEN id % 5 = 0 THEN 'invalid: bad length' END FROM k)""",
)
def prefixed_units(spark, sf_dir):
    """Digits of keys behind their length in four bytes; in every fifth packet the second length is one too many."""
    o, c = F.col("o"), F.col("c")
    a, b = o.cast("string").cast("binary"), c.cast("string").cast("binary")
    data = F.concat(boxes.number(F.length(a), 4), a, boxes.number(F.length(b) + F.when(o % 5 == 0, 1).otherwise(0), 4), b)
    packets = _orders(spark, sf_dir).select(o.alias("id"), data.alias("data"))
    return bitstreams.split_packets(packets, lambda packet: bitstreams.prefixed_units(packet, 4)).selectExpr("id", "unit", "stream_offset", "hex(data) as data", "error")


@query(
    "a9_configuration_sets",
    f"""WITH k AS (SELECT o_orderkey AS id, '67' || hex(CAST(o_orderkey AS VARCHAR)) AS a, '68' || hex(CAST(o_custkey AS VARCHAR)) AS b FROM orders)
    SELECT u.*, CAST(CASE WHEN id % 6 <> 1 THEN 1 + id % 4 END AS INTEGER) AS length_size FROM ({_UNITS} (
      SELECT id, 0 AS unit, 8 AS stream_offset, a AS data, NULL AS error FROM k WHERE id % 6 > 2 UNION ALL
      SELECT id, 1, 11 + len(a) // 2, b, NULL FROM k WHERE id % 6 > 2 UNION ALL
      SELECT id, 0, 0, '', 'invalid: bad configuration header' FROM k WHERE id % 6 = 1 UNION ALL
      SELECT id, 0, 6, '', 'invalid: bad parameter set' FROM k WHERE id % 6 = 2 UNION ALL
      SELECT id, 0, 8 + len(a) // 2, '', 'invalid: no parameter sets' FROM k WHERE id % 6 = 0)) u""",
)
def configuration_sets(spark, sf_dir):
    """Digits of keys as the parameter sets of decoder configurations, some cut, of a wrong kind or without pictures' sets."""
    o, c = F.col("o"), F.col("c")
    kind = F.when(o % 6 == 2, F.unhex(F.lit("66"))).otherwise(F.unhex(F.lit("67")))
    a, b = F.concat(kind, o.cast("string").cast("binary")), F.concat(F.unhex(F.lit("68")), c.cast("string").cast("binary"))
    head = F.concat(F.unhex(F.lit("01640028")), boxes.number(F.lit(0xFC) + o % 4, 1), F.unhex(F.lit("E1")))
    record = F.when(o % 6 == 1, F.unhex(F.lit("010203"))).when(o % 6 == 0, F.concat(head, boxes.number(F.length(a), 2), a, _zeros(1))).otherwise(F.concat(head, boxes.number(F.length(a), 2), a, F.unhex(F.lit("01")), boxes.number(F.length(b), 2), b))
    rows = _orders(spark, sf_dir).select(o.alias("id"), record.alias("data"))
    sets = bitstreams.split_packets(rows, bitstreams.configuration_sets).selectExpr("id", "unit", "stream_offset", "hex(data) as data", "error")
    return sets.join(rows.select("id", scalars.unit_length_size(F.col("data")).alias("length_size")), "id")


@query(
    "a10_superframes",
    """WITH k AS (SELECT o_orderkey AS id, 1 + o_orderkey % 300 AS a, 1 + o_custkey % 50 AS b, CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS more FROM orders)
    SELECT id, CAST(unit AS INTEGER) AS unit, stream_offset, CAST(length AS INTEGER) AS length, error FROM (
    SELECT id, 0 AS unit, CAST(0 AS BIGINT) AS stream_offset, a + b AS length, CAST(NULL AS VARCHAR) AS error FROM k WHERE id % 4 = 0
    UNION ALL SELECT id, 0, 0, a, NULL FROM k WHERE id % 4 = 1 UNION ALL SELECT id, 1, a, b, NULL FROM k WHERE id % 4 = 1
    UNION ALL SELECT id, 0, 0, 0, CASE id % 4 WHEN 2 THEN 'invalid: bad index' ELSE 'invalid: sizes do not cover the payload' END FROM k WHERE id % 4 > 1)""",
)
def superframes(spark, sf_dir):
    """Packets of two frames with an index of two-byte sizes; some have none, a spoilt one, or a byte too many."""
    o = F.col("o")
    a, b = 1 + o % 300, 1 + F.col("c") % 50
    little = lambda n: F.concat(boxes.number(n % 256, 1), boxes.number(F.shiftright(n, 8), 1))
    body = F.concat(F.unhex(F.repeat(F.lit("11"), (a + b).cast("int"))), _zeros(F.when(o % 4 == 3, 1).otherwise(0)))
    index = F.concat(F.unhex(F.when(o % 4 == 2, "CA").otherwise("C9")), little(a), little(b), F.unhex(F.lit("C9")))
    packets = _orders(spark, sf_dir).select(o.alias("id"), F.when(o % 4 == 0, body).otherwise(F.concat(body, index)).alias("data"))
    return bitstreams.split_packets(packets, bitstreams.superframe).selectExpr("id", "unit", "stream_offset", "length(data) as length", "error")


@query(
    "b20_audio_configurations",
    f"""WITH k AS (SELECT event_id AS i, 1 + event_id % 3 AS kind, event_id // 3 % 16 AS at_, event_id % 4 AS channels, {audio.RATES}[event_id // 3 % 16 + 1] AS rate FROM events),
    g AS (SELECT *, CASE WHEN at_ = 15 THEN CASE WHEN i % 5 > 0 THEN i END ELSE rate END AS real_ FROM k)
    SELECT i, CASE WHEN ok THEN CAST(real_ AS INTEGER) END AS rate, CASE WHEN ok THEN CAST(channels AS INTEGER) END AS channels FROM (SELECT *, coalesce(kind = 2 AND real_ > 0 AND channels IN (1, 2), false) AS ok FROM g)""",
)
def audio_configurations(spark, sf_dir):
    """Object type, rate index and channels packed in two bytes, or five with a rate of its own, from the number of an event."""
    i = F.col("event_id").cast("long")
    kind, at, channels = 1 + i % 3, F.call_function("div", i, F.lit(3)) % 16, i % 4
    short = boxes.number(F.shiftleft(kind, 11) + F.shiftleft(at, 7) + F.shiftleft(channels, 3), 2)
    long = boxes.number(F.shiftleft(kind, 35) + F.shiftleft(at, 31) + F.shiftleft(i, 7) + F.shiftleft(channels, 3), 5)
    data = F.when((at == 15) & (i % 5 > 0), long).otherwise(F.when(at == 15, F.substring(short, 1, 1)).otherwise(short))
    rows = _table(spark, sf_dir, "events").select(i.alias("i"), audio.audio_config(data).alias("c"))
    return rows.select("i", "c.rate", "c.channels")


@query(
    "i3_parse_seconds",
    """WITH k AS (SELECT o_orderkey AS o, o_custkey AS c FROM orders)
    SELECT o AS i, CASE WHEN o % 9 < 4 THEN c * 1000 + o % 1000 WHEN o % 9 = 4 THEN c END AS value, CAST(CASE WHEN o % 9 < 4 THEN 1000 WHEN o % 9 = 4 THEN 1 END AS BIGINT) AS timescale FROM k""",
)
def parse_seconds(spark, sf_dir):
    """Keys as decimal seconds; some with a line feed behind, a sign, no digit before the point, ten digits behind it, or too great."""
    o, whole, part = F.col("o"), F.col("c").cast("string"), F.lpad((F.col("o") % 1000).cast("string"), 3, "0")
    text = (
        F.when(o % 9 < 4, F.concat(whole, F.lit("."), part)).when(o % 9 == 4, F.concat(whole, F.lit("."))).when(o % 9 == 5, F.concat(whole, F.lit("."), part, F.lit("\n"))).when(o % 9 == 6, F.concat(F.lit("-"), whole))
        .when(o % 9 == 7, F.concat(F.lit("."), part)).otherwise(F.concat(F.lit("9223372036854775807"), F.lit("."), part))
    )
    rows = _orders(spark, sf_dir).select(o.alias("i"), media.parse_seconds(text).alias("t"))
    return rows.select("i", "t.value", "t.timescale")


@query(
    "i19_content_ranges",
    """WITH k AS (SELECT o_orderkey AS o, o_custkey AS a, o_custkey + o_orderkey % 7 - 1 AS b, o_custkey + 5 AS n FROM orders),
    g AS (SELECT *, CASE WHEN o % 5 < 3 AND a <= b AND (o % 5 = 2 OR b < n) THEN true ELSE false END AS ok FROM k)
    SELECT o AS i, CASE WHEN ok THEN a END AS first, CASE WHEN ok THEN b END AS last, CASE WHEN ok AND o % 5 < 2 THEN n END AS total FROM g""",
)
def content_ranges(spark, sf_dir):
    """Ranges of keys with a total, without one, with a line feed behind, or of another unit."""
    o, a = F.col("o"), F.col("c")
    text = lambda unit, total, end: F.concat(F.lit(f"{unit} "), a.cast("string"), F.lit("-"), (a + o % 7 - 1).cast("string"), F.lit("/"), total, F.lit(end))
    total = (a + 5).cast("string")
    header = F.when(o % 5 < 2, text("bytes", total, "")).when(o % 5 == 2, text("bytes", F.lit("*"), "")).when(o % 5 == 3, text("bytes", total, "\n")).otherwise(text("items", total, ""))
    return _orders(spark, sf_dir).select(o.alias("i"), scalars.content_range(header).alias("r")).select("i", "r.first", "r.last", "r.total")


@query(
    "m2_companded_samples",
    """WITH k AS (SELECT event_id AS i, CAST(event_id * 31 % 256 AS INTEGER) AS code FROM events), b AS (SELECT *, xor(code, 255) AS u, xor(code, 85) AS a FROM k)
    SELECT i, code, (CASE WHEN u >= 128 THEN -1 ELSE 1 END) * ((2 * (u & 15) + 33) * pow(2.0, (u >> 4) & 7) - 33) * 4 / 32768.0 AS mu,
           (CASE WHEN a >= 128 THEN 1 ELSE -1 END) * (CASE WHEN (a >> 4) & 7 = 0 THEN (2 * (a & 15) + 1) * 8.0 ELSE (2 * (a & 15) + 33) * pow(2.0, ((a >> 4) & 7) - 1) * 8 END) / 32768.0 AS a_law FROM b""",
)
def companded_samples(spark, sf_dir):
    codes = _events(spark, sf_dir, "cast(event_id * 31 % 256 as int) as code")
    return codes.select("i", "code", audio.mu_law(F.col("code")).alias("mu"), audio.a_law(F.col("code")).alias("a_law"))


def _descriptor(tag: int, body, width, more=0):
    """A descriptor whose length takes ``width`` bytes and says ``more`` than the body has."""

    def made(b):
        digit = lambda k: F.shiftright(F.length(b) + more, 7 * k).bitwiseAND(127)
        parts = [F.when(width > k, boxes.number(digit(k) + (128 if k else 0), 1)).otherwise(_zeros(0)) for k in (3, 2, 1, 0)]
        return F.concat(boxes.number(F.lit(tag), 1), *parts, b)

    return boxes.let(body, made)


def _stream_descriptors(o, c):
    """A stream descriptor box made of two keys: lengths of one to four bytes, optional fields, a stranger before the decoder's part, and faults."""
    width, fault = 1 + o % 4, o % 13
    own = F.concat(boxes.number(F.lit(0x1190), 2), boxes.number(c, 2))
    specific = F.when(fault == 1, _descriptor(6, own, width)).when(fault == 2, _descriptor(5, _zeros(0), width)).otherwise(_descriptor(5, own, width, F.when(fault == 3, 1).otherwise(0)))
    decoder = F.concat(F.when(fault == 4, F.unhex(F.lit("41"))).otherwise(F.unhex(F.lit("40"))), F.when(fault == 5, F.unhex(F.lit("11"))).otherwise(F.unhex(F.lit("15"))), _zeros(11), specific)
    inner = F.concat(F.when(o % 5 == 0, _descriptor(9, own, width)).otherwise(_zeros(0)), F.when(fault == 6, _zeros(0)).otherwise(_descriptor(4, decoder, width)))
    fields = F.concat(F.when(o % 2 == 1, boxes.number(c, 2)).otherwise(_zeros(0)), F.when(o % 3 == 1, F.concat(boxes.number(c % 6, 1), _zeros(c % 6))).otherwise(_zeros(0)), F.when(o % 7 == 1, _zeros(2)).otherwise(_zeros(0)))
    flags = F.when(o % 2 == 1, 0x80).otherwise(0) + F.when(o % 3 == 1, 0x40).otherwise(0) + F.when(o % 7 == 1, 0x20).otherwise(0)
    body = F.concat(boxes.number(o, 2), boxes.number(flags, 1), fields, inner)
    whole = F.when(fault == 7, F.concat(_descriptor(3, body, width), _zeros(1))).when(fault == 8, F.concat(F.unhex(F.lit("0380808080")), body)).when(fault == 9, F.unhex(F.lit("0381"))).otherwise(_descriptor(3, body, width, F.when(fault == 10, 3).otherwise(0)))
    return F.concat(boxes.number(F.when(fault == 11, 1).otherwise(0), 4), whole)


_DESCRIPTOR_ERRORS = """CASE o_orderkey % 13 WHEN 1 THEN 'invalid: no specific configuration' WHEN 2 THEN 'invalid: empty specific configuration' WHEN 3 THEN 'invalid: truncated body' WHEN 4 THEN 'unsupported: object type' WHEN 5 THEN 'invalid: no audio stream'
      WHEN 6 THEN 'invalid: no decoder configuration' WHEN 7 THEN 'invalid: not one whole stream descriptor' WHEN 8 THEN 'invalid: length is over four bytes' WHEN 9 THEN 'invalid: truncated length' WHEN 10 THEN 'invalid: truncated body' WHEN 11 THEN 'invalid: version or flags' END"""


@query("b21_descriptors", f"SELECT i, CASE WHEN error IS NULL THEN '1190' || printf('%04X', c % 65536) END AS config, error FROM (SELECT o_orderkey AS i, o_custkey AS c, {_DESCRIPTOR_ERRORS} AS error FROM orders)")
def specific_configs(spark, sf_dir):
    rows = _orders(spark, sf_dir).select(F.col("o").alias("i"), _stream_descriptors(F.col("o"), F.col("c")).alias("payload"))
    return descriptors.with_specific_config(rows, "payload").select("i", F.hex("config").alias("config"), F.col("config_error").alias("error"))


@query(
    "b19_audio_entries",
    f"""WITH k AS (SELECT o_orderkey AS o, o_custkey AS c, {_DESCRIPTOR_ERRORS} AS inner_ FROM orders),
    e AS (SELECT *, CASE o % 17 WHEN 1 THEN 'unsupported: version of the entry' WHEN 2 THEN 'invalid: no channels' WHEN 3 THEN 'unsupported: rate is not whole' WHEN 4 THEN 'invalid: rate is zero' WHEN 5 THEN 'invalid: no esds box' WHEN 6 THEN 'invalid: more than one esds box'
      ELSE coalesce(inner_, CASE o % 17 WHEN 7 THEN 'invalid: rates differ' WHEN 8 THEN 'invalid: channels differ' END) END AS error FROM k)
    SELECT 'o' || o AS path, CAST(0 AS INTEGER) AS track, CAST(0 AS BIGINT) AS ordinal, CASE WHEN error IS NULL THEN CAST(2 AS BIGINT) END AS channels, CASE WHEN error IS NULL THEN CAST(16 AS BIGINT) END AS sample_bits, CASE WHEN error IS NULL THEN CAST(48000 AS BIGINT) END AS rate,
           CASE WHEN error IS NULL THEN '1190' || printf('%04X', c % 65536) END AS configuration, error FROM e""",
)
def audio_entries(spark, sf_dir):
    """Every order as a file with one audio entry, faulty in one way or another."""
    o, c = F.col("o"), F.col("c")
    case = o % 17
    esds = boxes.box("esds", _stream_descriptors(o, c))
    rate = F.when(case == 3, 48000 * 65536 + 1).when(case == 4, 0).when(case == 7, 44100 * 65536).otherwise(48000 * 65536)
    head = F.concat(_zeros(8), boxes.number(F.when(case == 1, 1).otherwise(0), 2), _zeros(6), boxes.number(F.when(case == 2, 0).when(case == 8, 1).otherwise(2), 2), boxes.number(F.lit(16), 2), _zeros(4), boxes.number(rate, 4))
    entry = boxes.box("mp4a", head, F.when(case == 5, _zeros(0)).when(case == 6, F.concat(esds, esds)).otherwise(esds))
    content = boxes.full_box("stsd", boxes.number(F.lit(1), 4), entry)
    content = boxes.nested(content, "stbl", "minf", "mdia", "trak", "moov")
    found = descriptors.audio_entries(_orders(spark, sf_dir).select(F.concat(F.lit("o"), o).alias("path"), content.alias("content")))
    return found.withColumns({"track": F.col("track").cast("int"), **{k: F.col(k).cast("long") for k in ("channels", "sample_bits", "rate")}})


_FORMATS = ["nv12", "p010", "bgra8", "rgba8", "i420", "i422", "i440", "i444", "other"]
_VISIBLE_SQL = f"""WITH e AS (SELECT event_id AS i, {_FORMATS}[event_id % 9 + 1] AS format, event_id // 9 % 3 AS plane, event_id % 3 AS x, event_id // 3 % 3 AS y, 2 + event_id // 5 % 4 AS w, 2 + event_id // 7 % 3 AS h, event_id AS seed FROM events),
    b AS (SELECT *, CASE format WHEN 'p010' THEN 2 WHEN 'bgra8' THEN 4 WHEN 'rgba8' THEN 4 ELSE 1 END AS unit, CASE WHEN format IN ('i420', 'i422') THEN 1 ELSE 0 END AS across, CASE WHEN format IN ('i420', 'i440') THEN 1 ELSE 0 END AS down FROM e),
    l AS (SELECT *, CASE WHEN format = 'other' THEN false WHEN plane = 0 THEN true WHEN format IN ('nv12', 'p010') THEN plane = 1 AND x % 2 + y % 2 + w % 2 + h % 2 = 0
                         WHEN format IN ('bgra8', 'rgba8') THEN false ELSE (across = 0 OR x % 2 + w % 2 = 0) AND (down = 0 OR y % 2 + h % 2 = 0) END AS ok,
                  plane > 0 AND format IN ('nv12', 'p010') AS pairs FROM b),
    g AS (SELECT *, CASE WHEN plane > 0 AND (pairs OR down = 1) THEN y // 2 ELSE y END AS first_row, CASE WHEN plane > 0 AND (pairs OR down = 1) THEN h // 2 ELSE h END AS rows_,
                  unit * CASE WHEN plane > 0 AND across = 1 THEN x // 2 ELSE x END AS byte_offset, unit * CASE WHEN plane > 0 AND across = 1 THEN w // 2 ELSE w END AS row_bytes FROM l)
    SELECT i, format, plane, CASE WHEN ok THEN first_row END AS first_row, CASE WHEN ok THEN byte_offset END AS byte_offset, CASE WHEN ok THEN row_bytes END AS row_bytes, CASE WHEN ok THEN rows_ END AS rows,
           CASE WHEN ok THEN upper(array_to_string(flatten(list_transform(range(first_row, first_row + rows_), lambda r: list_transform(range(byte_offset, byte_offset + row_bytes), lambda k: printf('%02x', (seed + 40 * r + k) % 256)))), '')) END AS visible FROM g"""


@query("a11_visible_rows", _VISIBLE_SQL)
def visible_rows(spark, sf_dir):
    """Planes whose bytes count on from the number of an event, cut to their visible rectangle."""
    i = F.col("event_id").cast("long")
    div = lambda n: F.call_function("div", i, F.lit(n))
    format_ = F.element_at(F.array(*map(F.lit, _FORMATS)), (i % 9 + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select(i.alias("i"), format_.alias("format"), (div(9) % 3).alias("plane"), (i % 3).alias("x"), (div(3) % 3).alias("y"), (2 + div(5) % 4).alias("w"), (2 + div(7) % 3).alias("h"))
    counted = F.lit(bytearray(k % 256 for k in range(256 + 40 * 8)))
    bytes_ = F.substring(counted, (F.pmod(F.col("i"), F.lit(256)) + 1).cast("int"), F.lit(40 * 8))
    planes = rows.withColumns({"data": F.concat(_zeros(3), bytes_), "at": raw_files.plane_layout(*map(F.col, ("format", "plane", "x", "y", "w", "h")))})
    shown = planes.withColumn("visible", raw_files.visible_rows("data", F.lit(3).cast("long"), F.lit(40).cast("long"), "at"))
    return shown.select("i", "format", "plane", "at.*", F.hex("visible").alias("visible"))


_FRAGMENTS_SQL = """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CASE WHEN row_number() OVER w <= 2 THEN 0 ELSE 1 END AS part, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
    h AS (
      SELECT *, 1 + o % 2 AS track_id, (rn - 1) - 2 * part AS k, CASE WHEN part = 0 THEN o % 2 = 0 ELSE true END AS has_d, CASE WHEN part = 0 THEN o % 3 > 0 ELSE true END AS has_s,
        CASE WHEN o % 10 > 0 THEN 1 + o % 2 WHEN o % 2 = 0 THEN 3 END AS description,
        CASE WHEN o % 7 > 0 THEN 5 + o % 4 WHEN o % 2 = 0 THEN 7 END AS dd, CASE WHEN o % 6 > 2 THEN 50 WHEN o % 2 = 0 THEN 9 END AS ds, CASE WHEN o % 9 > 0 THEN 65536 * (o % 2) WHEN o % 2 = 0 THEN 65536 END AS df FROM l),
    f AS (
      SELECT *, CASE WHEN has_d THEN p % 9 ELSE dd END AS duration, CASE WHEN has_s THEN 1 + s % 40 ELSE ds END AS size, CASE WHEN part = 0 AND o % 5 = 0 THEN 65536 * (n % 2) WHEN part = 0 AND o % 5 = 1 AND k = 0 THEN 0 ELSE df END AS flags,
        CASE WHEN part = 0 AND o % 4 = 0 THEN p % 7 - CASE WHEN o % 8 = 4 THEN 3 ELSE 0 END ELSE 0 END AS shift,
        CASE WHEN description IS NULL THEN 'invalid: no description' WHEN part = 0 AND o % 17 = 3 THEN 'invalid: length differs from count' END AS fault FROM h),
    e AS (SELECT *, CASE WHEN coalesce(duration <= 0, true) THEN 'invalid: sample has no duration' WHEN coalesce(size <= 0, true) THEN 'invalid: sample has no size' WHEN flags IS NULL THEN 'invalid: sample has no flags' END AS error FROM f WHERE fault IS NULL),
    t AS (
      SELECT *, count(*) FILTER (WHERE coalesce(duration <= 0 OR size <= 0, true)) OVER fr > 0 AS off_lost, coalesce(sum(CASE WHEN coalesce(duration > 0 AND size > 0, false) THEN size END) OVER (PARTITION BY o, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        count(*) FILTER (WHERE error IS NOT NULL) OVER fi > 0 AS time_lost, coalesce(sum(duration) OVER (PARTITION BY o ORDER BY part, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, min(part) OVER (PARTITION BY o) AS first_part FROM e
      WINDOW fr AS (PARTITION BY o, part ORDER BY k), fi AS (PARTITION BY o ORDER BY part, k))
    SELECT 'o' || o AS path, track_id, CAST(part AS BIGINT) AS part, CAST(0 AS BIGINT) AS run, CAST(k AS BIGINT) AS k,
      CAST(CASE WHEN NOT off_lost THEN before + CASE WHEN part = 1 THEN o * 2000 + 7 ELSE CASE WHEN o % 3 = 1 THEN 60 ELSE o * 1000 END + 100 - 3 * (o % 2) END END AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size,
      CAST(CASE WHEN NOT time_lost THEN spent + CASE WHEN first_part = 0 AND o % 11 > 0 THEN o * 10 ELSE 0 END END AS BIGINT) AS dts, CAST(CASE WHEN NOT time_lost THEN spent + shift + CASE WHEN first_part = 0 AND o % 11 > 0 THEN o * 10 ELSE 0 END END AS BIGINT) AS pts,
      CAST(duration AS BIGINT) AS duration, CAST(description AS BIGINT) AS description, flags & 65536 = 0 AS sync, error FROM t
    UNION ALL SELECT DISTINCT 'o' || o, track_id, part, CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(NULL AS BOOLEAN), fault FROM f WHERE fault IS NOT NULL"""


@query("b14_fragments_of_files", _FRAGMENTS_SQL)
def fragments_of_files(spark, sf_dir):
    """Orders as files of one or two fragments whose flags leave out one field or another, their lines as samples (B11-B15 from bytes)."""
    lines = _table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as bigint) o", "cast(l_linenumber as bigint) n", "cast(l_partkey as bigint) p", "cast(l_suppkey as bigint) s")
    o, n, p, s = map(F.col, "onps")
    four = lambda value: boxes.number_hex(value, 4)
    only = lambda condition, value: F.when(condition, value).otherwise(F.lit(""))
    duration, size = four(p % 9), four(1 + s % 40)
    signed = o % 8 == 4
    early = F.concat(only(o % 2 == 0, duration), only(o % 3 > 0, size), only(o % 5 == 0, four(65536 * (n % 2))), only(o % 4 == 0, four(p % 7 - F.when(signed, 3).otherwise(0))))
    # Each line has the bytes for either fragment; the first line of an order takes those of all, in their order.
    entries = lines.select(*"onps", early.alias("early"), F.concat(duration, size).alias("later"))
    w = Window.partitionBy("o").orderBy(*"nps")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    orders = entries.select("o", F.row_number().over(w).alias("line"), F.collect_list(F.struct("early", "later")).over(whole).alias("e")).where("line = 1")
    rest = F.greatest(F.size("e") - 2, F.lit(0))
    cut = orders.select("o", F.least(F.size("e"), F.lit(2)).alias("n_first"), rest.alias("n_second"), F.array_join(F.slice("e", 1, 2)["early"], "").alias("first"), F.array_join(F.slice("e", 3, rest)["later"], "").alias("second"))
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    header_bits = bit(o % 10 > 0, 0x2) + bit(o % 7 > 0, 0x8) + bit(o % 6 > 2, 0x10) + bit(o % 9 > 0, 0x20)
    fields = F.concat(only(o % 10 > 0, four(1 + o % 2)), only(o % 7 > 0, four(5 + o % 4)), only(o % 6 > 2, four(F.lit(50))), only(o % 9 > 0, four(65536 * (o % 2))))
    moof_based, has_more = o % 3 == 1, F.col("n_second") > 0
    header = lambda bits, base: F.unhex(F.concat(four(F.col("bits") + bits), four(1 + o % 2), base, F.col("fields")))
    short = (o % 2 == 0) & (o * 10 < 1 << 32)
    time = F.when(o % 11 == 0, "").when(short, F.concat(F.lit("0000001074666474" "00000000"), four(o * 10))).otherwise(F.concat(F.lit("0000001474666474" "01000000"), boxes.number_hex(o * 10, 8)))
    run_bits = 1 + bit(o % 5 == 1, 4) + bit(o % 2 == 0, 0x100) + bit(o % 3 > 0, 0x200) + bit(o % 5 == 0, 0x400) + bit(o % 4 == 0, 0x800)
    run = F.unhex(F.concat(four(bit(signed, 1 << 24) + run_bits), four(F.col("n_first")), four(100 - 3 * (o % 2)), only(o % 5 == 1, "00000000"), "first", only(o % 17 == 3, "00")))
    later = F.unhex(F.concat(four(F.lit(0x301)), four(F.col("n_second")), four(F.lit(7)), "second"))
    # Each step frames columns of the one before, so that no expression holds a body and its length twice.
    bodies = cut.withColumns({"bits": header_bits, "fields": fields}).select("o", F.unhex(time).alias("time"), run.alias("run"), header(F.when(moof_based, 0x20000).otherwise(1), only(~moof_based, boxes.number_hex(o * 1000, 8))).alias("head"), F.when(has_more, later).alias("later"), F.when(has_more, header(F.lit(1), boxes.number_hex(o * 2000, 8))).alias("later_head"))
    trafs = bodies.select("o", F.concat(boxes.flat_box("tfhd", F.col("head")), "time", boxes.flat_box("trun", F.col("run"))).alias("one"), F.concat(boxes.flat_box("tfhd", F.col("later_head")), boxes.flat_box("trun", F.col("later"))).alias("two"))
    framed = trafs.select("o", boxes.flat_box("traf", F.col("one")).alias("one"), boxes.flat_box("traf", F.col("two")).alias("two"))
    extends = [boxes.number(F.lit(v), 4) for v in (0, 1, 3, 7, 9, 65536)]
    start = F.concat(boxes.flat_box("ftyp", F.lit("isom").cast("binary")), *(part for size, kind in ((48, "moov"), (40, "mvex"), (32, "trex")) for part in (boxes.number(F.lit(size), 4), F.lit(kind).cast("binary"))), *extends)
    content = F.concat(start, boxes.flat_box("moof", F.col("one")), F.coalesce(boxes.flat_box("moof", F.col("two")), _zeros(0)))
    found = fragment_bytes.samples_of_fragments(framed.select(F.concat(F.lit("o"), o).alias("path"), content.alias("content")))
    # A file has one or two fragments; that needs no order beside the one that its samples are in.
    numbered = found.withColumn("part", (F.col("fragment") > F.min("fragment").over(Window.partitionBy("path"))).cast("long"))
    return numbered.drop("fragment")


def _bit_text(value, n):
    """The low ``n`` bits of a whole number as text of 0 and 1."""
    return F.lpad(F.bin(value), n, "0")


def _code_text(value):
    """An exponential Golomb code as text."""
    return boxes.let(F.bin(value + 1), lambda b: F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b))


def _signed_code_text(value):
    return _code_text(F.when(value > 0, 2 * value - 1).otherwise(-2 * value))


def _bit_bytes(text):
    """Text of bits, behind which one and zeros are put up to a whole byte, as bytes."""

    def packed(t):
        eights = F.transform(F.sequence(F.lit(0), F.call_function("div", F.length(t) - 1, F.lit(8)).cast("int")), lambda k: F.lpad(F.conv(F.substring(t, 8 * k + 1, F.lit(8)), 2, 16), 2, "0"))
        return F.unhex(F.array_join(eights, ""))

    marked = boxes.let(F.concat(text, F.lit("1")), lambda t: F.rpad(t, (F.call_function("div", F.length(t) + 7, F.lit(8)) * 8).cast("int"), F.lit("0")))
    return boxes.let(marked, packed)


_BIT_FIELDS = [("five", "bits", 5), ("code", "unsigned"), ("offset", "signed"), ("gap", "skip", 3), ("wide", "bits", 31), ("to_byte", "align"), ("last", "unsigned"), ("tail", "trailing")]


@query(
    "i7_bit_fields",
    """WITH k AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderkey % 2001 - 1000 AS s FROM orders),
    w AS (SELECT *, 2 * len(bin(c + 1)) - 1 AS w1, 2 * len(bin(CASE WHEN s > 0 THEN 2 * s ELSE -2 * s + 1 END)) - 1 AS w2, 2 * len(bin(o * 7 + 1)) - 1 AS w3 FROM k),
    e AS (SELECT *, 5 AS e1, 5 + w1 AS e2, 5 + w1 + w2 AS e3, 5 + w1 + w2 + 3 AS e4, 5 + w1 + w2 + 34 AS e5, (5 + w1 + w2 + 34 + 7) // 8 * 8 AS e6 FROM w),
    f AS (SELECT *, e6 + w3 AS e7, (e6 + w3 + 1 + 7) // 8 * 8 AS whole FROM e),
    g AS (SELECT *, greatest(CASE WHEN o % 6 = 1 THEN whole - 8 * (1 + o % 9) ELSE whole END, 0) AS bits FROM f)
    SELECT o AS i, CASE WHEN e1 <= bits THEN o % 32 END AS five, CASE WHEN e2 <= bits THEN c END AS code, CASE WHEN e3 <= bits THEN s END AS "offset", CASE WHEN e5 <= bits THEN o * 1000003 % 2147483648 END AS wide,
           CASE WHEN e7 <= bits THEN o * 7 END AS last, CASE WHEN bits = whole AND o % 6 <> 2 THEN CAST(1 AS BIGINT) END AS tail,
           CAST(CASE WHEN bits = whole AND o % 6 <> 2 THEN whole WHEN e7 <= bits THEN e7 WHEN e6 <= bits THEN e6 WHEN e5 <= bits THEN e5 WHEN e4 <= bits THEN e4 WHEN e3 <= bits THEN e3 WHEN e2 <= bits THEN e2 WHEN e1 <= bits THEN e1 ELSE 0 END AS BIGINT) AS "position",
           bits = whole AND o % 6 <> 2 AS complete FROM g""",
)
def bit_fields(spark, sf_dir):
    """Keys as bits and codes, read back in step; some payloads are cut short, some have a bit too many behind their end (I6-I8, I10)."""
    o, c = F.col("o"), F.col("c")
    head = F.concat(_bit_text(o % 32, 5), _code_text(c), _signed_code_text(o % 2001 - 1000), F.lit("101"), _bit_text(o * 1000003 % (1 << 31), 31))
    aligned = boxes.let(head, lambda t: F.rpad(t, (F.call_function("div", F.length(t) + 7, F.lit(8)) * 8).cast("int"), F.lit("1")))
    made = _orders(spark, sf_dir).select("o", F.concat(aligned, _code_text(o * 7)).alias("text")).withColumn("data", _bit_bytes(F.col("text")))
    cut = F.substring(F.col("data"), F.lit(1), F.greatest(F.length("data") - 1 - o % 9, F.lit(0)).cast("int"))
    # Behind the last bit that is set there is another: the tail is not one bit and zeros.
    spoilt = F.concat(F.col("data"), F.unhex(F.lit("01")))
    rows = made.select(o.alias("i"), F.when(o % 6 == 1, cut).when(o % 6 == 2, spoilt).otherwise(F.col("data")).alias("data"))
    return rows.select("i", bits.bit_fields(F.col("data"), _BIT_FIELDS).alias("f")).select("i", "f.*")


@query(
    "i12_sequence_sets",
    """WITH k AS (SELECT o_orderkey AS o, o_custkey AS c, [66, 77, 100, 88][o_orderkey % 4 + 1] AS profile, o_orderkey % 3 AS kind, 1 + o_custkey % 40 AS mw, 1 + o_orderkey % 30 AS mh, o_orderkey % 5 > 0 AS frames, o_orderkey % 2 = 0 AS crop, o_orderkey % 9 AS l, o_custkey % 4 AS r, o_custkey % 3 AS t, o_orderkey % 11 AS b FROM orders),
    s AS (SELECT *, mw * 16 AS cw, mh * 16 * CASE WHEN frames THEN 1 ELSE 2 END AS ch, CASE WHEN frames THEN 2 ELSE 4 END AS unit FROM k),
    v AS (SELECT *, cw - CASE WHEN crop THEN 2 * (l + r) ELSE 0 END AS w, ch - CASE WHEN crop THEN unit * (t + b) ELSE 0 END AS h FROM s),
    e AS (SELECT *, CASE WHEN profile = 88 THEN 'unsupported: profile' WHEN o % 13 = 1 THEN 'invalid: reserved bits are set' WHEN o % 13 = 2 THEN 'invalid: id is out of range' WHEN o % 13 = 3 AND profile = 100 THEN 'unsupported: scaling lists'
      WHEN o % 13 = 4 THEN 'invalid: number of references' WHEN o % 13 = 5 THEN 'unsupported: usability information' WHEN o % 13 = 6 THEN 'invalid: trailing bits' WHEN o % 13 = 7 THEN 'invalid: truncated set' WHEN w <= 0 OR h <= 0 THEN 'invalid: nothing is visible' END AS error FROM v)
    SELECT o AS i, CASE WHEN error IS NULL THEN c % 32 END AS id, CASE WHEN error IS NULL THEN CAST(profile AS BIGINT) END AS profile, CASE WHEN error IS NULL THEN 4 + c % 13 END AS frame_num_bits, CASE WHEN error IS NULL THEN kind END AS order_type,
           CASE WHEN error IS NULL AND kind = 0 THEN 4 + o % 13 END AS order_lsb_bits, CASE WHEN error IS NULL AND kind = 1 THEN c % 100 - 50 END AS offset_non_reference,
           CASE WHEN error IS NULL AND kind = 1 THEN array_to_string(list_transform(range(c % 4), lambda j: o % 7 - 3 * j), ' ') END AS offsets, CASE WHEN error IS NULL THEN c % 17 END AS "references", CASE WHEN error IS NULL THEN frames END AS frames_only,
           CASE WHEN error IS NULL THEN NOT frames AND o % 10 = 0 END AS adaptive, CASE WHEN error IS NULL THEN cw END AS coded_width, CASE WHEN error IS NULL THEN ch END AS coded_height, CASE WHEN error IS NULL THEN CASE WHEN crop THEN 2 * l ELSE 0 END END AS x,
           CASE WHEN error IS NULL THEN CASE WHEN crop THEN unit * t ELSE 0 END END AS y, CASE WHEN error IS NULL THEN w END AS width, CASE WHEN error IS NULL THEN h END AS height, error FROM e""",
)
def sequence_sets(spark, sf_dir):
    """Keys as sequence parameter sets of three profiles and all types of order counts, faulty in one way or another."""
    o, c = F.col("o"), F.col("c")
    profile = F.element_at(F.array(*map(F.lit, (66, 77, 100, 88))), (o % 4 + 1).cast("int"))
    kind, fault = o % 3, o % 13
    flag = lambda condition: F.when(condition, "1").otherwise("0")
    high = F.when(profile == 100, F.concat(_code_text(F.lit(1)), F.lit("110"), flag(fault == 3))).otherwise("")
    steps = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda j: j < c % 4), lambda j: _signed_code_text(o % 7 - 3 * j)), "")
    order = F.when(kind == 0, _code_text(o % 13)).when(kind == 1, F.concat(F.lit("0"), _signed_code_text(c % 100 - 50), _signed_code_text(F.lit(3)), _code_text(c % 4), steps)).otherwise("")
    frames = o % 5 > 0
    crop = F.when(o % 2 == 0, F.concat(F.lit("1"), *map(_code_text, (o % 9, c % 4, c % 3, o % 11)))).otherwise("0")
    text = F.concat(
        _bit_text(profile, 8), _bit_text(F.when(fault == 1, 1).otherwise(64), 8), _bit_text(F.lit(30), 8), _code_text(F.when(fault == 2, 32).otherwise(c % 32)), high, _code_text(c % 13), _code_text(kind), order,
        _code_text(F.when(fault == 4, 17).otherwise(c % 17)), F.lit("0"), _code_text(c % 40), _code_text(o % 30), flag(frames), F.when(frames, "").otherwise(flag(o % 10 == 0)), F.lit("1"), crop, flag(fault == 5),
    )
    made = _orders(spark, sf_dir).select("o", text.alias("text")).withColumn("data", _bit_bytes(F.col("text")))
    data = F.when(fault == 6, F.concat(F.col("data"), F.unhex(F.lit("80")))).when(fault == 7, F.substring(F.col("data"), F.lit(1), F.lit(4))).otherwise(F.col("data"))
    found = made.select(o.alias("i"), bits.sequence_set(data).alias("s"))
    names = ["id", "profile", "frame_num_bits", "order_type", "order_lsb_bits", "offset_non_reference", "references", "frames_only", "adaptive", "coded_width", "coded_height", "x", "y", "width", "height", "error"]
    return found.select("i", *(F.col(f"s.{n}").alias(n) for n in names), F.array_join(F.col("s.offsets").cast("array<string>"), " ").alias("offsets"))


_HEAD_PARTS = [
    "event_id % 4 as profile", "event_id % 10 = 0 as existing", "event_id % 7 = 1 and event_id % 10 > 0 as key", "event_id % 3 > 0 or event_id % 10 = 0 as shown", "event_id % 4 = 1 and event_id % 10 > 0 as resilient", "event_id div 3 % 8 as space",
    "event_id * 7 % 256 as mask", "event_id div 4 % 4 as taken", "event_id div 5 % 8 as r0", "event_id div 7 % 8 as r1", "event_id div 11 % 8 as r2", "1 + event_id * 3 % 65536 as w", "1 + event_id * 5 % 65536 as h", "event_id % 6 = 0 as other", "event_id div 2 % 4 as two",
]
_HEADS_SQL = f"""WITH e AS (SELECT event_id AS i, {", ".join(_HEAD_PARTS).replace(" div ", " // ")} FROM events),
    f AS (SELECT *, NOT existing AND NOT key AS inter, key OR (NOT existing AND NOT shown AND i % 5 = 0) AS intra FROM e),
    g AS (SELECT *, inter AND NOT intra AS predicted, key OR (intra AND profile > 0) AS told, space = 7 AS rgb FROM f),
    x AS (SELECT *, CASE WHEN i % 29 = 3 THEN 'invalid: frame marker' WHEN i % 29 = 7 THEN 'invalid: truncated header' WHEN intra AND i % 29 = 5 THEN 'invalid: sync code' WHEN told AND rgb AND profile % 2 = 0 THEN 'invalid: colour space of the profile' END AS error,
      CASE WHEN existing THEN i % 8 WHEN predicted AND taken < 3 THEN [r0, r1, r2][taken + 1] END AS slot_, intra OR (predicted AND taken = 3) AS own FROM g)
    SELECT i, CASE WHEN error IS NULL THEN profile END AS profile, CASE WHEN error IS NULL AND existing THEN i % 8 END AS show_existing, CASE WHEN error IS NULL THEN key END AS key, CASE WHEN error IS NULL THEN shown END AS shown, CASE WHEN error IS NULL THEN resilient END AS resilient, CASE WHEN error IS NULL THEN intra END AS intra_only,
      CASE WHEN error IS NULL THEN CASE WHEN inter AND NOT resilient THEN two ELSE 0 END END AS reset_context, CAST(CASE WHEN error IS NULL AND intra THEN CASE WHEN told AND profile >= 2 THEN CASE WHEN two > 1 THEN 12 ELSE 10 END ELSE 8 END END AS BIGINT) AS bit_depth, CASE WHEN error IS NULL AND intra THEN CASE WHEN told THEN space ELSE 1 END END AS color_space,
      CASE WHEN error IS NULL AND intra THEN told AND (rgb OR two % 2 = 1) END AS full_range, CASE WHEN error IS NULL AND intra THEN NOT told OR (NOT rgb AND (profile % 2 = 0 OR r0 > 3)) END AS halved_across, CASE WHEN error IS NULL AND intra THEN NOT told OR (NOT rgb AND (profile % 2 = 0 OR r1 > 3)) END AS halved_down,
      CASE WHEN error IS NULL THEN CASE WHEN key THEN 255 WHEN existing THEN 0 ELSE mask END END AS refresh, CASE WHEN error IS NULL AND predicted THEN r0 || ' ' || r1 || ' ' || r2 END AS "references", CASE WHEN error IS NULL THEN slot_ END AS size_slot, CASE WHEN error IS NULL AND own THEN w END AS width, CASE WHEN error IS NULL AND own THEN h END AS height,
      CASE WHEN error IS NULL AND NOT existing AND (other OR own) THEN CASE WHEN other THEN h ELSE w END END AS render_width, CASE WHEN error IS NULL AND NOT existing AND (other OR own) THEN CASE WHEN other THEN w ELSE h END END AS render_height,
      CASE WHEN error IS NULL AND predicted THEN CASE WHEN two % 2 = 0 THEN 4 ELSE i // 8 % 4 END END AS "filter", CASE WHEN error IS NULL THEN CASE WHEN existing OR intra OR resilient THEN 0 ELSE two END END AS context, error FROM x"""


@query("i15_frame_heads", _HEADS_SQL)
def frame_heads(spark, sf_dir):
    """Events as frame headers of all profiles and kinds, some spoilt."""
    e = _events(spark, sf_dir, *_HEAD_PARTS)
    c, i = F.col, F.col("i")
    inter = ~c("existing") & ~c("key")
    intra = c("key") | (inter & ~c("shown") & (i % 5 == 0))
    predicted, told, rgb = inter & ~intra, c("key") | (intra & (c("profile") > 0)), c("space") == 7
    bit = lambda condition: F.when(condition, "1").otherwise("0")
    only = lambda condition, text: F.when(condition, text).otherwise("")
    sync = only(intra, F.when(i % 29 == 5, _bit_text(F.lit(0x498341), 24)).otherwise(_bit_text(F.lit(0x498342), 24)))
    range_ = F.when(rgb, "0").otherwise(F.concat(bit(c("two") % 2 == 1), only(c("profile") % 2 == 1, F.concat(bit(c("r0") > 3), bit(c("r1") > 3), F.lit("0")))))
    colours = only(told, F.concat(only(c("profile") >= 2, bit(c("two") > 1)), _bit_text(c("space"), 3), range_))
    mask = only(inter, _bit_text(c("mask"), 8))
    named = only(predicted, F.concat(*(F.concat(_bit_text(c(r), 3), bit(i % 2 == 0)) for r in ("r0", "r1", "r2")), F.repeat(F.lit("0"), c("taken").cast("int")), only(c("taken") < 3, F.lit("1"))))
    sized = only(intra | (predicted & (c("taken") == 3)), F.concat(_bit_text(c("w") - 1, 16), _bit_text(c("h") - 1, 16)))
    render = F.concat(bit(c("other")), only(c("other"), F.concat(_bit_text(c("h") - 1, 16), _bit_text(c("w") - 1, 16))))
    motion = only(predicted, F.concat(bit(i % 3 == 0), bit(c("two") % 2 == 0), only(c("two") % 2 == 1, _bit_text(F.call_function("div", i, F.lit(8)) % 4, 2))))
    tail = F.concat(only(~c("resilient"), F.lit("10")), _bit_text(c("two"), 2))
    coded = F.concat(F.lit("0"), bit(~c("key")), bit(c("shown")), bit(c("resilient")), only(inter & ~c("shown"), bit(i % 5 == 0)), only(inter & ~c("resilient"), _bit_text(c("two"), 2)), sync, colours, mask, named, sized, render, motion, tail)
    head = F.concat(F.when(i % 29 == 3, "11").otherwise("10"), bit(c("profile") % 2 == 1), bit(c("profile") > 1), only(c("profile") == 3, F.lit("0")))
    text = F.concat(head, F.when(c("existing"), F.concat(F.lit("1"), _bit_text(i % 8, 3))).otherwise(coded))
    made = e.select("i", text.alias("text")).withColumn("data", _bit_bytes(F.col("text")))
    # Written, as a decoder's input is; Spark does not extract the function from a projection this deep.
    packets = written(made.select("i", F.when(i % 29 == 7, F.unhex(F.lit(""))).otherwise(F.col("data")).alias("data")))
    found = packets.select("i", frame_heads_.frame_head(F.col("data")).alias("f"))
    names = ["profile", "show_existing", "key", "shown", "resilient", "intra_only", "reset_context", "bit_depth", "color_space", "full_range", "halved_across", "halved_down", "refresh", "size_slot", "width", "height", "render_width", "render_height", "filter", "context", "error"]
    return found.select("i", *(F.col(f"f.{n}").alias(n) for n in names), F.array_join(F.col("f.references").cast("array<string>"), " ").alias("references"))


@query(
    "i13_picture_sets",
    """WITH k AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderkey % 15 AS fault, o_orderkey % 3 > 0 AS more FROM orders),
    e AS (SELECT *, CASE fault WHEN 1 THEN 'invalid: id is out of range' WHEN 2 THEN 'invalid: id of the sequence is out of range' WHEN 3 THEN 'unsupported: slice groups' WHEN 4 THEN 'invalid: number of active references' WHEN 5 THEN 'invalid: weights of pairs' WHEN 6 THEN 'invalid: quantizer'
      WHEN 7 THEN CASE WHEN more THEN 'unsupported: scaling lists' END WHEN 8 THEN 'invalid: truncated set' WHEN 9 THEN 'invalid: offset of the chroma quantizer' WHEN 10 THEN 'invalid: number of slice groups' END AS error FROM k)
    SELECT o AS i, CASE WHEN error IS NULL THEN o % 256 END AS id, CASE WHEN error IS NULL THEN c % 32 END AS sequence_id, CASE WHEN error IS NULL THEN o % 2 = 0 END AS arithmetic, CASE WHEN error IS NULL THEN 1 + c % 32 END AS active_0, CASE WHEN error IS NULL THEN 1 + o % 7 END AS active_1,
           CASE WHEN error IS NULL THEN ['default', 'explicit', 'implicit'][c % 3 + 1] END AS pair_weights, CASE WHEN error IS NULL THEN o % 52 END AS qp, CASE WHEN error IS NULL THEN c % 52 END AS qs, CASE WHEN error IS NULL THEN o % 25 - 12 END AS chroma_offset,
           CASE WHEN error IS NULL THEN more AND c % 2 = 0 END AS transform_8x8, CASE WHEN error IS NULL THEN CASE WHEN more THEN c % 25 - 12 ELSE o % 25 - 12 END END AS second_chroma_offset, error FROM e""",
)
def picture_sets(spark, sf_dir):
    """Keys as picture parameter sets with and without the later fields, faulty in one way or another."""
    o, c = F.col("o"), F.col("c")
    fault, more = o % 15, o % 3 > 0
    flag = lambda condition: F.when(condition, "1").otherwise("0")
    later = F.when(more, F.concat(flag(c % 2 == 0), flag(fault == 7), _signed_code_text(c % 25 - 12))).otherwise("")
    text = F.concat(
        _code_text(F.when(fault == 1, 256).otherwise(o % 256)), _code_text(F.when(fault == 2, 32).otherwise(c % 32)), flag(o % 2 == 0), F.lit("0"), _code_text(F.when(fault == 3, 1).when(fault == 10, 8).otherwise(0)),
        _code_text(F.when(fault == 4, 32).otherwise(c % 32)), _code_text(o % 7), F.lit("1"), _bit_text(F.when(fault == 5, 3).otherwise(c % 3), 2), _signed_code_text(F.when(fault == 6, 26).otherwise(o % 52 - 26)), _signed_code_text(c % 52 - 26),
        _signed_code_text(F.when(fault == 9, -13).otherwise(o % 25 - 12)), F.lit("101"), later,
    )
    made = _orders(spark, sf_dir).select("o", text.alias("text")).withColumn("data", _bit_bytes(F.col("text")))
    data = F.when(fault == 8, F.substring(F.col("data"), F.lit(1), F.lit(1))).otherwise(F.col("data"))
    found = made.select(o.alias("i"), bits.picture_set(data).alias("s"))
    names = ["id", "sequence_id", "arithmetic", "active_0", "active_1", "pair_weights", "qp", "qs", "chroma_offset", "transform_8x8", "second_chroma_offset", "error"]
    return found.select("i", *(F.col(f"s.{n}").alias(n) for n in names))


_SETS = [
    "n_nationkey as pps_id", "4 + n_nationkey % 13 as frame_num_bits", "n_nationkey % 3 as order_type", "4 + n_regionkey as order_lsb_bits", "n_nationkey % 2 = 0 as deltas_zero", "n_nationkey % 5 > 1 as frames_only", "n_nationkey % 5 = 1 as adaptive",
    "n_nationkey % 4 > 1 as field_order", "16 * (2 + n_nationkey) as coded_width", "64 as coded_height",
]
_SLICE_PARTS = [
    "event_id % 29 as pps_id", "event_id % 11 = 0 as refresh", "case when event_id % 11 = 0 then case when event_id % 2 = 0 then 2 else 7 end else event_id div 3 % 10 end as code", "event_id div 7 % 12 as first_", "event_id % 3 = 0 as fielded", "event_id % 5 = 0 as bottom",
    "event_id * 37 as num", "event_id % 70000 as idr", "event_id % 41 - 20 as d0", "event_id % 13 - 6 as d1",
]


@query(
    "i14_slice_heads",
    f"""WITH p AS (SELECT {", ".join(_SETS)}, true AS bound FROM nation), e AS (SELECT event_id AS i, {", ".join(_SLICE_PARTS).replace(" div ", " // ")} FROM events),
    j AS (SELECT e.*, frame_num_bits, order_type, order_lsb_bits, deltas_zero, frames_only, adaptive, field_order, coded_width, coded_height, coalesce(bound, false) AS bound FROM e LEFT JOIN p USING (pps_id)),
    f AS (SELECT *, ['P', 'B', 'I', 'SP', 'SI'][code % 5 + 1] AS kind, NOT frames_only AND fielded AS is_field, CASE WHEN refresh AND i % 17 <> 2 THEN 0 ELSE num % CAST(pow(2, frame_num_bits) AS BIGINT) END AS fn FROM j),
    x AS (SELECT *, is_field AND bottom AS is_bottom, field_order AND NOT is_field AS both_,
      CASE WHEN i % 23 = 1 THEN 'unsupported: unit type' WHEN refresh AND i % 19 = 3 THEN 'invalid: refresh is no reference' WHEN i % 31 = 4 THEN 'invalid: truncated header' WHEN NOT bound THEN 'invalid: missing parameter set' WHEN refresh AND fn <> 0 THEN 'invalid: frame number of a refresh'
           WHEN first_ * CASE WHEN adaptive AND NOT is_field THEN 2 ELSE 1 END >= coded_width // 16 * (4 // CASE WHEN is_field THEN 2 ELSE 1 END) THEN 'invalid: first macroblock' WHEN refresh AND idr > 65535 THEN 'invalid: id of the refresh' END AS error FROM f)
    SELECT i, CASE WHEN error IS NULL THEN first_ END AS first_macroblock, CASE WHEN error IS NULL THEN kind END AS kind, CASE WHEN error IS NULL THEN code >= 5 END AS one_kind, CASE WHEN error IS NULL THEN fn END AS frame_num, CASE WHEN error IS NULL THEN is_field END AS is_field, CASE WHEN error IS NULL THEN is_bottom END AS is_bottom,
      CASE WHEN error IS NULL AND refresh THEN idr END AS idr_id, CASE WHEN error IS NULL AND order_type = 0 THEN num % CAST(pow(2, order_lsb_bits) AS BIGINT) END AS order_lsb, CASE WHEN error IS NULL AND order_type = 0 AND both_ THEN d0 END AS delta_bottom,
      CASE WHEN error IS NULL AND order_type = 1 AND NOT deltas_zero THEN d0 END AS delta_0, CASE WHEN error IS NULL AND order_type = 1 AND NOT deltas_zero AND both_ THEN d1 END AS delta_1, error FROM x""",
)
def slice_heads(spark, sf_dir):
    """Events as slices that name one of the nations' parameter sets, or one that there is not; some spoilt or cut."""
    sets = _table(spark, sf_dir, "nation").selectExpr(*_SETS)
    made = _events(spark, sf_dir, *_SLICE_PARTS).join(sets, "pps_id", "left")
    c, i = F.col, F.col("i")
    flag = lambda condition: F.when(condition, "1").otherwise("0")
    only = lambda condition, text: F.when(condition, text).otherwise("")
    low = lambda value, n: F.substring(F.lpad(F.bin(value), 40, "0"), (41 - n).cast("int"), n.cast("int"))
    fielded = ~c("frames_only") & c("fielded")
    both = c("field_order") & ~fielded
    number = F.when(c("refresh") & (i % 17 != 2), 0).otherwise(c("num"))
    order = F.when(c("order_type") == 0, F.concat(low(c("num"), c("order_lsb_bits")), only(both, _signed_code_text(c("d0"))))).when((c("order_type") == 1) & ~c("deltas_zero"), F.concat(_signed_code_text(c("d0")), only(both, _signed_code_text(c("d1"))))).otherwise("")
    head = F.concat(_code_text(c("first_")), _code_text(c("code")), _code_text(c("pps_id")))
    rest = F.concat(low(number, c("frame_num_bits")), only(~c("frames_only"), flag(c("fielded"))), only(fielded, flag(c("bottom"))), only(c("refresh"), _code_text(c("idr"))), order)
    text = F.concat(head, F.coalesce(rest, F.lit("")), F.lit("10101010"))
    packed = made.select("i", "refresh", text.alias("text")).withColumn("data", _bit_bytes(F.col("text")))
    data = F.when(i % 31 == 4, _zeros(0)).otherwise(F.col("data"))
    unit = F.when(i % 23 == 1, 2).when(c("refresh"), 5).otherwise(1)
    slices_ = packed.select("i", data.alias("data"), unit.alias("unit_type"), F.when(c("refresh") & (i % 19 == 3), 0).otherwise(1).alias("ref_idc"))
    found = slices.with_slice_head(written(slices_), sets, [])
    names = ["first_macroblock", "kind", "one_kind", "frame_num", "is_field", "is_bottom", "idr_id", "order_lsb", "delta_bottom", "delta_0", "delta_1", "error"]
    return found.select("i", *(F.col(f"head.{n}").alias(n) for n in names))

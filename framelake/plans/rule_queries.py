"""Queries of rules over columns, of cursors and routing, and the report on files."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import audio, boxes, scalars
from framelake.functions import time as media
from framelake.operators import cursors, headers, runs, streams, summaries, tracks
from framelake.plans.byte_queries import _RUNS, _orders, movie_files
from framelake.plans.queries import _events, _table, query
from framelake.sources import bitstreams, mp4
from framelake.storage import written


@query(
    "j13_cursor_commands",
    """WITH RECURSIVE e AS (SELECT user_id AS stream, event_id % 3 AS cursor_, event_id AS i, CASE WHEN event_id % 7 = 0 THEN 'rewind' WHEN event_id % 5 = 0 THEN 'seek' WHEN event_id % 11 = 0 THEN 'peek' ELSE 'next' END AS op, event_id // 7 % 30 - 2 AS target FROM events),
    n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream, cursor_ ORDER BY i) AS k, CASE WHEN stream % 4 = 0 THEN 0 ELSE stream % 23 END AS packets FROM e),
    r AS (
      SELECT stream, cursor_, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS packet, CAST(0 AS BIGINT) AS at_, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT stream, cursor_ FROM e)
      UNION ALL
      SELECT n.stream, n.cursor_, n.k, n.i, CASE WHEN op = 'next' AND at_ < packets THEN at_ END, CASE WHEN op = 'next' THEN least(at_ + 1, packets) WHEN op = 'rewind' THEN 0 WHEN op = 'seek' AND target BETWEEN 0 AND packets THEN target ELSE at_ END,
             CASE WHEN op = 'seek' AND NOT target BETWEEN 0 AND packets THEN 'invalid: target is out of range' END
      FROM r JOIN n ON n.stream = r.stream AND n.cursor_ = r.cursor_ AND n.k = r.k + 1)
    SELECT stream, cursor_ AS "cursor", i, packet, at_ AS "position", error FROM r WHERE k > 0""",
)
def cursor_commands(spark, sf_dir):
    """Three cursors on each track, with reads, jumps and rewinds."""
    op = "case when event_id % 7 = 0 then 'rewind' when event_id % 5 = 0 then 'seek' when event_id % 11 = 0 then 'peek' else 'next' end as op"
    commands = _events(spark, sf_dir, "event_id % 3 as cursor", op, "event_id div 7 % 30 - 2 as target")
    lengths = commands.select("stream").distinct().where("stream % 4 > 0").selectExpr("stream", "stream % 23 as packets")
    found = cursors.cursor_reads(commands, lengths, ["stream", "cursor"], ["stream"], "i")
    return found.select("stream", "cursor", "i", "packet", "position", "error")


@query(
    "j17_routed_packets",
    """WITH e AS (SELECT user_id AS stream, event_id AS i, CASE event_id % 13 WHEN 1 THEN 'h264' WHEN 5 THEN 'vp9' WHEN 9 THEN 'av1' END AS codec FROM events), g AS (SELECT *, count(*) FILTER (WHERE codec IN ('h264', 'vp9')) OVER (PARTITION BY stream ORDER BY i) AS g FROM e),
    d AS (SELECT *, max(CASE WHEN codec <> 'av1' THEN codec END) OVER (PARTITION BY stream, g) AS decoder FROM g)
    SELECT stream, i, codec, decoder, CASE WHEN codec = 'av1' THEN 'unsupported: codec' WHEN codec IS NULL AND decoder IS NULL THEN 'invalid: not configured' END AS error FROM d""",
)
def routed_packets(spark, sf_dir):
    rows = _events(spark, sf_dir, "case event_id % 13 when 1 then 'h264' when 5 then 'vp9' when 9 then 'av1' end as codec")
    return cursors.route_packets(rows, ["stream"], "i")


@query(
    "b7_table_order",
    """WITH c AS (SELECT o_custkey % 50 AS track, o_orderkey AS run, o_orderkey // 40 AS first_, o_orderkey % 97 AS per, 1 + o_orderkey % 3 AS description FROM orders WHERE o_orderkey % 9 = 0 AND o_custkey % 50 <> 7),
    s AS (SELECT o_custkey % 50 AS track, o_orderkey AS run, CASE WHEN o_custkey % 50 > 20 THEN o_orderkey ELSE o_orderkey % 1000 END AS number_ FROM orders WHERE o_orderkey % 4 = 0),
    d AS (SELECT n_nationkey * 2 AS track, 1 + n_regionkey AS n FROM nation),
    cl AS (SELECT *, lag(first_) OVER w AS old FROM c WINDOW w AS (PARTITION BY track ORDER BY run)), sl AS (SELECT *, lag(number_) OVER w AS old FROM s WINDOW w AS (PARTITION BY track ORDER BY run))
    SELECT DISTINCT track, 'stsc first chunks do not rise' AS error FROM cl WHERE first_ <= old UNION ALL SELECT DISTINCT track, 'stsc chunk has no samples' FROM c WHERE per = 0
    UNION ALL SELECT DISTINCT c.track, 'stsc description is out of range' FROM c LEFT JOIN d USING (track) WHERE description > coalesce(n, 0) UNION ALL SELECT DISTINCT track, 'stss sample numbers do not rise' FROM sl WHERE number_ <= old""",
)
def table_order(spark, sf_dir):
    """Runs of chunks and lists of sync samples from orders, some of them out of order (B7, B9)."""
    o, track = F.col("o"), F.col("c") % 50
    rows = _orders(spark, sf_dir).select(track.alias("track"), "o")
    chunks = rows.where("o % 9 = 0 and track <> 7").selectExpr("track", "o as run", "o div 40 as first_chunk", "o % 97 as samples_per_chunk", "1 + o % 3 as description")
    syncs = rows.where("o % 4 = 0").select("track", o.alias("run"), F.when(F.col("track") > 20, o).otherwise(o % 1000).alias("sample_number"))
    described = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey * 2 as bigint) as track", "1 + n_regionkey as n")
    return runs.table_order_errors(chunks, syncs, described, ["track"])


@query(
    "b10_samples_past_end",
    """SELECT l_orderkey AS o, l_partkey * 10 - 50 AS "offset", l_suppkey AS size, CASE WHEN c_custkey IS NULL THEN 'invalid: no such file' WHEN l_partkey * 10 - 50 < 0 THEN 'invalid: offset is negative' WHEN l_partkey * 10 - 50 + l_suppkey > c_custkey * 12 THEN 'invalid: sample exceeds the input' END AS error
    FROM lineitem LEFT JOIN customer ON c_custkey = l_orderkey""",
)
def samples_past_end(spark, sf_dir):
    samples = _table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as bigint) as o", "cast(l_partkey * 10 - 50 as bigint) as offset", "cast(l_suppkey as bigint) as size")
    files = _table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as o", "cast(c_custkey * 12 as bigint) as length")
    return runs.samples_past_end(samples, files, ["o"])


_AUDIO = ["aac", "flac", "adpcm_ms", "pcm_s16le", "vorbis", "mp3"]


@query(
    "i21_audio_configurations",
    f"""WITH e AS (SELECT event_id AS i, {_AUDIO}[event_id % 6 + 1] AS codec, CASE WHEN event_id % 19 > 0 THEN 48000 ELSE 0 END AS rate, event_id % 17 AS channels, CASE event_id // 6 % 3 WHEN 0 THEN 4 WHEN 1 THEN 0 END AS data_, CASE WHEN event_id % 5 > 0 THEN event_id // 5 % 4 * 8 END AS bits, CASE WHEN event_id % 4 > 0 THEN event_id // 7 % 4 * 8 END AS coded,
           CASE WHEN event_id % 3 > 0 THEN event_id // 11 % 4 END AS pf, CASE WHEN event_id % 7 > 1 THEN event_id // 13 % 5 END AS bf FROM events)
    SELECT i, CASE WHEN rate = 0 THEN 'invalid: rate is zero' WHEN channels = 0 THEN 'invalid: no channels' WHEN data_ = 0 THEN 'invalid: codec data is empty' WHEN codec IN ('aac', 'flac', 'vorbis') AND data_ IS NULL THEN 'invalid: codec needs data' WHEN coalesce(bits = 0, false) OR coalesce(coded = 0, false) THEN 'invalid: sample width is zero'
      WHEN coded > bits THEN 'invalid: coded width exceeds the decoded one' WHEN coalesce(pf = 0, false) OR coalesce(bf = 0, false) THEN 'invalid: frame count is zero' WHEN codec = 'adpcm_ms' AND (pf IS NULL OR bf IS NULL) THEN 'invalid: codec needs frame counts' END AS error FROM e""",
)
def audio_configurations(spark, sf_dir):
    i = F.col("i")
    div = lambda n: F.call_function("div", i, F.lit(n))
    codec = F.element_at(F.array(*map(F.lit, _AUDIO)), (i % 6 + 1).cast("int"))
    data = F.when(div(6) % 3 == 0, F.unhex(F.lit("00000000"))).when(div(6) % 3 == 1, F.unhex(F.lit("")))
    error = audio.decoder_config_error(codec, F.when(i % 19 > 0, 48000).otherwise(0), i % 17, data, F.when(i % 5 > 0, div(5) % 4 * 8), F.when(i % 4 > 0, div(7) % 4 * 8), F.when(i % 3 > 0, div(11) % 4), F.when(i % 7 > 1, div(13) % 5))
    return _events(spark, sf_dir).select("i", error.alias("error"))


@query("i2_seconds", "SELECT o_orderkey AS i, CAST(o_custkey - 500 AS DOUBLE) / CAST(1 + o_orderkey % 90000 AS DOUBLE) AS seconds FROM orders")
def seconds(spark, sf_dir):
    return _orders(spark, sf_dir).select(F.col("o").alias("i"), media.seconds(F.col("c") - 500, 1 + F.col("o") % 90000).alias("seconds"))


@query(
    "i9_unescaped_payloads",
    """WITH k AS (SELECT o_orderkey AS o, hex(CAST(o_orderkey AS VARCHAR)) AS a, hex(CAST(o_custkey AS VARCHAR)) AS b FROM orders)
    SELECT o AS i, CASE WHEN o % 7 > 0 THEN upper(a || CASE o % 4 WHEN 0 THEN '0000' || printf('%02x', o % 3) WHEN 1 THEN '000003' WHEN 2 THEN '00000000' ELSE '0000' END || b) END AS data FROM k""",
)
def unescaped_payloads(spark, sf_dir):
    """Digits of keys with zeros between them, escaped where the format asks for it; every seventh holds a sequence that is forbidden (I9)."""
    o = F.col("o")
    a, b = o.cast("string").cast("binary"), F.col("c").cast("string").cast("binary")
    hexed = lambda text: F.unhex(F.lit(text))
    escaped = F.when(o % 4 == 0, F.concat(hexed("000003"), boxes.number(o % 3, 1))).when(o % 4 == 1, hexed("00000303")).when(o % 4 == 2, hexed("0000030000")).otherwise(hexed("0000"))
    spoilt = F.when(o % 7 == 0, hexed("000001")).otherwise(hexed(""))
    rows = _orders(spark, sf_dir).select(o.alias("id"), F.concat(a, escaped, b, spoilt).alias("data"))
    found = bitstreams.split_packets(rows, bitstreams.unescaped_payload)
    return found.select(F.col("id").alias("i"), F.when(F.col("error").isNull(), F.hex("data")).alias("data"))


@query(
    "i17_numbers_and_names",
    """SELECT o_orderkey AS i, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 65536 END AS two, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey * 3 % 16777216 END AS three, CASE WHEN o_orderkey % 5 > 2 THEN o_orderkey * 100003 % 4294967296 END AS four,
       CASE WHEN o_orderkey % 3 = 0 THEN '0x00' || lower(printf('%06X', o_custkey % 16777216)) ELSE 'k' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS name FROM orders""",
)
def numbers_and_names(spark, sf_dir):
    """Big-endian numbers of keys, cut short for some, and names of four bytes (I17, I18)."""
    o, c = F.col("o"), F.col("c")
    whole = F.concat(boxes.number(c, 2), boxes.number(o * 3, 3), boxes.number(o * 100003, 4))
    cut = F.substring(whole, F.lit(1), F.element_at(F.array(*map(F.lit, (1, 2, 5, 9, 9))), (o % 5 + 1).cast("int")))
    name = F.when(o % 3 == 0, boxes.number(c % (1 << 24), 4)).otherwise(F.concat(F.lit("k"), F.lpad((o % 1000).cast("string"), 3, "0")).cast("binary"))
    rows = _orders(spark, sf_dir).select(o.alias("i"), cut.alias("d"), name.alias("n"))
    return rows.select("i", *(scalars.big_endian(F.col("d"), at, size).alias(label) for label, at, size in (("two", 0, 2), ("three", 2, 3), ("four", 5, 4))), scalars.four_cc(F.col("n")).alias("name"))


@query(
    "a13_detected_files",
    """SELECT o_orderkey AS i, o_orderkey % 4 IN (0, 1) OR o_custkey % 6 < 4 AS mp4 FROM orders""",
)
def detected_files(spark, sf_dir):
    o, kind = F.col("o"), F.element_at(F.array(*map(F.lit, ("ftyp", "moov", "free", "wide", "mdat", "RIFF"))), (F.col("c") % 6 + 1).cast("int"))
    name = F.concat(F.lit("clip"), o, F.element_at(F.array(*map(F.lit, (".mp4", ".MoV", ".mp4.txt", ""))), (o % 4 + 1).cast("int")))
    return _orders(spark, sf_dir).select(o.alias("i"), scalars.is_mp4(name, F.concat(boxes.number(o, 4), kind.cast("binary"))).alias("mp4"))


@query("m3_channel_layouts", "SELECT event_id AS i, CASE event_id % 9 WHEN 1 THEN 'Mono' WHEN 2 THEN 'Stereo' ELSE 'Discrete' || (event_id % 9) END AS layout FROM events")
def channel_layouts(spark, sf_dir):
    return _events(spark, sf_dir).select("i", audio.layout(F.col("i") % 9).alias("layout"))


@query(
    "a15_inspected_tracks",
    f"""WITH {_RUNS}, k AS (SELECT f, odd, track, (f + odd) % 3 > 0 AS video, CAST(sum(n) AS BIGINT) AS samples, count(*) AS sync_samples, CAST(sum(n * delta) AS BIGINT) AS total FROM r GROUP BY ALL)
    SELECT 'part-' || f AS path, CAST(track AS INTEGER) AS track, 600 + f AS movie_timescale, CASE WHEN video THEN 'vide' ELSE 'soun' END AS handler, 1000 + f AS timescale, samples, sync_samples, total,
           CASE WHEN odd = 0 THEN 2 ELSE 0 END AS edits, CAST(CASE WHEN odd = 1 THEN 0 WHEN (100 + f) * (1000 + f) % (600 + f) = 0 THEN (100 + f) * (1000 + f) // (600 + f) - f % 7 END AS BIGINT) AS presentation_offset, CASE WHEN video THEN 'avc1' ELSE 'mp4a' END AS format,
           CASE WHEN video THEN 16 + f % 100 END AS width, CASE WHEN video THEN 8 + odd END AS height FROM k""",
)
def inspected_tracks(spark, sf_dir):
    """The report on files: tracks with their scales, samples, edits and descriptions; each file is parsed once."""
    kinds = [*tracks.TABLES, "stsz", "stsd", "elst", "mvhd", "mdhd", "hdlr", "avcC", "vpcC", *tracks.VIDEO_ENTRIES]
    files = written(mp4.parsed(movie_files(spark, sf_dir), kinds))
    key = ["path", "track"]
    samples = tracks.samples_of_files(files).groupBy(*key).agg(F.count(F.lit(1)).alias("samples"), F.count_if("sync").alias("sync_samples"), F.sum("duration").cast("long").alias("total"))
    heads = tracks.track_headers(files).join(headers.movie_headers(files).select("path", F.col("timescale").alias("movie_timescale")), "path")
    edits = tracks.edit_lists(files).join(heads.select(*key, "movie_timescale", F.col("timescale").alias("media_timescale")), key)
    offsets = runs.timeline_offset(edits, key).select(*key, "offset", F.lit(True).alias("_edited"))
    counted = edits.groupBy(*key).agg(F.count(F.lit(1)).alias("edits"))
    first = tracks.sample_descriptions(files).where("ordinal = 0").select(*key, "format", "width", "height")
    joined = heads.join(samples, key).join(offsets, key, "left").join(counted, key, "left").join(first, key, "left")
    shift = F.when(F.col("_edited"), F.col("offset")).otherwise(0)
    return joined.select("path", F.col("track").cast("int").alias("track"), "movie_timescale", "handler", "timescale", "samples", "sync_samples", "total", F.coalesce("edits", F.lit(0)).cast("int").alias("edits"), shift.cast("long").alias("presentation_offset"), "format", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


_G2 = """WITH RECURSIVE e AS (SELECT user_id AS stream, event_id AS i, CAST(floor(value * 1000) AS BIGINT) AS poc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (
      SELECT stream, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(poc BIGINT, i BIGINT)[]) AS held FROM (SELECT DISTINCT stream FROM e)
      UNION ALL
      SELECT e.stream, e.n, list_sort(list_append(CASE WHEN len(held) > 2 THEN held[2:] ELSE held END, struct_pack(poc := poc, i := e.i))) FROM r JOIN e ON e.stream = r.stream AND e.n = r.n + 1),
    l AS (SELECT stream, n, held, n = max(n) OVER (PARTITION BY stream) AS last_ FROM r WHERE n > 0),
    out_ AS (SELECT stream, n, 1 AS k, held[1] AS x FROM l WHERE NOT last_ AND len(held) > 2 UNION ALL SELECT stream, n, k, x FROM (SELECT stream, n, unnest(held) AS x, unnest(range(1, len(held) + 1)) AS k FROM l WHERE last_))
    SELECT e.stream, e.i, e.poc, CAST(row_number() OVER (PARTITION BY out_.stream ORDER BY out_.n, k) - 1 AS BIGINT) AS output_index FROM out_ JOIN e ON e.stream = out_.stream AND e.i = x.i"""


@query("g2_bounded_reorder", _G2)
def bounded_reorder(spark, sf_dir):
    return streams.reorder_bounded(_events(spark, sf_dir, "cast(floor(value * 1000) as bigint) as poc"), ["stream"], ["i"], "poc", 2)


@query(
    "e2_checked_totals",
    """WITH t AS (SELECT p_brand AS track, sum(p_size) AS samples, sum(p_size * (1 + p_partkey % 7)) AS total FROM part WHERE p_partkey % 89 > 0 GROUP BY p_brand),
    s AS (SELECT p_brand AS track, count(*) AS sized, sum(p_partkey % 50 + k) AS bytes FROM (SELECT *, unnest(range(1, p_size + 1)) AS k FROM part WHERE p_partkey % 97 > 0) GROUP BY p_brand)
    SELECT track, CAST(coalesce(samples, 0) AS BIGINT) AS samples, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(sized, 0) AS BIGINT) AS sized, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, coalesce(samples, 0) = coalesce(sized, 0) AS agrees FROM t FULL JOIN s USING (track)""",
)
def checked_totals(spark, sf_dir):
    """Totals of the tables of each brand, some parts missing from one or the other."""
    part = _table(spark, sf_dir, "part").selectExpr("p_brand as track", "cast(p_partkey as bigint) as p", "cast(p_size as bigint) as n")
    sizes = part.where("p % 97 > 0").select("track", "p", F.explode(F.expr("sequence(1L, n)")).alias("k")).selectExpr("track", "p % 50 + k as size")
    return summaries.table_totals(part.where("p % 89 > 0").selectExpr("track", "n as count", "1 + p % 7 as delta"), sizes, ["track"])

"""The container and stream operators over the supplied tables, each with the SQL that checks it.

The tables hold no media. Parts stand in for run-length rows, users for streams
and events for samples, so that every rule meets ties, gaps and long streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import audio, scalars
from framelake.functions import time as media
from framelake.operators import asof, fragments, packets, pictures, runs, seek, selection, streams, summaries, tracks
from framelake.sources import bitstreams, mp4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("track"), F.col("p_partkey").alias("run"), F.col("p_size").cast("long").alias("count"), (F.lit(1) + F.col("p_partkey") % 7).alias("delta"))


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """stream, i (decode order), t (a time with ties), kind and more from expressions."""
    events = _table(spark, sf_dir, "events")
    return events.selectExpr("user_id as stream", "event_id as i", *columns)


@query("b2_expand_runs", "SELECT p_brand AS track, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, k) - 1 AS BIGINT) AS sample_index, CAST(1 + p_partkey % 7 AS BIGINT) AS delta FROM (SELECT *, unnest(generate_series(1, p_size)) AS k FROM part)")
def expand_runs(spark, sf_dir):
    return runs.expand_runs(_runs(spark, sf_dir), ["track"], ["run"], "count", ["delta"])


_DTS = "SELECT track, sample_index, CAST(sum(delta) OVER (PARTITION BY track ORDER BY sample_index) - delta AS BIGINT) AS dts, delta AS duration FROM (SELECT p_brand AS track, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, k) - 1 AS BIGINT) AS sample_index, CAST(1 + p_partkey % 7 AS BIGINT) AS delta FROM (SELECT *, unnest(generate_series(1, p_size)) AS k FROM part))"


@query("b3_decode_times", _DTS)
def decode_times(spark, sf_dir):
    return runs.decode_times(_runs(spark, sf_dir), ["track"], ["run"], "count", "delta")


@query(
    "b4_presentation_times",
    f"WITH d AS ({_DTS}), c AS (SELECT p_brand AS track, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, k) - 1 AS BIGINT) AS sample_index, p_partkey % 5 - 2 AS shift FROM (SELECT *, unnest(generate_series(1, p_size - 1)) AS k FROM part)) "
    "SELECT track, sample_index, CAST(dts + coalesce(shift, 0) AS BIGINT) AS pts FROM d LEFT JOIN c USING (track, sample_index)",
)
def presentation_times(spark, sf_dir):
    times = decode_times(spark, sf_dir)
    shorter = _runs(spark, sf_dir).withColumns({"count": F.col("count") - 1, "shift": F.col("run") % 5 - 2})
    shifts = runs.expand_runs(shorter, ["track"], ["run"], "count", ["shift"])
    return times.join(runs.merged(shifts), ["track", "sample_index"], "left").select("track", "sample_index", (F.col("dts") + F.coalesce("shift", F.lit(0))).alias("pts"))


_TABLE_RUNS = "SELECT l_partkey % 20 AS track, l_suppkey AS run, count(*) AS n FROM lineitem GROUP BY ALL"


@query(
    "b1_table_errors",
    f"""WITH g AS ({_TABLE_RUNS}), first AS (SELECT track, min(run) AS low FROM g GROUP BY track), n AS (SELECT track, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY track),
    stts AS (SELECT track, sum(CASE WHEN track % 2 = 1 AND run % 7 = 0 THEN 0 ELSE n END) AS s, count(*) FILTER (WHERE track % 2 = 1 AND run % 7 = 0) AS empty_ FROM g GROUP BY track),
    ctts AS (SELECT track, sum(n + 1) AS s FROM g WHERE track % 4 = 0 GROUP BY track),
    stsc AS (SELECT track, sum(n + CASE WHEN track % 5 = 0 THEN 1 ELSE 0 END) AS s FROM g GROUP BY track),
    stss AS (SELECT o_orderkey % 20 AS track, min(o_orderkey // 20) AS low, max(o_orderkey // 20) AS high FROM orders WHERE o_orderkey % 20 % 3 = 0 GROUP BY ALL),
    e AS (
      SELECT track, 'stts entry has zero samples' AS error FROM stts WHERE empty_ > 0 UNION ALL
      SELECT track, 'stts sample count does not match stsz' FROM stts JOIN n USING (track) WHERE s <> n UNION ALL
      SELECT track, 'ctts sample count does not match stsz' FROM ctts JOIN n USING (track) WHERE s <> n UNION ALL
      SELECT track, 'stsc sample count does not match stsz' FROM stsc JOIN n USING (track) WHERE s <> n UNION ALL
      SELECT track, 'stsc does not begin with chunk 1' FROM first WHERE low <> 1 UNION ALL
      SELECT track, 'stss sample number is out of range' FROM stss JOIN n USING (track) WHERE low < 1 OR high > n)
    SELECT * FROM e""",
)
def table_errors(spark, sf_dir):
    """Runs of time, chunks and sizes from order lines by supplier, some of them spoilt."""
    lines = _table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 20 as track", "l_suppkey as run")
    groups = lines.groupBy("track", "run").agg(F.count(F.lit(1)).alias("n"))
    marks = _table(spark, sf_dir, "orders").where("o_orderkey % 20 % 3 = 0").selectExpr("o_orderkey % 20 as track", "o_orderkey div 20 as sample_number")
    return runs.sample_table_errors(
        groups.selectExpr("track", "run", "case when track % 2 = 1 and run % 7 = 0 then 0 else n end as count"),
        groups.where("track % 4 = 0").selectExpr("track", "run", "n + 1 as count"),
        groups.selectExpr("track", "run as chunk", "run * 1000 as chunk_offset"),
        groups.selectExpr("track", "run as first_chunk", "n + case when track % 5 = 0 then 1 else 0 end as samples_per_chunk", "1 as description"),
        lines,
        marks,
        ["track"],
    )


_FRAGMENTS = "SELECT o_orderkey AS fragment, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey * 7 END AS explicit, o_orderkey % 3 <> 0 AS base_is_moof, o_orderkey * 1000 AS moof FROM orders"


@query(
    "b13_data_bases",
    f"""SELECT fragment, CASE WHEN explicit IS NOT NULL AND NOT base_is_moof THEN explicit WHEN explicit IS NULL AND base_is_moof THEN moof END AS base,
    CASE WHEN explicit IS NOT NULL AND base_is_moof THEN 'invalid: two data bases' WHEN explicit IS NULL AND NOT base_is_moof THEN 'unsupported: no data base' END AS error FROM ({_FRAGMENTS})""",
)
def data_bases(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as fragment", "case when o_orderkey % 5 < 2 then o_orderkey * 7 end as explicit", "o_orderkey % 3 <> 0 as base_is_moof", "o_orderkey * 1000 as moof")
    return rows.withColumn("_d", fragments.data_base(F.col("explicit"), F.col("base_is_moof"), F.col("moof"))).select("fragment", "_d.base", "_d.error")


_DEFAULTS = "SELECT s_suppkey AS track, s_suppkey % 4 AS description, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 6 END AS duration, s_suppkey % 9 AS size, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 2) * 65536 END AS flags FROM supplier UNION ALL SELECT s_suppkey, 1, 1, 1, 0 FROM supplier WHERE s_suppkey % 10 = 0"


def _defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier")
    twice = suppliers.where("s_suppkey % 10 = 0").selectExpr("s_suppkey as track", "1L as description", "1L as duration", "1L as size", "0L as flags")
    once = suppliers.selectExpr("s_suppkey as track", "s_suppkey % 4 as description", "nullif(s_suppkey % 6, 0) as duration", "s_suppkey % 9 as size", "case when s_suppkey % 7 > 0 then s_suppkey % 2 * 65536 end as flags")
    return fragments.track_defaults(once.unionByName(twice), ["track"])


@query(
    "b15_track_defaults",
    f"""SELECT track, min(description) AS description, min(duration) AS duration, min(size) AS size, min(flags) AS flags,
    CASE WHEN count(*) > 1 THEN 'invalid: duplicate track' WHEN min(description) = 0 THEN 'invalid: no description' END AS error FROM ({_DEFAULTS}) GROUP BY track""",
)
def track_defaults(spark, sf_dir):
    return _defaults(spark, sf_dir)


@query(
    "b14_fragment_samples",
    f"""WITH d AS (SELECT track, min(duration) AS duration, min(size) AS size, min(flags) AS flags FROM ({_DEFAULTS}) GROUP BY track),
    s AS (SELECT l_orderkey AS fragment, l_orderkey % 50 + 1 AS track, l_linenumber AS run, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k,
                 CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 40 END AS duration, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 90 END AS size, CASE WHEN l_partkey % 5 > 0 THEN (l_partkey % 4) * 65536 // 2 END AS flags FROM lineitem),
    f AS (SELECT fragment, s.track, run, k, coalesce(s.duration, d.duration) AS duration, coalesce(s.size, d.size) AS size, coalesce(s.flags, d.flags) AS flags,
                 CASE WHEN (fragment + run) % 3 > 0 AND run <> 2 THEN fragment * 100 + run * 10 END AS start_ FROM s LEFT JOIN d ON d.track = s.track),
    b AS (SELECT *, coalesce(duration <= 0, true) OR coalesce(size <= 0, true) AS bad, k = 1 AND start_ IS NOT NULL AS starts FROM f),
    i AS (SELECT *, count(*) FILTER (WHERE starts) OVER w AS island, count(*) FILTER (WHERE bad) OVER w > 0 AS lost FROM b WINDOW w AS (PARTITION BY fragment ORDER BY run, k))
    SELECT fragment, track, run, k, CAST(CASE WHEN NOT lost THEN max(CASE WHEN starts THEN start_ END) OVER (PARTITION BY fragment, island)
             + coalesce(sum(CASE WHEN NOT bad THEN size END) OVER (PARTITION BY fragment, island ORDER BY run, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS "offset", size, duration,
           (flags & 65536) = 0 AS sync,
           CASE WHEN island = 0 THEN 'unsupported: first run has no data offset' WHEN coalesce(duration <= 0, true) THEN 'invalid: sample has no duration'
                WHEN coalesce(size <= 0, true) THEN 'invalid: sample has no size' WHEN flags IS NULL THEN 'invalid: sample has no flags' END AS error FROM i""",
)
def fragment_samples(spark, sf_dir):
    """Order lines as samples of the fragment that is their order, a run for each line number."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = _table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w))
    samples = lines.selectExpr(
        "l_orderkey as fragment", "l_orderkey % 50 + 1 as track", "l_linenumber as run", "k", "case when l_partkey % 3 > 0 then l_partkey % 40 end as duration",
        "case when l_suppkey % 3 > 0 then l_suppkey % 90 end as size", "case when l_partkey % 5 > 0 then l_partkey % 4 * 65536 div 2 end as flags",
    )
    starts = samples.select("fragment", "run").distinct().selectExpr("fragment", "run", "fragment * 100 as base", "case when (fragment + run) % 3 > 0 and run <> 2 then run * 10 end as data_offset")
    return fragments.fragment_samples(samples, starts, _defaults(spark, sf_dir), ["fragment"], ["track"])


@query(
    "i20_pixel_layouts",
    """SELECT p_partkey AS id, name, CASE WHEN name IN ('nv12', 'p010') THEN 2 WHEN name IN ('bgra8', 'rgba8') THEN 1 WHEN name <> 'other' THEN 3 END AS planes,
    CASE WHEN name IN ('nv12', 'p010', 'i420', 'i422') THEN 1 WHEN name IN ('i440', 'i444') THEN 0 WHEN name = 'planar_yuv16' THEN p_size % 2 END AS across,
    CASE WHEN name IN ('nv12', 'p010', 'i420', 'i440') THEN 1 WHEN name IN ('i422', 'i444') THEN 0 WHEN name = 'planar_yuv16' THEN p_size // 2 % 2 END AS down,
    CASE WHEN name <> 'other' THEN name IN ('nv12', 'p010', 'i420') OR (name = 'planar_yuv16' AND p_size % 4 = 3) END AS is_420
    FROM (SELECT *, ['nv12', 'p010', 'bgra8', 'rgba8', 'i420', 'i422', 'i440', 'i444', 'planar_yuv16', 'other'][p_partkey % 10 + 1] AS name FROM part)""",
)
def pixel_layouts(spark, sf_dir):
    names = "array('nv12', 'p010', 'bgra8', 'rgba8', 'i420', 'i422', 'i440', 'i444', 'planar_yuv16', 'other')"
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"get({names}, cast(p_partkey % 10 as int)) as name", "p_size % 2 as a", "p_size div 2 % 2 as d")
    return rows.withColumn("_l", scalars.pixel_layout(F.col("name"), F.col("a"), F.col("d"))).select("id", "name", "_l.planes", "_l.across", "_l.down", "_l.is_420")


@query(
    "i22_vp9_colours",
    """SELECT event_id AS id, matrix, primaries, transfer FROM events LEFT JOIN (VALUES (0, 'bt601', 'unspecified', 'unspecified'), (1, 'bt709', 'bt709', 'bt709'), (2, 'smpte170m', 'bt601_525', 'smpte170m'),
    (3, 'other(7)', 'other(7)', 'other(7)'), (4, 'bt2020_ncl', 'bt2020', 'bt2020_10'), (5, 'unspecified', 'unspecified', 'unspecified'), (6, 'other(0)', 'other(11)', 'unspecified'), (7, 'identity', 'bt709', 'srgb')) c(n, matrix, primaries, transfer) ON n = event_id % 9""",
)
def vp9_colours(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("_c", scalars.vp9_colour(F.col("i") % 9)).select(F.col("i").alias("id"), "_c.matrix", "_c.primaries", "_c.transfer")


@query(
    "d6_chunk_run_lookup",
    "SELECT track, chunk, first, size FROM (SELECT k.track, k.chunk, r.first, r.size, r.nxt FROM (SELECT o_orderkey % 8 AS track, o_orderkey AS chunk FROM orders) k JOIN (SELECT p_partkey % 8 AS track, 5 * p_partkey AS first, p_size AS size, lead(5 * p_partkey) OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) AS nxt FROM part) r "
    "ON k.track = r.track AND k.chunk >= r.first AND (r.nxt IS NULL OR k.chunk < r.nxt))",
)
def chunk_run_lookup(spark, sf_dir):
    keys = _table(spark, sf_dir, "orders").selectExpr("o_orderkey % 8 as track", "o_orderkey as chunk")
    starts = _table(spark, sf_dir, "part").selectExpr("p_partkey % 8 as track", "5 * p_partkey as first", "p_size as size")
    return runs.lookup_run(keys, starts, ["track"], "chunk", "first", ["first", "size"])


_CHUNKS = "SELECT o_custkey % 50 AS track, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS chunk, o_orderkey * 1000 AS chunk_offset FROM orders"


@query(
    "b10_sample_offsets",
    f"WITH c AS (SELECT *, CASE WHEN chunk >= 5 THEN 3 ELSE 2 END AS n, CASE WHEN chunk >= 5 THEN 2 ELSE 1 END AS description FROM ({_CHUNKS})), s AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY chunk, k) - 1 AS sample_index FROM (SELECT *, unnest(generate_series(1, n)) AS k FROM c)) "
    'SELECT track, CAST(sample_index AS BIGINT) AS sample_index, CAST(chunk_offset + coalesce(sum(10 + sample_index % 7) OVER (PARTITION BY track, chunk ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(10 + sample_index % 7 AS BIGINT) AS size, description FROM s',
)
def sample_offsets(spark, sf_dir):
    _table(spark, sf_dir, "orders").createOrReplaceTempView("_orders_of_chunks")
    chunks = spark.sql(_CHUNKS.replace("FROM orders", "FROM _orders_of_chunks"))
    tracks = chunks.groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    chunk_runs = tracks.select("track", F.inline(F.array(*(F.struct(F.lit(a).alias("first_chunk"), F.lit(b).alias("samples_per_chunk"), F.lit(d).alias("description")) for a, b, d in ((1, 2, 1), (5, 3, 2))))))
    sizes = tracks.select("track", F.explode(F.sequence(F.lit(0).cast("long"), 3 * F.col("n"))).alias("sample_index")).withColumn("size", 10 + F.col("sample_index") % 7)
    return runs.sample_offsets(chunks, chunk_runs, sizes, ["track"])


@query(
    "b11_fragment_defaults",
    "SELECT o_orderkey AS sample, o_custkey AS fragment, c_nationkey AS track, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 END, CASE WHEN o_custkey % 2 > 0 THEN o_custkey % 70 END, CASE WHEN c_nationkey % 4 > 0 THEN CAST(c_nationkey AS BIGINT) END) AS duration FROM orders JOIN customer ON o_custkey = c_custkey",
)
def fragment_defaults(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    samples = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as sample", "o_custkey as fragment", "case when o_orderkey % 3 > 0 then o_orderkey % 100 end as duration")
    samples = samples.join(customer.selectExpr("c_custkey as fragment", "c_nationkey as track"), "fragment")
    fragments = customer.selectExpr("c_custkey as fragment", "case when c_custkey % 2 > 0 then c_custkey % 70 end as duration")
    tracks = _table(spark, sf_dir, "nation").selectExpr("n_nationkey as track", "case when n_nationkey % 4 > 0 then cast(n_nationkey as bigint) end as duration")
    return summaries.with_defaults(samples, fragments, tracks, ["fragment"], ["track"], ["duration"])


@query(
    "b12_fragment_times",
    "WITH e AS (SELECT user_id AS stream, event_id AS i, CASE WHEN event_type = 'signup' THEN event_id * 10 END AS start, 1 + event_id % 9 AS duration FROM events), g AS (SELECT *, count(start) OVER (PARTITION BY stream ORDER BY i) AS island FROM e) "
    "SELECT stream, i, start, duration, CAST(coalesce(first(start) OVER w, 0) + coalesce(sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS decode_time FROM g WINDOW w AS (PARTITION BY stream, island ORDER BY i)",
)
def fragment_times(spark, sf_dir):
    rows = _events(spark, sf_dir, "case when event_type = 'signup' then event_id * 10 end as start", "1 + event_id % 9 as duration")
    return runs.fragment_times(rows, ["stream"], "i", "start", "duration")


@query(
    "b17_timeline_offset",
    "WITH e AS (SELECT o_custkey AS track, o_orderkey AS ordinal, o_orderkey % 500 AS seg, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000 ELSE -1 END AS mt FROM orders), g AS (SELECT track, sum(CASE WHEN mt = -1 THEN seg ELSE 0 END) AS em, count(*) FILTER (WHERE mt <> -1) AS nm, max(ordinal) FILTER (WHERE mt = -1) AS le, max(ordinal) FILTER (WHERE mt <> -1) AS ma, max(mt) FILTER (WHERE mt <> -1) AS st FROM e GROUP BY track), "
    'f AS (SELECT *, coalesce(nm = 1 AND coalesce(le, -1) < ma AND em * 12 % 10 = 0, false) AS supported FROM g) SELECT track, CASE WHEN supported THEN CAST(em * 12 // 10 - st AS BIGINT) END AS "offset", supported FROM f',
)
def timeline_offset(spark, sf_dir):
    edits = _table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as track", "o_orderkey as ordinal", "o_orderkey % 500 as segment_duration", "case when o_orderkey % 3 = 0 then o_orderkey % 1000 else -1 end as media_time", "1 as rate_int", "0 as rate_fraction", "10 as movie_timescale", "12 as media_timescale"
    )
    return runs.timeline_offset(edits, ["track"])


@query("c5_shown_frames", "SELECT user_id AS stream, event_id AS i, event_id % 40 AS pts FROM events WHERE event_id % 40 >= 15")
def shown_frames(spark, sf_dir):
    return _events(spark, sf_dir, "event_id % 40 as pts").where(seek.shown_from(F.col("pts"), F.lit(15)))


@query("c6_skipped_pictures", "SELECT user_id AS stream, count(*) AS skipped FROM events WHERE event_type <> 'purchase' AND CASE WHEN event_id % 7 > 0 THEN event_id % 40 END < 15 GROUP BY user_id")
def skipped_pictures(spark, sf_dir):
    rows = _events(spark, sf_dir, "case when event_id % 7 > 0 then event_id % 40 end as pts", "event_type = 'purchase' as is_reference")
    return rows.where(seek.may_skip(F.col("pts"), F.lit(15), F.col("is_reference"))).groupBy("stream").agg(F.count(F.lit(1)).alias("skipped"))


def _as_of_sql(best: str) -> str:
    return f"WITH e AS (SELECT user_id AS stream, event_id AS i, event_id // 16 AS t, event_type FROM events), s AS (SELECT stream, t, i FROM e WHERE event_type = 'purchase') SELECT e.stream, e.i, e.t, {best} FROM e"


def _samples(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_id div 16 as t", "event_type")
    return rows.drop("event_type"), rows.where("event_type = 'purchase'").select("stream", F.col("t").alias("s_t"), F.col("i").alias("s_i"))


def _found(op: str, order: str) -> str:
    inner = f"(SELECT s.{{}} FROM s WHERE s.stream = e.stream AND s.t {op} e.t ORDER BY {order} LIMIT 1)"
    return f"{inner.format('t')} AS found_time, {inner.format('i')} AS found_index"


@query("d7_keyframe_at_or_before", _as_of_sql(_found("<=", "s.t DESC, s.i")))
def keyframe_before(spark, sf_dir):
    left, right = _samples(spark, sf_dir)
    return asof.as_of(left, right, ["stream"], "t", "s_t", "s_i", bucket=64)


@query("d8_keyframe_at_or_after", _as_of_sql(_found(">=", "s.t, s.i")))
def keyframe_after(spark, sf_dir):
    left, right = _samples(spark, sf_dir)
    return asof.as_of(left, right, ["stream"], "t", "s_t", "s_i", forward=True)


@query("d10_audio_at_or_before", _as_of_sql(_found("<=", "s.t DESC, s.i DESC")))
def audio_before(spark, sf_dir):
    left, right = _samples(spark, sf_dir)
    return asof.as_of(left, right, ["stream"], "t", "s_t", "s_i", greatest_index=True)


@query("d11_checkpoint_before", _as_of_sql(_found("<", "s.t DESC, s.i")))
def checkpoint_before(spark, sf_dir):
    left, right = _samples(spark, sf_dir)
    return asof.as_of(left, right, ["stream"], "t", "s_t", "s_i", strict=True)


@query("d9_nearest_keyframe", _as_of_sql("(SELECT s.t FROM s WHERE s.stream = e.stream ORDER BY abs(s.t - e.t), s.t, s.i LIMIT 1) AS nearest_time, (SELECT s.i FROM s WHERE s.stream = e.stream ORDER BY abs(s.t - e.t), s.t, s.i LIMIT 1) AS nearest_index"))
def nearest_keyframe(spark, sf_dir):
    left, right = _samples(spark, sf_dir)
    return asof.nearest(left, right, ["stream"], "t", "s_t", "s_i")


@query("e1_service_summary", "SELECT event_type, count(d) AS n, CAST(sum(d) // count(d) AS BIGINT) AS mean, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99, max(d) AS longest FROM (SELECT event_type, CAST(floor(value * 1000) AS BIGINT) AS d FROM events) GROUP BY event_type")
def service_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr("event_type", "cast(floor(value * 1000) as bigint) as d")
    return summaries.service_summary(rows, ["event_type"], "d")


@query("e2_table_totals", "SELECT p_brand AS track, count(*) AS runs, CAST(sum(p_size) AS BIGINT) AS samples, CAST(sum(p_size * (1 + p_partkey % 7)) AS BIGINT) AS total FROM part GROUP BY p_brand")
def table_totals(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("track").agg(F.count(F.lit(1)).alias("runs"), F.sum("count").alias("samples"), F.sum(F.col("count") * F.col("delta")).alias("total"))


@query("e6_completed_times", "SELECT user_id AS stream, max(CASE WHEN event_id % 50 > 0 THEN event_id % 997 END) AS last_pts, bool_or(event_id % 50 = 0) AS some_missing FROM events GROUP BY user_id")
def completed_times(spark, sf_dir):
    return summaries.completed_times(_events(spark, sf_dir, "case when event_id % 50 > 0 then event_id % 997 end as pts"), ["stream"], "pts")


@query("e7_symbol_counts", "SELECT l_returnflag AS frame, l_linenumber AS symbol, CAST(sum(l_partkey % 11) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def symbol_counts(spark, sf_dir):
    tiles = _table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as frame", "l_linenumber as symbol", "l_partkey % 11 as uses")
    return summaries.merge_symbol_counts(tiles, ["frame"], "symbol", "uses")


@query("e10_benchmark_median", "SELECT event_type, median(CAST(event_id AS DOUBLE)) AS median FROM events GROUP BY event_type")
def benchmark_median(spark, sf_dir):
    return selection.medians(_table(spark, sf_dir, "events"), ["event_type"], "event_id")


@query("f2_format_changes", "SELECT user_id AS stream, event_id AS i, CASE WHEN event_id % 5 > 0 THEN event_type END AS format, NOT (CASE WHEN event_id % 5 > 0 THEN event_type END IS NOT DISTINCT FROM lag(CASE WHEN event_id % 5 > 0 THEN event_type END) OVER w) OR row_number() OVER w = 1 AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def format_changes(spark, sf_dir):
    return streams.format_changes(_events(spark, sf_dir, "case when event_id % 5 > 0 then event_type end as format"), ["stream"], ["i"], ["format"])


@query("f3_epochs", "SELECT user_id AS stream, event_id AS i, event_type, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS epoch FROM events")
def epochs(spark, sf_dir):
    return streams.number_groups(_events(spark, sf_dir, "event_type"), ["stream"], ["i"], F.col("event_type") == "signup", "epoch")


_SLICE = ["event_id div 40 % 16 as frame_num", "0 as pps_id", "0 as sps_id", "event_id % 13 < 6 as is_field", "event_id % 2 = 0 as is_bottom", "event_id % 4 as ref_idc", "event_type = 'signup' as is_idr", "event_id % 3 as idr_pic_id", "event_id div 60 as poc_lsb", "0 as delta_bottom", "event_type = 'error' as after_mark"]


@query(
    "f4_access_units",
    "WITH e AS (SELECT user_id AS stream, event_id AS i, " + ", ".join(_SLICE).replace(" div ", " // ") + " FROM events), "
    "p AS (SELECT stream, i, CASE WHEN row_number() OVER w = 1 OR after_mark OR frame_num <> lag(frame_num) OVER w OR is_field <> lag(is_field) OVER w OR is_idr <> lag(is_idr) OVER w OR poc_lsb <> lag(poc_lsb) OVER w OR (ref_idc = 0) <> (lag(ref_idc) OVER w = 0) "
    "OR (is_field AND lag(is_field) OVER w AND is_bottom <> lag(is_bottom) OVER w) OR (is_idr AND lag(is_idr) OVER w AND idr_pic_id <> lag(idr_pic_id) OVER w) THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY stream ORDER BY i)) SELECT stream, i, fresh = 1 AS new_picture, CAST(sum(fresh) OVER (PARTITION BY stream ORDER BY i) AS BIGINT) AS picture_id FROM p",
)
def access_units(spark, sf_dir):
    return streams.access_units(_events(spark, sf_dir, *_SLICE), ["stream"], ["i"]).select("stream", "i", "new_picture", "picture_id")


_PICTURES = """SELECT user_id AS stream, event_id AS i, event_id // 20 % 16 AS fn, event_id % 16 AS lsb, event_type <> 'view' AS ref, event_id % 37 = 0 AS idr,
    event_id % 11 = 0 AND event_type <> 'view' AND event_id % 37 <> 0 AS reset, event_id % 5 - 2 AS delta, event_id % 13 < 3 AS field, event_id % 2 = 0 AS bottom_field FROM events"""


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures with references, IDR pictures, resets, and fields among frames."""
    return _events(
        spark, sf_dir, "event_id div 20 % 16 as fn", "event_id % 16 as lsb", "event_type <> 'view' as ref", "event_id % 37 = 0 as idr",
        "event_id % 11 = 0 and event_type <> 'view' and event_id % 37 <> 0 as reset", "event_id % 5 - 2 as delta", "event_id % 13 < 3 as field", "event_id % 2 = 0 as bottom_field",
    )


@query(
    "f5_order_counts_by_lsb",
    f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY i) AS n FROM ({_PICTURES})),
    r AS (
      SELECT stream, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS v, CAST(NULL AS BIGINT) AS delta, false AS field, false AS bottom_field,
             CAST(0 AS BIGINT) AS msb, CAST(0 AS BIGINT) AS prev FROM p GROUP BY stream
      UNION ALL
      SELECT stream, n, i, m + lsb, delta, field, bottom_field,
             CASE WHEN NOT ref THEN msb WHEN reset THEN 0 ELSE m END,
             CASE WHEN NOT ref THEN prev WHEN reset THEN CASE WHEN field THEN 0 ELSE greatest(0, -delta) END ELSE lsb END
      FROM (
        SELECT *, CASE WHEN prev - lsb >= 8 THEN msb + 16 WHEN lsb - prev > 8 THEN msb - 16 ELSE msb END AS m
        FROM (SELECT p.*, CASE WHEN p.idr THEN 0 ELSE r.msb END AS msb, CASE WHEN p.idr THEN 0 ELSE r.prev END AS prev FROM r JOIN p ON p.stream = r.stream AND p.n = r.n + 1)))
    SELECT stream, i, CAST(CASE WHEN NOT (field AND bottom_field) THEN v END AS BIGINT) AS top,
           CAST(CASE WHEN NOT field THEN v + delta WHEN bottom_field THEN v END AS BIGINT) AS bottom FROM r WHERE n > 0""",
)
def order_counts_by_lsb(spark, sf_dir):
    rows = pictures.order_counts_by_lsb(_pictures(spark, sf_dir), ["stream"], ["i"], "lsb", 16, "ref", "idr", "reset", "delta", "field", "bottom_field")
    return rows.select("stream", "i", "top", "bottom")


@query("f5_unwrapped_order_counts", "WITH e AS (SELECT user_id AS stream, event_id AS i, event_id % 16 AS lsb FROM events), s AS (SELECT *, lsb - lag(lsb) OVER (PARTITION BY stream ORDER BY i) AS d FROM e) SELECT stream, i, lsb, CAST(lsb + 16 * sum(CASE WHEN -d >= 8 THEN 1 WHEN d > 8 THEN -1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY i) AS BIGINT) AS unwrapped FROM s")
def unwrapped_counters(spark, sf_dir):
    return streams.unwrap(_events(spark, sf_dir, "event_id % 16 as lsb"), ["stream"], ["i"], "lsb", 16)


@query("f8_reference_slots", "SELECT user_id AS stream, event_id AS i, event_id % 256 AS refresh, " + ", ".join(f"max(CASE WHEN ((event_id % 256) >> {k}) & 1 = 1 THEN event_id END) OVER w AS slot{k}" for k in range(8)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def reference_slots(spark, sf_dir):
    return streams.last_writers(_events(spark, sf_dir, "event_id % 256 as refresh"), ["stream"], ["i"], "i", "refresh")


@query("f9_cache_hits", "WITH e AS (SELECT user_id AS stream, event_id AS i, CAST(floor(value) AS BIGINT) % 12 AS block FROM events), p AS (SELECT *, lag(i) OVER (PARTITION BY stream, block ORDER BY i) AS last_i FROM e) SELECT stream, i, block, coalesce((SELECT count(DISTINCT q.block) FROM e q WHERE q.stream = p.stream AND q.i > p.last_i AND q.i < p.i) < 4, false) AND last_i IS NOT NULL AS hit FROM p")
def cache_hits(spark, sf_dir):
    return streams.cache_hits(_events(spark, sf_dir, "cast(floor(value) as bigint) % 12 as block"), ["stream"], ["i"], "block", 4)


@query("e4_cache_statistics", "WITH e AS (SELECT user_id AS stream, event_id AS i, CAST(floor(value) AS BIGINT) % 12 AS block FROM events), p AS (SELECT *, lag(i) OVER (PARTITION BY stream, block ORDER BY i) AS last_i FROM e), h AS (SELECT stream, coalesce((SELECT count(DISTINCT q.block) FROM e q WHERE q.stream = p.stream AND q.i > p.last_i AND q.i < p.i) < 4, false) AND last_i IS NOT NULL AS hit FROM p) SELECT stream, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, CAST(4096 * count(*) FILTER (WHERE NOT hit) AS BIGINT) AS fetched FROM h GROUP BY stream")
def cache_statistics(spark, sf_dir):
    return summaries.cache_statistics(cache_hits(spark, sf_dir).withColumn("size", F.lit(4096)), ["stream"], "hit", "size")


@query("f10_prefetch_span", "WITH s AS (SELECT user_id AS stream, event_id AS i, event_id * 10 AS start_, event_id * 10 + event_id % 7 AS end_ FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY i) AS n, CAST(max(end_) OVER (PARTITION BY stream ORDER BY i) - min(start_) OVER (PARTITION BY stream ORDER BY i) AS BIGINT) AS span FROM s) SELECT stream, i, start_, end_, span FROM r WHERE n = 1 OR span <= 9000")
def prefetch_span(spark, sf_dir):
    return streams.pack_spans(_events(spark, sf_dir, "event_id * 10 as start_", "event_id * 10 + event_id % 7 as end_"), ["stream"], ["i"], "start_", "end_", 9000)


@query("f12_monotonic", "SELECT stream, bool_and(coalesce(ok, true)) AS monotonic FROM (SELECT user_id AS stream, event_id // 100 >= lag(event_id // 100) OVER (PARTITION BY user_id ORDER BY event_id % 9000, event_id) AS ok FROM events) GROUP BY stream")
def monotonic(spark, sf_dir):
    return streams.is_monotonic(_events(spark, sf_dir, "event_id div 100 as t", "event_id % 9000 as o"), ["stream"], ["o", "i"], "t")


@query(
    "f13_checkpoint_spacing",
    "WITH RECURSIVE e AS (SELECT user_id AS stream, event_id AS i FROM events), k AS (SELECT stream, min(i) AS i FROM e GROUP BY stream UNION ALL SELECT k.stream, (SELECT min(e.i) FROM e WHERE e.stream = k.stream AND e.i >= k.i + 500) FROM k WHERE k.i IS NOT NULL) "
    "SELECT e.stream, e.i, k.i IS NOT NULL AS retained FROM e LEFT JOIN k ON k.stream = e.stream AND k.i = e.i",
)
def checkpoint_spacing(spark, sf_dir):
    return streams.retain_rising(_events(spark, sf_dir), ["stream"], "i", 500, bucket=4096)


@query("g3_drained_order", "SELECT user_id AS stream, event_id AS i, CAST(row_number() OVER (PARTITION BY user_id ORDER BY floor(value * 1000), event_id) - 1 AS BIGINT) AS output_index FROM events")
def drained_order(spark, sf_dir):
    """A buffer that is as deep as the stream is long gives a full sort."""
    rows = _events(spark, sf_dir, "cast(floor(value * 1000) as bigint) as poc")
    return streams.drained_order(rows, ["stream"], ["i"], "poc").drop("poc")


@query("g8_frame_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def frame_limit(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "g9_seek_plan",
    "WITH s AS (SELECT user_id AS track, event_id AS sample_index, event_id + (event_id * 7) % 5 AS pts, event_type = 'purchase' AS sync FROM events), k AS (SELECT track, sample_index, pts, lead(sample_index) OVER (PARTITION BY track ORDER BY sample_index) AS nxt FROM s WHERE sync), "
    "t AS (SELECT DISTINCT user_id AS track, event_id AS target FROM events), p AS (SELECT t.track, target, (SELECT k.sample_index FROM k WHERE k.track = t.track AND k.pts <= target ORDER BY k.pts DESC, k.sample_index LIMIT 1) AS keyframe_index FROM t), "
    "w AS (SELECT p.track, target, keyframe_index, s.sample_index, s.pts FROM p JOIN k ON k.track = p.track AND k.sample_index = p.keyframe_index JOIN s ON s.track = p.track AND s.sample_index >= keyframe_index AND (k.nxt IS NULL OR s.sample_index <= k.nxt)), "
    "c AS (SELECT track, target, keyframe_index, min(struct_pack(pts := pts, i := sample_index)) AS m FROM w WHERE pts >= target GROUP BY ALL) SELECT c.track, c.target, c.keyframe_index, c.m.i AS selected_index, max(w.sample_index) - c.keyframe_index + 1 AS required FROM c JOIN w ON w.track = c.track AND w.target = c.target WHERE w.pts <= c.m.pts GROUP BY c.track, c.target, c.keyframe_index, c.m.i",
)
def seek_plan(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    samples = events.selectExpr("user_id as track", "event_id as sample_index", "event_id + (event_id * 7) % 5 as pts", "event_type = 'purchase' as sync")
    return seek.seek_plan(events.selectExpr("user_id as track", "event_id as target"), samples, ["track"], bucket=4096)


@query("g10_seek_source", "SELECT event_id AS i, CASE WHEN CASE WHEN event_id % 4 > 0 THEN event_id % 29 END >= greatest(event_id % 17, coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 23 END, event_id % 17)) THEN 'Forward' WHEN CASE WHEN event_id % 3 > 0 THEN event_id % 23 END > event_id % 17 THEN 'Checkpoint' ELSE 'Keyframe' END AS source FROM events")
def seek_source(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr("event_id as i", "event_id % 17 as k", "case when event_id % 3 > 0 then event_id % 23 end as c", "case when event_id % 4 > 0 then event_id % 29 end as f")
    return rows.select("i", seek.choose_source(F.col("k"), F.col("c"), F.col("f")).alias("source"))


@query("h1_append_fragments", "WITH t AS (SELECT p_brand AS track, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_size AS size FROM part WHERE p_partkey % 2 = 0), f AS (SELECT p_brand AS track, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_size AS size FROM part WHERE p_partkey % 2 = 1) SELECT track, CAST(i AS BIGINT) AS i, size FROM t UNION ALL SELECT track, CAST(f.i + coalesce((SELECT max(t.i) + 1 FROM t WHERE t.track = f.track), 0) AS BIGINT), size FROM f")
def append_fragments(spark, sf_dir):
    one = F.lit(1).cast("long")
    table, fragments = (runs.expand_runs(_table(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == k).select(F.col("p_brand").alias("track"), "p_partkey", one.alias("n"), F.col("p_size").alias("size")), ["track"], ["p_partkey"], "n", ["size"]).withColumnRenamed("sample_index", "i") for k in (0, 1))
    return summaries.append_numbered(table, fragments, ["track"], "i")


@query("h2_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return summaries.duplicate_keys(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("h3_upsert", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def upsert(spark, sf_dir):
    return summaries.latest_by_key(_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("i1_compare_times", "SELECT o_orderkey AS i, CAST(sign(CAST(o_orderkey AS HUGEINT) * (1 + o_orderkey % 5) - CAST(o_custkey AS HUGEINT) * (1 + o_custkey % 7)) AS INTEGER) AS side FROM orders")
def compare_times(spark, sf_dir):
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    return _table(spark, sf_dir, "orders").select(key.alias("i"), media.compare_times(media.media_time(key, 1 + other % 7), media.media_time(other, 1 + key % 5)).alias("side"))


@query("i11_nal_headers", "SELECT o_orderkey AS i, CASE WHEN o_orderkey % 256 < 128 THEN (o_orderkey % 256) >> 5 & 3 END AS ref_idc, CASE WHEN o_orderkey % 256 < 128 THEN (o_orderkey % 256) & 31 END AS type FROM orders")
def nal_headers(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), scalars.nal_header(F.col("o_orderkey") % 256).alias("h"))
    return rows.select("i", "h.ref_idc", "h.type")


@query("k20_running_qp", "SELECT user_id AS stream, event_id AS i, CAST(((26 + sum(event_id % 53 - 26) OVER (PARTITION BY user_id ORDER BY event_id)) % 52 + 52) % 52 AS BIGINT) AS qp FROM events")
def running_qp(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_id % 53 - 26 as delta")
    return rows.selectExpr("stream", "i", "pmod(26 + sum(delta) over (partition by stream order by i), 52) as qp")


_WHOLE = f"""WITH e AS ({_PICTURES}), g AS (SELECT *, sum(CASE WHEN idr THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY i) AS epoch FROM e),
    o AS (SELECT *, CASE WHEN lag(fn) OVER (PARTITION BY stream, epoch ORDER BY i) > fn THEN 1 ELSE 0 END AS turn FROM g),
    a AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY stream, epoch ORDER BY i) * 16 + fn AS BIGINT) AS abs_frame_num FROM o)"""


def _whole_frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.whole_frame_numbers(_pictures(spark, sf_dir), ["stream"], ["i"], "fn", 16, "idr")


@query(
    "f6_order_counts_by_cycle",
    f"""{_WHOLE}, w AS (SELECT *, CASE WHEN idr THEN 0 WHEN NOT ref AND abs_frame_num > 0 THEN abs_frame_num - 1 ELSE abs_frame_num END AS n FROM a)
    SELECT stream, i, abs_frame_num, CAST(CASE WHEN n > 0 THEN (n - 1) // 3 * 9 + [2, 5, 9][(n - 1) % 3 + 1] ELSE 0 END + CASE WHEN ref THEN 0 ELSE -1 END AS BIGINT) AS poc FROM w""",
)
def order_counts_by_cycle(spark, sf_dir):
    poc = pictures.order_count_by_cycle(F.col("abs_frame_num"), F.col("ref"), F.col("idr"), [2, 3, 4], -1, F.lit(0))
    return _whole_frame_numbers(spark, sf_dir).select("stream", "i", "abs_frame_num", poc.alias("poc"))


@query("f7_order_counts_by_frame", f"{_WHOLE} SELECT stream, i, CAST(CASE WHEN idr THEN 0 ELSE 2 * abs_frame_num - CASE WHEN ref THEN 0 ELSE 1 END END AS BIGINT) AS poc FROM a")
def order_counts_by_frame(spark, sf_dir):
    return _whole_frame_numbers(spark, sf_dir).select("stream", "i", pictures.order_count_by_frame(F.col("abs_frame_num"), F.col("ref"), F.col("idr")).alias("poc"))


@query(
    "f11_retained_references",
    """WITH e AS (SELECT user_id AS stream, event_id AS i, event_type IN ('purchase', 'signup') OR event_id % 37 = 0 AS ref, event_id % 37 = 0 AS idr FROM events),
    g AS (SELECT *, sum(CASE WHEN idr THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY i) AS epoch FROM e),
    h AS (SELECT stream, i, list(i) FILTER (WHERE ref) OVER (PARTITION BY stream, epoch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refs FROM g)
    SELECT stream, i, coalesce(array_to_string(list_reverse(refs[-4:]), ','), '') AS held FROM h""",
)
def retained_references(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_type in ('purchase', 'signup') or event_id % 37 = 0 as ref", "event_id % 37 = 0 as idr")
    held = pictures.retained_references(rows, ["stream"], ["i"], "i", "ref", 4, "idr")
    return held.select("stream", "i", F.array_join(F.col("references").cast("array<string>"), ",").alias("held"))


@query(
    "d1_parameter_sets",
    'WITH e AS (SELECT user_id AS stream, event_id AS i, event_type, event_id % 3 AS pps_id, event_id % 2 AS sps_id FROM events), p AS (SELECT stream, i, pps_id, (SELECT max(s.i) FROM e s WHERE s.event_type = \'signup\' AND s.stream = e.stream AND s.sps_id = e.sps_id AND s.i < e.i) AS sps_at FROM e WHERE event_type = \'purchase\'), '
    'l AS (SELECT stream, i, pps_id, (SELECT max(p.i) FROM p WHERE p.stream = e.stream AND p.pps_id = e.pps_id AND p.i < e.i) AS pps_at FROM e WHERE event_type = \'click\') SELECT l.stream, l.i AS "at", l.pps_id, l.pps_at, p.sps_at FROM l LEFT JOIN p ON p.stream = l.stream AND p.i = l.pps_at',
)
def parameter_sets(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr("user_id as stream", "event_id as at", "event_type", "event_id % 3 as pps_id", "event_id % 2 as sps_id")
    of = lambda kind, *columns: rows.where(F.col("event_type") == kind).select("stream", "at", *columns)
    return pictures.bind_parameter_sets(of("click", "pps_id"), of("purchase", "pps_id", "sps_id"), of("signup", "sps_id"), ["stream"])


@query("g4_reorder_depth", "SELECT o_orderkey AS i, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 END, CASE WHEN [66, 77, 100][o_orderkey % 3 + 1] = 66 THEN 0 ELSE o_custkey % 16 END) AS depth FROM orders")
def reorder_depth(spark, sf_dir):
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    profile = F.element_at(F.array(*map(F.lit, (66, 77, 100))), (key % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "orders").select(key.alias("i"), pictures.reorder_depth(F.when(key % 4 == 0, key % 5), profile, other % 16).alias("depth"))


@query("g5_reference_lists")
def reference_lists(spark, sf_dir):
    """Lists of each event with the up to six events of its user before it as a reference buffer; held against plain Python in the tests."""
    buffers = _held(spark, sf_dir).withColumnsRenamed({"stream": "user_id", "i": "event_id"})
    both = buffers.select("user_id", "event_id", pictures.p_list(F.col("held"), F.lit(8), 16).alias("p"), pictures.b_lists(F.col("held"), F.lit(30)).alias("b"))
    return both.select("user_id", "event_id", "p", "b.list0", "b.list1", pictures.active_list(F.col("p"), F.lit(4), F.slice("p", 3, 2)).alias("active"))


_HELD_SQL = """WITH e AS (SELECT user_id AS stream, event_id AS i, event_id % 16 AS f, list(struct_pack(id := event_id, fn := event_id % 16, poc := event_id * 7 % 64, lg := CASE WHEN event_id % 5 = 0 THEN event_id % 3 END))
        OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS held FROM events)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, i, f (a frame number below 16) and held: the up to six events of the user before it as a reference buffer."""
    entry = F.struct(F.col("event_id").alias("id"), (F.col("event_id") % 16).alias("frame_num"), (F.col("event_id") * 7 % 64).alias("poc"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 3).cast("int").alias("long_index"))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-6, -1)
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("i"), (F.col("event_id") % 16).alias("f"), F.collect_list(entry).over(before).alias("held"))


@query(
    "d13_references_by_number",
    _HELD_SQL
    + """, n AS (SELECT *, CASE WHEN i * 5 % 16 > f THEN i * 5 % 16 - 16 ELSE i * 5 % 16 END AS number FROM e)
    SELECT stream, i, [x.id for x in coalesce(held, []) if x.lg IS NULL AND CASE WHEN x.fn > f THEN x.fn - 16 ELSE x.fn END = number][1] AS short_term,
           [x.id for x in coalesce(held, []) if x.lg = i % 3][1] AS long_term FROM n""",
)
def references_by_number(spark, sf_dir):
    rows = _held(spark, sf_dir)
    short = pictures.short_term_by_number(F.col("held"), F.col("f"), 16, F.col("i") * 5 % 16)
    return rows.select("stream", "i", short["id"].alias("short_term"), pictures.long_term_by_index(F.col("held"), F.col("i") % 3)["id"].alias("long_term"))


@query(
    "d14_entries_of_list",
    _HELD_SQL + """ SELECT stream, i, array_to_string(list_append([CAST(x.poc AS VARCHAR) for x in list_reverse(coalesce(held, []))], '-'), ',') AS counts FROM e""",
)
def entries_of_list(spark, sf_dir):
    ids = F.concat(F.transform(F.reverse("held"), lambda x: x["id"]), F.array(F.col("i")))
    found = F.transform(pictures.entries_of_list(ids, F.col("held")), lambda x: x["poc"].cast("string"))
    return _held(spark, sf_dir).select("stream", "i", F.array_join(found, ",", "-").alias("counts"))


@query(
    "d3_track_by_index",
    """SELECT o_orderkey AS request, o_orderkey % 30 - 2 AS wanted, n_name AS name, CASE WHEN n_nationkey IS NULL THEN 'invalid: track index is out of range' END AS error
    FROM orders LEFT JOIN nation ON n_regionkey = o_custkey % 5 AND n_nationkey = o_orderkey % 30 - 2""",
)
def track_by_index(spark, sf_dir):
    requests = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as request", "o_custkey % 5 as file", "o_orderkey % 30 - 2 as wanted")
    tracks = _table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey as bigint) as file", "cast(n_nationkey as bigint) as track_index", "n_name as name")
    return packets.track_by_index(requests, tracks, ["file"], "wanted", ["name"]).drop("file")


@query("i4_pcm_durations", "SELECT o_orderkey AS i, CASE WHEN o_custkey % 4 > 0 THEN o_orderkey END AS ticks, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 * 11025 END AS timescale FROM orders")
def pcm_durations(spark, sf_dir):
    time = audio.duration_of_frames(F.col("o_orderkey"), F.col("o_custkey") % 4 * 11025)
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), time["value"].alias("ticks"), time["timescale"].alias("timescale"))


@query("j12_seek_modes", f"SELECT *, CASE WHEN required > 4 + target % 8 THEN 'Preview' ELSE 'Exact' END AS mode FROM ({ORACLE_SQL['g9_seek_plan']})")
def seek_modes(spark, sf_dir):
    return seek_plan(spark, sf_dir).withColumn("mode", seek.seek_mode(F.col("required"), 4 + F.col("target") % 8))


@query("i5_audio_frames", "SELECT o_orderkey AS i, CASE WHEN o_orderkey % 50 - 5 >= 0 THEN CAST((o_orderkey % 50 - 5) * 44100 // (1 + o_custkey % 1000) AS BIGINT) END AS frames FROM orders")
def audio_frames(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), audio.frames_of_duration(F.col("o_orderkey") % 50 - 5, 1 + F.col("o_custkey") % 1000, 44100).alias("frames"))


@query("k16_implicit_weights", "WITH e AS (SELECT event_id AS i, event_id % 40 - 20 AS c, event_id % 23 - 11 AS f, event_id % 31 - 15 AS s FROM events), d AS (SELECT *, least(greatest(s - f, -128), 127) AS td, least(greatest(c - f, -128), 127) AS tb FROM e), x AS (SELECT *, CASE WHEN td <> 0 THEN CAST(trunc((16384 + abs(td) // 2) / td) AS BIGINT) END AS tx FROM d), w AS (SELECT i, s = f AS same, CAST(floor((tb * tx + 32) / 256.0) AS BIGINT) AS w FROM x) SELECT i, CAST(CASE WHEN same OR w IS NULL OR w < -64 OR w > 128 THEN 32 ELSE w END AS INTEGER) AS weight FROM w")
def implicit_weights(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr("event_id as i", "event_id % 40 - 20 as c", "event_id % 23 - 11 as f", "event_id % 31 - 15 as s")
    return rows.select("i", scalars.implicit_weight(F.col("c"), F.col("f"), F.col("s")).alias("weight"))


@query("j3_timelines", "SELECT user_id AS stream, event_id AS i, CAST(sum(CASE WHEN event_id % 101 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS timeline FROM events")
def timelines(spark, sf_dir):
    return streams.number_groups(_events(spark, sf_dir), ["stream"], ["i"], F.col("i") % 101 == 0, "timeline")


@query("j13_cursor", "SELECT user_id AS stream, event_id AS i FROM events WHERE event_id >= (user_id * 37) % 9000")
def cursor(spark, sf_dir):
    return _events(spark, sf_dir).where("i >= (stream * 37) % 9000")


@query("j19_service_times", "WITH e AS (SELECT user_id AS stream, event_id AS i, event_type, event_id % 83 AS d FROM events), g AS (SELECT *, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frame FROM e) SELECT stream, CAST(frame AS BIGINT) AS frame, CAST(sum(d) AS BIGINT) AS service FROM g GROUP BY stream, frame HAVING bool_or(event_type = 'view')")
def service_times(spark, sf_dir):
    return streams.service_until_output(_events(spark, sf_dir, "event_type = 'view' as is_output", "event_id % 83 as d"), ["stream"], ["i"], "is_output", "d")


@query("c1_packets", "WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id AS stream, event_id AS i, CAST(event_id * 3 - n AS BIGINT) AS pts, CAST(event_id - n AS BIGINT) AS dts, CAST(1000 + user_id % 5 AS BIGINT) AS timescale FROM events JOIN t USING (user_id)")
def timed_packets(spark, sf_dir):
    samples = _events(spark, sf_dir, "event_id * 3 as pts", "event_id as dts")
    timelines = samples.groupBy("stream").agg((-F.count(F.lit(1))).alias("offset")).selectExpr("stream", "offset", "1000 + stream % 5 as timescale")
    return packets.packets(samples, timelines, ["stream"])


@query("c2_track_kinds", "SELECT c_custkey AS track, CASE handler WHEN 'vide' THEN 'Video' WHEN 'soun' THEN 'Audio' WHEN 'text' THEN 'Subtitle' WHEN 'clcp' THEN 'Subtitle' WHEN 'sbtl' THEN 'Subtitle' WHEN 'subt' THEN 'Subtitle' WHEN 'meta' THEN 'Metadata' ELSE 'Unknown' END AS kind FROM (SELECT c_custkey, ['vide', 'soun', 'text', 'meta', 'hint', 'clcp', 'sbtl', 'subt'][c_custkey % 8 + 1] AS handler FROM customer)")
def track_kinds(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey as track", "element_at(array('vide', 'soun', 'text', 'meta', 'hint', 'clcp', 'sbtl', 'subt'), cast(c_custkey % 8 + 1 as int)) as handler")
    return rows.select("track", scalars.track_kind(F.col("handler")).alias("kind"))


@query("c8_visible_frames", "SELECT user_id AS stream, event_id AS i FROM events WHERE event_type IN ('view', 'click')")
def visible_frames(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_type = 'view' as show", "case when event_type <> 'signup' then event_type = 'click' end as show_existing")
    return rows.where(packets.is_shown(F.col("show"), F.col("show_existing"))).select("stream", "i")


@query("c9_unit_kinds", "SELECT i, CASE WHEN t IN (1, 5) THEN 'slice' WHEN t IN (2, 3, 4, 20, 21) THEN 'unsupported' WHEN t = 7 THEN 'sequence_parameters' WHEN t = 8 THEN 'picture_parameters' WHEN t = 9 THEN 'delimiter' WHEN t = 10 THEN 'end_of_sequence' WHEN t = 11 THEN 'end_of_stream' ELSE 'ignored' END AS kind FROM (SELECT o_orderkey AS i, o_orderkey % 32 AS t FROM orders)")
def unit_kinds(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), scalars.nal_kind(F.col("o_orderkey") % 32).alias("kind"))


@query("c10_constant_descriptions", "SELECT o_custkey AS track, count(DISTINCT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '')) = 1 AS constant FROM orders GROUP BY o_custkey")
def constant_descriptions(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").selectExpr("o_custkey as track", "case when o_orderstatus <> 'P' then o_orderstatus end as description")
    return packets.keeps_description(rows, ["track"], "description")


@query("d2_descriptions", "SELECT o_orderkey AS sample, s.track, s.description, n_name AS format, CASE WHEN n_name IS NULL THEN 'invalid: no such description' END AS error FROM (SELECT o_orderkey, CAST(o_custkey % 25 AS BIGINT) AS track, CAST(o_orderkey % 5 AS BIGINT) AS description FROM orders) s LEFT JOIN nation ON n_nationkey = s.track AND n_regionkey = s.description")
def descriptions(spark, sf_dir):
    samples = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as sample", "o_custkey % 25 as track", "o_orderkey % 5 as description")
    known = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as track", "cast(n_regionkey as bigint) as description", "n_name as format")
    return packets.with_description(samples, known, ["track"], ["format"])


@query("d4_fragments_of_tracks", "SELECT f.fragment, f.track_id, r_regionkey * 10 AS default_duration, CASE WHEN n_nationkey IS NULL THEN 'invalid: unknown track' END AS error FROM (SELECT c_custkey AS fragment, CAST(c_custkey % 30 AS INTEGER) AS track_id FROM customer) f LEFT JOIN nation ON n_nationkey = f.track_id LEFT JOIN region ON r_regionkey = f.track_id WHERE n_nationkey IS NULL OR n_regionkey > 0")
def fragments_of_tracks(spark, sf_dir):
    fragments = _table(spark, sf_dir, "customer").selectExpr("c_custkey as fragment", "cast(c_custkey % 30 as int) as track_id")
    known = _table(spark, sf_dir, "nation").selectExpr("n_nationkey as track_id", "n_regionkey as descriptions")
    defaults = _table(spark, sf_dir, "region").selectExpr("r_regionkey as track_id", "r_regionkey * 10 as duration")
    return packets.fragments_of_tracks(fragments, known, defaults, ["duration"])


@query("d15_resolved_references", "WITH s AS (SELECT user_id AS stream, event_id AS i, [" + ", ".join(f"max(CASE WHEN ((event_id % 256) >> {k}) & 1 = 1 THEN event_id END) OVER w" for k in range(8)) + "] AS slots FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), r AS (SELECT stream, i, slots[i % 8 + 1] AS ref0, slots[i // 8 % 8 + 1] AS ref1, slots[i // 64 % 8 + 1] AS ref2 FROM s) SELECT *, CASE WHEN ref0 IS NULL OR ref1 IS NULL OR ref2 IS NULL THEN 'invalid: missing reference' END AS error FROM r")
def resolved_references(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_id % 256 as refresh", "event_id % 8 as a", "event_id div 8 % 8 as b", "event_id div 64 % 8 as c")
    return packets.resolve_references(rows, ["stream"], ["i"], "i", "refresh", ["a", "b", "c"]).drop("refresh", "a", "b", "c")


@query("e3_visible_bytes", "SELECT p_brand AS run, count(*) AS frames, CAST(sum(w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2)) AS BIGINT) AS bytes FROM (SELECT p_brand, 3 * p_size AS w, 2 * p_size + 1 AS h FROM part) GROUP BY p_brand")
def visible_bytes(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), packets.visible_bytes(3 * F.col("p_size"), 2 * F.col("p_size") + 1).alias("bytes"))
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("frames"), F.sum("bytes").alias("bytes"))


@query("e5_retained_bytes", "SELECT p_brand AS buffer, CAST(least(sum(CAST(p_partkey AS HUGEINT) * 100000000000000), 9223372036854775807) AS BIGINT) AS retained FROM part GROUP BY p_brand")
def retained_bytes(spark, sf_dir):
    return packets.retained_bytes(_table(spark, sf_dir, "part").selectExpr("p_brand as buffer", "cast(p_partkey as decimal(19,0)) * 100000000000000 as size"), ["buffer"], "size")


@query("e8_syntax_totals", "SELECT l_suppkey AS frame, count(*) AS blocks, CAST(sum(l_linenumber) AS BIGINT) AS coefficients, CAST(sum(abs(l_partkey % 9 - 4)) AS BIGINT) AS magnitude FROM lineitem GROUP BY l_suppkey")
def syntax_totals(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("frame")).agg(F.count(F.lit(1)).alias("blocks"), F.sum("l_linenumber").alias("coefficients"), F.sum(F.abs(F.col("l_partkey") % 9 - 4)).alias("magnitude"))


@query("f1_sync_index", "SELECT user_id AS stream, event_id AS i, event_id // 16 AS t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id // 16, event_id) - 1 AS BIGINT) AS position FROM events WHERE event_type = 'purchase'")
def sync_index(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_id div 16 as t", "event_type = 'purchase' as sync")
    return packets.sync_index(rows, ["stream"], "t", "i", "sync").drop("sync")


def sample_file(version: int = 0) -> bytes:
    """A small MP4 with one track of video: five samples in two chunks, an edit list, and shifts of the given version."""
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    numbers = lambda *values: b"".join(v.to_bytes(4, "big") for v in values)
    listed = lambda kind, n, *values: box(kind, bytes(4) + numbers(n, *values))
    shifts = box(b"ctts", bytes([version, 0, 0, 0]) + numbers(2, 2, 10, 3, (-2 if version else 20) % (1 << 32)))
    tables = listed(b"stts", 2, 3, 100, 2, 50) + shifts + listed(b"stsc", 2, 1, 2, 1, 2, 3, 1) + box(b"stsz", bytes(4) + numbers(0, 5, 10, 11, 12, 13, 14)) + listed(b"stco", 2, 1000, 2000) + listed(b"stss", 2, 1, 4)
    media_box = box(b"mdhd", bytes(12) + numbers(15360, 350) + bytes(4)) + box(b"hdlr", bytes(8) + b"vide" + bytes(13)) + box(b"minf", box(b"stbl", tables))
    edit = lambda size, duration, start: duration.to_bytes(size, "big") + start.to_bytes(size, "big", signed=True) + numbers(1 << 16)
    edits = box(b"edts", box(b"elst", bytes([version, 0, 0, 0]) + numbers(2) + edit(8 if version else 4, 500, -1) + edit(8 if version else 4, 1000, 1024)))
    return box(b"ftyp", b"isom") + box(b"moov", box(b"trak", edits + box(b"mdia", media_box)))


@query(
    "i16_tile_bounds",
    """SELECT o_orderkey AS i, CAST(least((t * b8 >> lg) << 3, b) AS BIGINT) AS first_block, CAST(least(((t + 1) * b8 >> lg) << 3, b) AS BIGINT) AS end_block
    FROM (SELECT o_orderkey, o_custkey % 500 + 1 AS b, (o_custkey % 500 + 8) // 8 AS b8, o_orderkey % 4 AS lg, o_custkey % (1 << (o_orderkey % 4)) AS t FROM orders)""",
)
def tile_bounds(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as i", "o_custkey % 500 + 1 as b", "o_orderkey % 4 as lg", "o_custkey % shiftleft(1, cast(o_orderkey % 4 as int)) as t")
    bounds = scalars.tile_bounds(F.col("t"), F.col("b"), F.col("lg"))
    return rows.select("i", bounds["first"].alias("first_block"), bounds["end"].alias("end_block"))


@query(
    "i16_tile_ranges",
    """SELECT i, CASE WHEN wrong THEN 'truncated: tile payload' WHEN a * b * c = 0 THEN 'invalid: empty tile' END AS error,
           concat_ws(',', CASE WHEN NOT wrong AND a > 0 THEN concat(7, '-', 7 + a) END, CASE WHEN NOT wrong AND a > 0 AND b > 0 THEN concat(11 + a, '-', 11 + a + b) END,
                     CASE WHEN NOT wrong AND a * b * c > 0 THEN concat(11 + a + b, '-', 11 + a + b + c) END) AS ranges
    FROM (SELECT p_partkey AS i, p_size % 7 AS a, p_partkey % 5 AS b, p_partkey % 3 AS c, p_partkey % 11 = 0 AS wrong FROM part)""",
)
def tile_ranges(spark, sf_dir):
    part = _table(spark, sf_dir, "part").selectExpr("p_partkey as i", "cast(p_size % 7 as int) as a", "cast(p_partkey % 5 as int) as b", "cast(p_partkey % 3 as int) as c", "p_partkey % 11 = 0 as wrong")
    sized = "unhex(lpad(hex({0}), 8, '0'))"
    frame = f"concat(cast('abc' as binary), {sized.format('a + if(wrong, 100, 0)')}, cast(repeat('x', a) as binary), {sized.format('b')}, cast(repeat('y', b) as binary), cast(repeat('z', c) as binary)) as frame"
    found = part.selectExpr("i", frame, "3 as start", "3 as tiles").withColumn("found", scalars.tile_ranges("frame", "start", "tiles"))
    return found.selectExpr("i", "found.error as error", "array_join(transform(found.ranges, r -> concat(r.first, '-', r.end)), ',') as ranges")


@query(
    "i21_video_formats",
    """SELECT i, CASE WHEN planar AND (depth < 9 OR depth > 16 OR sx > 1) THEN 'invalid: depth or subsampling' WHEN cw = 0 THEN 'invalid: coded size is empty' WHEN vw = 0 THEN 'invalid: visible rectangle is empty'
           WHEN dw = 0 THEN 'invalid: display size is empty' WHEN x + vw >= 4294967296 THEN 'invalid: overflow' WHEN x + vw > cw THEN 'invalid: visible rectangle exceeds the coded size' END AS error
    FROM (SELECT l_orderkey * 8 + l_linenumber AS i, l_linenumber % 2 = 0 AS planar, l_partkey % 20 AS depth, l_suppkey % 3 AS sx, l_partkey % 40 AS cw, l_suppkey % 7 AS vw, l_orderkey % 5 AS dw,
                 CASE WHEN l_orderkey % 13 = 0 THEN 4294967295 ELSE l_orderkey % 30 END AS x FROM lineitem)""",
)
def video_formats(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber as i", "if(l_linenumber % 2 = 0, 'planar_yuv16', 'nv12') as pixels", "l_partkey % 20 as depth", "l_suppkey % 3 as sx", "l_partkey % 40 as cw", "l_suppkey % 7 as vw", "l_orderkey % 5 as dw", "if(l_orderkey % 13 = 0, 4294967295, l_orderkey % 30) as x")
    c, one, zero = F.col, F.lit(1), F.lit(0)
    return rows.select("i", scalars.video_format_error(c("pixels"), c("depth"), c("sx"), zero, (c("cw"), one), (c("x"), zero, c("vw"), one), (c("dw"), one)).alias("error"))


_RETARGET_SQL = """WITH o AS (SELECT user_id AS stream, event_id AS i, event_type = 'signup' AS format, CASE WHEN user_id % 3 > 0 OR event_id % 5 > 0 THEN event_id % 997 END AS pts FROM events),
    r AS (SELECT DISTINCT user_id AS stream, CASE WHEN user_id % 7 > 0 THEN user_id % 300 END AS current, CASE WHEN user_id % 10 = 0 THEN user_id % 300 ELSE user_id * 37 % 1400 END AS target, user_id % 11 = 0 AS draining FROM events),
    e AS (SELECT *, CASE WHEN current IS NULL THEN 'invalid: no exact seek is active' WHEN target < current THEN 'invalid: target lies before the current one' WHEN draining THEN 'invalid: stream is drained' END AS error FROM r),
    p AS (SELECT *, error IS NULL AND target > current AND NOT EXISTS (SELECT 1 FROM o WHERE o.stream = e.stream AND NOT o.format AND (o.pts IS NULL OR o.pts >= e.target)) AS clears FROM e)"""


def _retarget(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    outputs = _events(spark, sf_dir, "if(event_type = 'signup', 'Format', 'Frame') as kind", "if(user_id % 3 > 0 or event_id % 5 > 0, event_id % 997, null) as pts")
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    requests = users.selectExpr("user_id as stream", "if(user_id % 7 > 0, user_id % 300, null) as current", "if(user_id % 10 = 0, user_id % 300, user_id * 37 % 1400) as target", "user_id % 11 = 0 as draining")
    return outputs, seek.retarget_forward(outputs, requests, ["stream"])


@query("j8_forward_retarget", _RETARGET_SQL + " SELECT stream, error, CASE WHEN error IS NULL THEN target ELSE current END AS starts_at, clears, clears AND EXISTS (SELECT 1 FROM o WHERE o.stream = p.stream AND o.format) AS reannounces FROM p")
def forward_retarget(spark, sf_dir):
    return _retarget(spark, sf_dir)[1].select("stream", "error", "starts_at", "clears", "reannounces")


@query("c7_kept_outputs", _RETARGET_SQL + " SELECT stream, i FROM o JOIN p USING (stream) WHERE NOT clears AND (error IS NOT NULL OR target = current OR o.format OR pts IS NULL OR pts >= target)")
def kept_outputs(spark, sf_dir):
    outputs, plan = _retarget(spark, sf_dir)
    return seek.kept_outputs(outputs, plan, ["stream"]).select("stream", "i")


def described_file(count: int, *entries: bytes) -> bytes:
    """An MP4 of one track with the given sample entries and count."""
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    for kind, body in ((b"stsd", bytes(4) + count.to_bytes(4, "big") + b"".join(entries)), (b"stbl", b""), (b"minf", b""), (b"mdia", b""), (b"trak", b""), (b"moov", b"")):
        made = box(kind, body or made)
    return made


def video_entry(kind: bytes, width: int, height: int, *configurations: bytes) -> bytes:
    """A sample entry of video with its boxes of configuration."""
    body = bytes(24) + width.to_bytes(2, "big") + height.to_bytes(2, "big") + bytes(50)
    for c in configurations:
        body += (8 + len(c)).to_bytes(4, "big") + (b"vpcC" if kind == b"vp09" else b"avcC") + c
    return (8 + len(body)).to_bytes(4, "big") + kind + body

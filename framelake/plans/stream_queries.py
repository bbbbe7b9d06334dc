"""Queries over streams whose rows depend on one another: inherited sizes, mixed timescales, marked references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import time as media
from framelake.operators import asof, marking, reorder, sizes
from framelake.plans.queries import _events, _table, query

_SIZED = [
    "event_id % 256 as refresh", "event_id % 8 as a", "event_id div 8 % 8 as b", "event_id div 64 % 8 as c", "event_id % 5 > 0 and event_id % 2 = 0 as fa", "event_id % 5 > 0 and event_id % 3 = 0 as fb",
    "event_id % 5 > 0 as fc", "64 + event_id % 97 as width", "48 + event_id % 89 as height",
]


@query(
    "d16_inherited_sizes",
    f"""WITH RECURSIVE e AS (SELECT user_id AS stream, event_id AS i, {", ".join(_SIZED).replace(" div ", " // ")} FROM events),
    f AS MATERIALIZED (SELECT stream, i, refresh, width, height, CASE WHEN fa THEN a WHEN fb THEN b WHEN fc THEN c END AS source, row_number() OVER (PARTITION BY stream ORDER BY i) AS n FROM e),
    r AS (
      SELECT stream, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS i, CAST(NULL AS STRUCT(i BIGINT, w BIGINT, h BIGINT)) AS size_, list_transform(range(8), lambda k: CAST(NULL AS STRUCT(i BIGINT, w BIGINT, h BIGINT))) AS slots
      FROM (SELECT DISTINCT stream FROM f)
      UNION ALL
      SELECT stream, n, i, size_, CASE WHEN size_ IS NULL THEN slots ELSE list_transform(range(8), lambda k: CASE WHEN (refresh >> k) & 1 = 1 THEN size_ ELSE slots[k + 1] END) END
      FROM (SELECT f.stream, f.n, f.i, f.refresh, r.slots, CASE WHEN source IS NULL THEN struct_pack(i := f.i, w := width, h := height) ELSE r.slots[source + 1] END AS size_
            FROM r JOIN f ON f.stream = r.stream AND f.n = r.n + 1))
    SELECT stream, i, size_.i AS size_from, size_.w AS frame_width, size_.h AS frame_height, CASE WHEN size_ IS NULL THEN 'invalid: missing reference' END AS error FROM r WHERE n > 0""",
)
def inherited_sizes(spark, sf_dir):
    frames = _events(spark, sf_dir, *_SIZED)
    found = sizes.inherited_sizes(frames, ["stream"], "i", "refresh", ["a", "b", "c"], ["fa", "fb", "fc"], "width", "height", bucket=4096)
    return found.select("stream", "i", "size_from", "frame_width", "frame_height", "error")


def _mixed_times(spark, sf_dir):
    """Targets from orders and samples from parts, in timescales of 24 to 600 ticks a second; many times are equal in different timescales."""
    scale = lambda key: F.element_at(F.array(*map(F.lit, _SCALES)), (key % len(_SCALES) + 1).cast("int"))
    key, customer, part, size = F.col("o_orderkey"), F.col("o_custkey"), F.col("p_partkey"), F.col("p_size")
    targets = _table(spark, sf_dir, "orders").select((key % 20).alias("track"), key.alias("i"), media.media_time(key % 4000, scale(customer)).alias("at"))
    samples = _table(spark, sf_dir, "part").select((part % 20).alias("track"), part.alias("s_i"), media.media_time((part * 7) % 3000 - 40, scale(size)).alias("s_at"))
    return targets, samples


_SCALES = [24, 25, 30, 50, 60, 100, 120, 600]
_MIXED = f"""WITH t AS (SELECT o_orderkey % 20 AS track, o_orderkey AS i, o_orderkey % 4000 AS v, {_SCALES}[o_custkey % 8 + 1] AS ts FROM orders),
    s AS (SELECT p_partkey % 20 AS track, p_partkey AS s_i, (p_partkey * 7) % 3000 - 40 AS v, {_SCALES}[p_size % 8 + 1] AS ts FROM part)
    SELECT track, i, {{}} FROM t"""


def _mixed_sql(name: str, condition: str, order: str) -> str:
    pick = f"(SELECT {{}} FROM s WHERE s.track = t.track{condition} ORDER BY {order} LIMIT 1)"
    return ", ".join(f"CAST({pick.format(column)} AS BIGINT) AS {name}_{alias}" for column, alias in (("s.v", "value"), ("s.ts", "timescale"), ("s.s_i", "index")))


_TICKS = "{0}.v * (600 // {0}.ts)"
_S, _T = _TICKS.format("s"), _TICKS.format("t")


@query(
    "d12_mixed_timescales",
    _MIXED.format(
        ", ".join(
            [
                _mixed_sql("before", f" AND {_S} <= {_T}", f"{_S} DESC, s.s_i"),
                _mixed_sql("after", f" AND {_S} >= {_T}", f"{_S}, s.s_i"),
                _mixed_sql("last", f" AND {_S} < {_T}", f"{_S} DESC, s.s_i DESC"),
                _mixed_sql("nearest", "", f"abs({_S} - {_T}), {_S}, s.s_i"),
            ]
        )
    ),
)
def mixed_timescales(spark, sf_dir):
    """The four as-of lookups of samples and targets in different timescales."""
    targets, samples = _mixed_times(spark, sf_dir)
    found = asof.as_of_times(targets, samples, ["track"], "at", "s_at", "s_i", seconds=8, prefix="before")
    found = asof.as_of_times(found, samples, ["track"], "at", "s_at", "s_i", forward=True, seconds=8, prefix="after")
    found = asof.as_of_times(found, samples, ["track"], "at", "s_at", "s_i", strict=True, greatest_index=True, prefix="last")
    found = asof.nearest_times(found, samples, ["track"], "at", "s_at", "s_i", seconds=8)
    names = ["before", "after", "last", "nearest"]
    return found.select("track", "i", *(c for n in names for c in (F.col(f"{n}_time.value").alias(f"{n}_value"), F.col(f"{n}_time.timescale").alias(f"{n}_timescale"), f"{n}_index")))


_MARKED = [
    "case when event_id % 41 = 0 then 'end_of_sequence' when event_id % 43 = 0 then 'delimiter' else 'picture' end as kind", "event_type <> 'view' as is_reference", "event_id % 37 = 0 as is_refresh",
    "event_id % 2 = 0 as long_term", "event_id * 7 % 50 as poc",
    "event_id % 4 = 0 as one", "event_id % 8 = 0 as two", "event_id div 4 % 6 + 1 as op1", "event_id div 24 % 4 as a1", "event_id div 96 % 2 as b1", "event_id div 8 % 6 + 1 as op2", "event_id div 48 % 3 as a2", "event_id div 5 % 2 as b2",
]

#: Steps of each row: its commands in turn, with the buffer as they leave it, and then the storing.
_MARKING_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS stream, event_id AS i, {", ".join(_MARKED).replace(" div ", " // ")} FROM events),
    f AS (SELECT *, count(*) FILTER (WHERE is_reference AND kind = 'picture') OVER (PARTITION BY stream ORDER BY i) % 16 AS fn FROM e),
    g AS (SELECT *, one AND is_reference AND NOT is_refresh AND kind = 'picture' AS adaptive FROM f),
    s AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY stream ORDER BY i, step) AS n FROM (
        SELECT *, 0 AS step, 0 AS op, 0 AS a, 0 AS b FROM g UNION ALL
        SELECT *, 1, op1, a1, b1 FROM g WHERE adaptive UNION ALL
        SELECT *, 2, op2, a2, b2 FROM g WHERE adaptive AND two UNION ALL
        SELECT *, 9, 0, 0, 0 FROM g)),
    r AS (
      SELECT stream, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS i, 0 AS step, CAST([] AS STRUCT("index" BIGINT, frame_num BIGINT, poc BIGINT, long_index INTEGER)[]) AS held, CAST(NULL AS INTEGER) AS most,
             CAST([] AS STRUCT("index" BIGINT, frame_num BIGINT, poc BIGINT, long_index INTEGER)[]) AS work, CAST(NULL AS INTEGER) AS wmost, CAST(NULL AS INTEGER) AS mark, CAST(NULL AS VARCHAR) AS error
      FROM (SELECT DISTINCT stream FROM e)
      UNION ALL
      SELECT stream, n, i, step,
        CASE WHEN step < 9 OR error IS NOT NULL THEN held WHEN kind = 'end_of_sequence' THEN [] WHEN kind <> 'picture' OR NOT is_reference THEN held
             WHEN is_refresh THEN [struct_pack("index" := i, frame_num := CAST(0 AS BIGINT), poc := poc, long_index := CASE WHEN long_term THEN 0 END)]
             WHEN adaptive THEN list_append(work, struct_pack("index" := i, frame_num := fn, poc := poc, long_index := mark))
             WHEN len(held) = 4 THEN list_append(list_filter(held, lambda x: x."index" <> oldest), struct_pack("index" := i, frame_num := fn, poc := poc, long_index := CAST(NULL AS INTEGER)))
             ELSE list_append(held, struct_pack("index" := i, frame_num := fn, poc := poc, long_index := CAST(NULL AS INTEGER))) END,
        CASE WHEN step < 9 OR error IS NOT NULL THEN most WHEN kind = 'end_of_sequence' THEN NULL WHEN kind <> 'picture' OR NOT is_reference THEN most
             WHEN is_refresh THEN CASE WHEN long_term THEN 0 END WHEN adaptive THEN wmost ELSE most END,
        CASE WHEN step = 0 THEN held WHEN error IS NOT NULL OR step = 9 THEN work
             WHEN op = 1 THEN list_filter(work, lambda x: x."index" <> short_) WHEN op = 2 THEN list_filter(work, lambda x: x.long_index IS NULL OR x.long_index <> a)
             WHEN op = 3 THEN list_transform(list_filter(work, lambda x: x.long_index IS NULL OR x.long_index <> b), lambda x: CASE WHEN x."index" = short_ THEN struct_pack("index" := x."index", frame_num := x.frame_num, poc := x.poc, long_index := CAST(b AS INTEGER)) ELSE x END)
             WHEN op = 4 THEN list_filter(work, lambda x: x.long_index IS NULL OR x.long_index < a) WHEN op = 5 THEN [] ELSE list_filter(work, lambda x: x.long_index IS NULL OR x.long_index <> a) END,
        CASE WHEN step = 0 THEN most WHEN error IS NOT NULL OR step = 9 THEN wmost WHEN op = 4 THEN CASE WHEN a > 0 THEN a - 1 END WHEN op = 5 THEN NULL ELSE wmost END,
        CASE WHEN step = 0 THEN NULL WHEN op = 6 AND error IS NULL THEN a ELSE mark END, error
      FROM (
        SELECT *, CASE WHEN step = 0 THEN NULL WHEN was IS NOT NULL THEN was
               WHEN step < 9 THEN CASE
                 WHEN op = 1 AND a = 0 THEN 'invalid: difference of picture numbers is zero'
                 WHEN op = 1 AND short_ IS NULL THEN 'invalid: no such short-term reference'
                 WHEN op = 2 AND len(list_filter(work, lambda x: x.long_index = a)) = 0 THEN 'invalid: no such long-term reference'
                 WHEN op = 3 AND (wmost IS NULL OR b > wmost) OR op = 6 AND (wmost IS NULL OR a > wmost) THEN 'invalid: long-term index is over the greatest one'
                 WHEN op = 3 AND a = 0 THEN 'invalid: difference of picture numbers is zero'
                 WHEN op = 3 AND short_ IS NULL THEN 'invalid: no such short-term reference' END
               WHEN kind <> 'picture' OR NOT is_reference OR is_refresh THEN NULL
               WHEN adaptive THEN CASE WHEN mark IS NULL AND len(list_filter(work, lambda x: x.long_index IS NULL AND x.frame_num = fn)) > 0 THEN 'invalid: frame number is held already' WHEN len(work) >= 4 THEN 'invalid: more references than allowed' END
               WHEN len(list_filter(held, lambda x: x.long_index IS NULL AND x.frame_num = fn)) > 0 THEN 'invalid: frame number is held already'
               WHEN len(held) = 4 AND oldest IS NULL THEN 'invalid: no short-term reference to remove' END AS error
        FROM (
          SELECT s.*, r.held, r.most, r.work, r.wmost, r.mark, r.error AS was,
                 list_filter(r.work, lambda x: x.long_index IS NULL AND CASE WHEN x.frame_num > fn THEN x.frame_num - 16 ELSE x.frame_num END = fn - a)[1]."index" AS short_,
                 list_sort(list_transform(list_filter(r.held, lambda x: x.long_index IS NULL), lambda x: struct_pack(w := CASE WHEN x.frame_num > fn THEN x.frame_num - 16 ELSE x.frame_num END, i := x."index")))[1].i AS oldest
          FROM r JOIN s ON s.stream = r.stream AND s.n = r.n + 1)))
    SELECT stream, i AS "index", error, array_to_string(list_transform(held, lambda x: x."index" || ':' || x.frame_num || ':' || x.poc || ':' || coalesce(CAST(x.long_index AS VARCHAR), '-')), ' ') AS held FROM r WHERE step = 9"""


def marked_rows(spark, sf_dir):
    """Events as pictures of streams: refreshes, ends, references by turning frame numbers, and up to two commands."""
    rows = _events(spark, sf_dir, *_MARKED).withColumnRenamed("i", "index")
    ordered = Window.partitionBy("stream").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("frame_num", F.count_if(F.col("is_reference") & (F.col("kind") == "picture")).over(ordered) % 16)
    command = lambda j: F.struct(F.col(f"op{j}").cast("int").alias("op"), F.col(f"a{j}").cast("int").alias("a"), F.col(f"b{j}").cast("int").alias("b"))
    commands = F.when(F.col("two"), F.array(command(1), command(2))).when(F.col("one"), F.array(command(1)))
    return counted.select("stream", *[commands.alias(c) if c == "commands" else c for c in marking.ROW])


def _held_text(held):
    entry = lambda x: F.concat_ws(":", x["index"].cast("string"), x["frame_num"].cast("string"), x["poc"].cast("string"), F.coalesce(x["long_index"].cast("string"), F.lit("-")))
    return F.array_join(F.transform(held, entry), " ")


@query("j6_marked_references", _MARKING_SQL)
def marked_references(spark, sf_dir):
    """The reference buffer behind every row, by the sliding window and by commands (F11 exactly, J6, J5)."""
    marked = marking.mark_references(marked_rows(spark, sf_dir), ["stream"], references=4, log2_frame_nums=4)
    return marked.withColumn("held", _held_text(F.col("held")))


_SHOWN = ["case when event_id % 53 = 0 then 'discontinuity' when event_id % 47 = 0 then 'end_of_sequence' when event_id % 31 = 0 then 'refresh_discarding' when event_id % 17 = 0 then 'refresh' else 'picture' end as kind", "cast(floor(value * 1000) as bigint) as poc"]


def shown_rows(spark, sf_dir):
    return _events(spark, sf_dir, *_SHOWN).withColumnRenamed("i", "index")


@query(
    "j4_display_order",
    f"""WITH RECURSIVE e AS (SELECT user_id AS stream, event_id AS i, {", ".join(_SHOWN)}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (
      SELECT stream, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(poc BIGINT, i BIGINT)[]) AS waiting, CAST([] AS STRUCT(poc BIGINT, i BIGINT)[]) AS shown FROM (SELECT DISTINCT stream FROM e)
      UNION ALL
      SELECT stream, n, CASE WHEN len(held) > 2 THEN held[2:] ELSE held END, list_concat(shown, CASE WHEN len(held) > 2 THEN held[:1] ELSE [] END) FROM (
        SELECT e.stream, e.n, CASE WHEN kind = 'picture' THEN [] WHEN kind IN ('refresh', 'end_of_sequence') THEN waiting ELSE [] END AS shown,
               list_sort(list_concat(CASE WHEN kind = 'picture' THEN waiting ELSE [] END, CASE WHEN kind IN ('picture', 'refresh', 'refresh_discarding') THEN [struct_pack(poc := poc, i := e.i)] ELSE [] END)) AS held
        FROM r JOIN e ON e.stream = r.stream AND e.n = r.n + 1)),
    ends AS (SELECT stream, n + 1 AS n, waiting AS shown FROM r WHERE (stream, n) IN (SELECT (stream, max(n)) FROM e GROUP BY stream)),
    out_ AS (SELECT stream, n, unnest(shown) AS x, unnest(range(1, len(shown) + 1)) AS k FROM (SELECT stream, n, shown FROM r UNION ALL SELECT * FROM ends))
    SELECT stream, x.i AS "index", x.poc AS poc, CAST(row_number() OVER (PARTITION BY stream ORDER BY n, k) - 1 AS BIGINT) AS output_index FROM out_""",
)
def display_order(spark, sf_dir):
    """Pictures in display order, with refreshes, gaps and ends that empty the buffer (J3, J4, J5)."""
    return reorder.display_order(shown_rows(spark, sf_dir), ["stream"], depth=2)

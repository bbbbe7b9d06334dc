"""Sample tables: run-length rows become one row per sample by arithmetic on the runs.

Sums run over the runs, which are few, and never over the samples: a run knows
its first sample and first time, and the samples in it follow from these. Runs
are in the order of their columns, each place once; a null count is no sample
where a rule does not say otherwise, and an empty table gives an empty one.

Spark takes rows made of runs to be as small as the runs. Where they are
joined, ``merged`` has both sides sorted, so that neither is sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _before(track: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*track).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def merged(rows: DataFrame) -> DataFrame:
    """``rows`` that a join by keys merges with its other side, whatever size they seem to have."""
    return rows.hint("merge")


def expand_runs(runs: DataFrame, track: list[str], order: list[str], count: str, carry: list[str]) -> DataFrame:
    """One row per sample of ``runs``: track columns, sample_index from 0 within the track, and ``carry``.

    Runs of a count that is not positive have no samples.
    """
    counted = runs.where(F.col(count) > 0)
    first = F.coalesce(F.sum(count).over(_before(track, order)), F.lit(0)).cast("long")
    spread = counted.withColumn("_first", first).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))
    return spread.select(*track, (F.col("_first") + F.col("_k")).alias("sample_index"), *carry)


def decode_times(runs: DataFrame, track: list[str], order: list[str], count: str, delta: str) -> DataFrame:
    """One row per sample with dts, the exclusive running sum of durations, and duration."""
    counted = runs.where(F.col(count) > 0)
    before = _before(track, order)
    first = F.coalesce(F.sum(count).over(before), F.lit(0)).cast("long")
    start = F.coalesce(F.sum(F.col(count).cast("long") * F.col(delta)).over(before), F.lit(0)).cast("long")
    spread = counted.select("*", first.alias("_first"), start.alias("_start")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))
    return spread.select(*track, (F.col("_first") + F.col("_k")).alias("sample_index"), (F.col("_start") + F.col("_k") * F.col(delta)).cast("long").alias("dts"), F.col(delta).cast("long").alias("duration"))


def half_open_runs(runs: DataFrame, track: list[str], first: str) -> DataFrame:
    """``runs`` with run_end: the next run's first key, null for the last."""
    return runs.withColumn("run_end", F.lead(first).over(Window.partitionBy(*track).orderBy(first)))


def lookup_run(keys: DataFrame, runs: DataFrame, track: list[str], key: str, first: str, carry: list[str]) -> DataFrame:
    """Each key with ``carry`` of the last run that starts at or before it; keys before every run go.

    Keys and run starts are merged in order and the last start is carried on,
    so no key is paired with more than one run.
    """
    payload = F.struct(F.col(first).alias("_first"), *carry)
    marked = keys.select(*track, F.col(key).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(runs.select(payload.alias("p")).schema["p"].dataType).alias("_run"), F.struct(*keys.columns).alias("_row"))
    starts = runs.select(*track, F.col(first).alias("_at"), F.lit(0).alias("_kind"), payload.alias("_run"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*track).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.unionByName(starts).withColumn("_last", F.last("_run", ignorenulls=True).over(order)).where("_kind = 1 and _last is not null")
    return found.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in carry])


def chunk_samples(chunks: DataFrame, runs: DataFrame, track: list[str]) -> DataFrame:
    """chunks (track, chunk from 1, chunk_offset) and runs (track, first_chunk, samples_per_chunk, description) to
    one row per chunk with its first sample and description."""
    known = lookup_run(chunks, runs, track, "chunk", "first_chunk", ["samples_per_chunk", "description"])
    return known.withColumn("first_sample", F.coalesce(F.sum("samples_per_chunk").over(_before(track, ["chunk"])), F.lit(0)).cast("long"))


def sample_offsets(chunks: DataFrame, runs: DataFrame, sizes: DataFrame, track: list[str]) -> DataFrame:
    """sizes (track, sample_index, size) to rows with offset and description; samples of a chunk follow each other."""
    known = chunk_samples(chunks, runs, track).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("samples_per_chunk").cast("int") - 1)))
    placed = known.select(*track, "chunk", "chunk_offset", "description", (F.col("first_sample") + F.col("_k")).alias("sample_index"))
    packed = Window.partitionBy(*track, "chunk").orderBy("sample_index").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(merged(sizes), [*track, "sample_index"])
    return joined.select(*track, "sample_index", (F.col("chunk_offset") + F.coalesce(F.sum("size").over(packed), F.lit(0))).cast("long").alias("offset"), F.col("size").cast("long").alias("size"), "description")


def fuse_sample_tables(durations: DataFrame, compositions: DataFrame, chunks: DataFrame, chunk_runs: DataFrame, sizes: DataFrame, syncs: DataFrame | None, track: list[str]) -> DataFrame:
    """The sample rows of a track in decode order from its tables.

    durations and compositions are runs (track, run, count, delta / shift),
    syncs holds sample numbers from 1; None means that every sample is one. A
    missing composition shifts by 0.
    """
    timed = decode_times(durations, track, ["run"], "count", "delta")
    shifts = expand_runs(compositions, track, ["run"], "count", ["shift"])
    placed = sample_offsets(chunks, chunk_runs, sizes, track)
    rows = placed.join(merged(timed), [*track, "sample_index"]).join(merged(shifts), [*track, "sample_index"], "left")
    if syncs is None:
        sync = F.lit(True)
    else:
        marks = syncs.select(*track, (F.col("sample_number") - 1).alias("sample_index"), F.lit(True).alias("_sync"))
        rows = rows.join(merged(marks), [*track, "sample_index"], "left")
        sync = F.coalesce("_sync", F.lit(False))
    return rows.select(*track, "sample_index", "offset", "size", "dts", (F.col("dts") + F.coalesce("shift", F.lit(0))).cast("long").alias("pts"), "duration", "description", sync.alias("sync"))


def sample_table_errors(durations: DataFrame, compositions: DataFrame, chunks: DataFrame, chunk_runs: DataFrame, sizes: DataFrame, syncs: DataFrame, track: list[str]) -> DataFrame:
    """(track, error) of what forbids to fuse the tables of a track; a sound track has no row.

    The tables are those of fuse_sample_tables. The number of samples is that
    of ``sizes``; a track without compositions or sync samples has none to
    check. Rows with a null count say nothing.
    """
    counted = lambda rows, kind, n: rows.select(*track, F.lit(kind).alias("_kind"), n.cast("long").alias("_n"))
    covered = chunks.select(*track).distinct()
    parts = [
        counted(durations, "stts", F.col("count")),
        counted(compositions, "ctts", F.col("count")),
        counted(chunk_samples(chunks, chunk_runs, track), "stsc", F.col("samples_per_chunk")),
        counted(chunk_runs.groupBy(*track).agg(F.min("first_chunk").alias("_first")), "first", F.col("_first")),
        counted(sizes, "stsz", F.lit(1)),
        counted(syncs, "stss", F.col("sample_number")),
        counted(covered, "chunks", F.lit(1)),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    of = lambda kind: F.when(F.col("_kind") == kind, F.col("_n"))
    per = rows.groupBy(*track).agg(
        *(F.sum(of(k)).alias(k) for k in ("stts", "ctts", "stsc", "stsz")),
        F.count_if((F.col("_kind") == "stts") & (F.col("_n") == 0)).alias("_empty"),
        F.min(of("stss")).alias("_low"),
        F.max(of("stss")).alias("_high"),
        F.count(of("stss")).alias("_marks"),
        F.count_distinct(of("stss")).alias("_distinct"),
        F.min(of("first")).alias("_first"),
    )
    n = F.coalesce("stsz", F.lit(0))
    errors = F.array(
        F.when(F.col("_empty") > 0, "stts entry has zero samples"),
        F.when(F.coalesce("stts", F.lit(0)) != n, "stts sample count does not match stsz"),
        F.when(F.col("ctts") != n, "ctts sample count does not match stsz"),
        F.when(F.coalesce("stsc", F.lit(0)) != n, "stsc sample count does not match stsz"),
        F.when(F.col("_first") != 1, "stsc does not begin with chunk 1"),
        F.when((F.col("_low") < 1) | (F.col("_high") > n), "stss sample number is out of range"),
        F.when(F.col("_marks") > F.col("_distinct"), "stss sample number is repeated"),
    )
    return per.select(*track, F.explode(F.array_compact(errors)).alias("error"))


def table_order_errors(chunk_runs: DataFrame, syncs: DataFrame, descriptions: DataFrame, track: list[str]) -> DataFrame:
    """(track, error) of runs of chunks or of sync samples that are out of order, and of descriptions that there are not.

    chunk_runs (track, run, first_chunk, samples_per_chunk, description) and
    syncs (track, run, sample_number) are in the order of ``run``: first chunks
    and sample numbers must rise, chunks have samples, and descriptions lie from
    1 to the track's number in ``descriptions`` (track, n; without a row none).
    A null breaks its rule. A track has each error once.
    """
    order = Window.partitionBy(*track).orderBy("run")
    rises = lambda c: F.coalesce(F.col(c) > F.lag(c).over(order), F.lag(F.lit(1)).over(order).isNull() & F.col(c).isNotNull())
    sized = chunk_runs.join(descriptions.select(*track, F.col("n").alias("_n")), track, "left")
    bad = lambda rule: ~F.coalesce(rule, F.lit(False))
    of_chunks = sized.select(
        *track,
        F.array(
            F.when(bad(rises("first_chunk")), "stsc first chunks do not rise"), F.when(bad(F.col("samples_per_chunk") > 0), "stsc chunk has no samples"), F.when(bad(F.col("description").between(1, F.coalesce("_n", F.lit(0)))), "stsc description is out of range")
        ).alias("_errors"),
    )
    of_syncs = syncs.select(*track, F.array(F.when(bad(rises("sample_number")), "stss sample numbers do not rise")).alias("_errors"))
    return of_chunks.unionByName(of_syncs).select(*track, F.explode(F.array_compact("_errors")).alias("error")).distinct()


def samples_past_end(samples: DataFrame, files: DataFrame, file: list[str]) -> DataFrame:
    """``samples`` (file, offset, size) with an error where they end behind their file's length or pass 63 bits; files (file, length)."""
    joined = samples.join(files.select(*file, F.col("length").alias("_length")), file, "left")
    end = F.col("offset").cast("decimal(20,0)") + F.col("size").cast("decimal(20,0)")
    error = F.when(F.col("_length").isNull(), "invalid: no such file").when(F.col("offset") < 0, "invalid: offset is negative").when(end > F.col("_length"), "invalid: sample exceeds the input")
    return joined.withColumn("error", error).drop("_length")


def timeline_offset(edits: DataFrame, track: list[str]) -> DataFrame:
    """Per track the shift of its timeline: leading empty edits in media time less the start of its one media edit.

    edits: track, ordinal, segment_duration, media_time (-1: empty), rate_int,
    rate_fraction, movie_timescale, media_timescale. offset is null and
    supported false where the list is not empty edits followed by one media
    edit of rate 1, or where the empty time is no whole number of media units.
    """
    empty = F.col("media_time") == -1
    rated = (F.col("rate_int") == 1) & (F.col("rate_fraction") == 0)
    per = edits.groupBy(*track).agg(
        F.sum(F.when(empty, F.col("segment_duration")).otherwise(0)).alias("_empty"),
        F.count_if(~empty).alias("_media"),
        F.max(F.when(empty, F.col("ordinal"))).alias("_last_empty"),
        F.max(F.when(~empty, F.col("ordinal"))).alias("_media_at"),
        F.max(F.when(~empty, F.col("media_time"))).alias("_start"),
        F.bool_and(F.when(~empty, rated)).alias("_rated"),
        F.max("movie_timescale").alias("_movie"),
        F.max("media_timescale").alias("_scale"),
    )
    scaled = F.col("_empty").cast("decimal(19,0)") * F.col("_scale").cast("decimal(10,0)")
    fits = (F.col("_media") == 1) & F.col("_rated") & (F.coalesce("_last_empty", F.lit(-1)) < F.col("_media_at")) & (scaled % F.col("_movie") == 0)
    offset = (F.call_function("div", scaled, F.col("_movie").cast("decimal(10,0)")) - F.col("_start")).cast("long")
    return per.select(*track, F.when(fits, offset).alias("offset"), F.coalesce(fits, F.lit(False)).alias("supported"))


def fragment_times(fragments: DataFrame, track: list[str], order: str, start: str, duration: str) -> DataFrame:
    """``fragments`` with decode_time: its own ``start`` if it has one, else where the fragment before it ended."""
    ordered = Window.partitionBy(*track).orderBy(order)
    island = fragments.withColumn("_island", F.count(start).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*track, "_island").orderBy(order)
    base = F.coalesce(F.first(start).over(inside), F.lit(0))
    before = F.coalesce(F.sum(duration).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return island.withColumn("decode_time", (base + before).cast("long")).drop("_island")

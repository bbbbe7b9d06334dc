"""Selection, seeking, sizes, marking and display order against plain Python and over streams."""

from __future__ import annotations

import random
from fractions import Fraction
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from framelake.operators import asof, marking, reorder, seek, selection, sizes, streams, summaries
from framelake.operators.marking import Buffer, Limits, Reference


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_values_at_ranks_equal_sorting(spark):
    rng = random.Random(1)
    ends = [-(1 << 63), (1 << 63) - 1]
    rows = [(g, rng.choice([None, 7, 7, rng.randint(-5, 5), rng.randint(-(1 << 62), 1 << 62), *ends])) for g in (None, 1, 2) for _ in range(60)] + [(3, None), (4, ends[0]), (4, ends[1])]
    groups = {g: sorted(v for k, v in rows if k == g and v is not None) for g in (None, 1, 2, 3, 4)}
    asked = [(g, f"r{k}", k) for g in groups for k in (0, 1, 2, 30, len(groups[g]), len(groups[g]) + 1)]
    got = selection.values_at_ranks(table(spark, rows, "g int, v long"), ["g"], "v", table(spark, asked, "g int, name string, rank long")).collect()
    want = sorted(((g, n, k, groups[g][k - 1] if 1 <= k <= len(groups[g]) else None) for g, n, k in asked), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_service_summary_and_median(spark):
    rows = [(g, v) for g, n in ((1, 1), (2, 7), (3, 100), (None, 12)) for v in random.Random(n).sample(range(1000), n)] + [(5, None), (2, None)]
    got = {r.g: r for r in summaries.service_summary(table(spark, rows, "g int, v long"), ["g"], "v").collect()}
    half = {r.g: r.median for r in selection.medians(table(spark, rows, "g int, v long"), ["g"], "v").collect()}
    for g in (1, 2, 3, None, 5):
        own = sorted(v for k, v in rows if k == g and v is not None)
        rank = lambda p: own[-(-len(own) * p // 100) - 1] if own else None
        assert (got[g].n, got[g].mean, got[g].p50, got[g].p95, got[g].p99, got[g].longest) == (len(own), sum(own) // len(own) if own else None, rank(50), rank(95), rank(99), max(own, default=None))
        assert half[g] == ((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2 if own else None)
    assert summaries.service_summary(table(spark, [], "g int, v long"), ["g"], "v").count() == 0
    plan = summaries.service_summary(table(spark, rows, "g int, v long"), ["g"], "v")._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan


@pytest.mark.parametrize("bucket", [None, 5])
def test_prefix_max_equals_brute_force(spark, bucket):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2), rng.choice([None, *range(-20, 20)]), rng.choice([None, *range(50)]), i) for i in range(120)]
    got = asof.prefix_max(table(spark, rows, "k int, t long, v long, i int"), ["k"], "t", "v", "most", bucket=bucket).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.most == (None if r.t is None else max((v for k, t, v, _ in rows if k == r.k and None not in (t, v) and t <= r.t), default=None))


def _plan(targets, samples):
    for track, target in sorted(set(targets)):
        own = sorted((i, pts, sync) for k, i, pts, sync in samples if k == track)
        keys = sorted((-pts, i) for i, pts, sync in own if sync and pts <= target)
        if not keys:
            continue
        key = keys[0][1]
        after = [i for i, _, sync in own if sync and i > key]
        span = [(pts, i) for i, pts, _ in own if i >= key and (not after or i <= after[0])]
        shown = sorted(x for x in span if x[0] >= target)
        if shown:
            yield track, target, key, shown[0][1], max(i for pts, i in span if pts <= shown[0][0]) - key + 1


@pytest.mark.parametrize("bucket", [None, 6])
def test_seek_plan_equals_brute_force(spark, bucket):
    rng = random.Random(4)
    samples = [(k, i, i * 3 + rng.randint(-9, 9), rng.random() < 0.15) for k in range(3) for i in range(50)]
    targets = [(k, rng.randint(-10, 170)) for k in range(4) for _ in range(40)]
    got = seek.seek_plan(table(spark, targets, "track int, target long"), table(spark, samples, "track int, sample_index long, pts long, sync boolean"), ["track"], bucket=bucket)
    assert sorted(tuple(r) for r in got.collect()) == sorted(_plan(targets, samples))


@pytest.mark.parametrize("bucket", [None, 40])
def test_retain_rising_equals_a_scan(spark, bucket):
    rng = random.Random(5)
    rows = [(s, i) for s in range(4) for i in rng.sample(range(-50, 400), 90 if s else 1)]
    got = {(r.s, r.i): r.retained for r in streams.retain_rising(table(spark, [*rows, (1, None)], "s int, i long"), ["s"], "i", 17, bucket=bucket).collect()}
    want = {(1, None): False}
    for s in range(4):
        last = None
        for i in sorted(i for k, i in rows if k == s):
            want[s, i] = last is None or i - last >= 17
            last = i if want[s, i] else last
    assert got == want
    assert streams.retain_rising(table(spark, [], "s int, i long"), ["s"], "i", 17).count() == 0


def _sized(frames):
    out = {}
    slots = {}
    for s, i, refresh, a, b, fa, fb, w, h in sorted(frames):
        held = slots.setdefault(s, [None] * 8)
        source = a if fa else b if fb else None
        size = (i, w, h) if source is None else held[source]
        out[s, i] = size
        for k in range(8):
            if size and refresh >> k & 1:
                held[k] = size
    return out


_FRAMES = "s int, i long, refresh int, a int, b int, fa boolean, fb boolean, w long, h long"


def _sizes(spark, frames, **options):
    found = sizes.inherited_sizes(table(spark, frames, _FRAMES), ["s"], "i", "refresh", ["a", "b"], ["fa", "fb"], "w", "h", **options)
    return {(r.s, r.i): (r.size_from, r.frame_width, r.frame_height) if r.error is None else None for r in found.collect()}


@pytest.mark.parametrize("bucket", [None, 16])
def test_inherited_sizes_equal_a_scan(spark, bucket):
    rng = random.Random(6)
    frames = [(s, i, rng.choice([0, 1, 2, 4, 128, 255]) if s < 3 else rng.choice([0, 1, 2]), rng.randint(0, 7), rng.randint(0, 2), rng.random() < 0.4, rng.random() < 0.6, i * 2, i + 1) for s in range(4) for i in range(60)]
    assert _sizes(spark, frames, bucket=bucket) == _sized(frames)
    assert sizes.MISSING and any(v is None for v in _sized(frames).values())


def test_a_long_chain_of_sizes_takes_few_rounds(spark, monkeypatch):
    chain = [(1, i, 1 << i % 2, (i + 1) % 2, 0, i > 0, False, 640, 360) for i in range(10_000)]
    rounds = []
    kept = sizes.written
    monkeypatch.setattr(sizes, "written", lambda df: rounds.append(1) or kept(df))
    got = _sizes(spark, chain)
    assert set(got.values()) == {(0, 640, 360)} and len(rounds) < 20 + 6


@pytest.mark.parametrize("seconds", [None, 2])
@pytest.mark.parametrize("options", [{}, {"forward": True}, {"strict": True}, {"greatest_index": True}, {"forward": True, "strict": True, "greatest_index": True}])
def test_as_of_over_timescales_equals_fractions(spark, options, seconds):
    rng = random.Random(7)
    big, scales = (1 << 63) - 1, [1, 2, 3, 24, 1001, (1 << 32) - 1, (1 << 32) - 2]
    time = lambda: rng.choice([None, (rng.randint(-9, 9), rng.choice([1, 2, 3])), (rng.randint(-9, 9) * 1001, 1001), (rng.randint(-5000, 5000), 1001), (big - rng.randint(0, 1), rng.choice(scales)), (-big - rng.randint(0, 1), rng.choice(scales))])
    left = [(rng.randint(0, 2), time(), i) for i in range(70)]
    right = [(rng.randint(0, 1), time(), i) for i in range(50)]
    kind = "struct<value:bigint,timescale:bigint>"
    tables = table(spark, left, f"k int, t {kind}, i int"), table(spark, right, f"k int, s {kind}, j long")
    exact = lambda x: Fraction(x[0], x[1])
    forward, strict, greatest = (options.get(o, False) for o in ("forward", "strict", "greatest_index"))
    for r in asof.as_of_times(*tables, ["k"], "t", "s", "j", seconds=seconds, **options).collect():
        fit = [(exact(s), j, s) for k, s, j in right if k == r.k and None not in (s, r.t) and ((exact(s) > exact(r.t) if strict else exact(s) >= exact(r.t)) if forward else (exact(s) < exact(r.t) if strict else exact(s) <= exact(r.t)))]
        best = min(fit, key=lambda x: (x[0] if forward else -x[0], -x[1] if greatest else x[1]), default=(None, None, None))
        assert (r.found_time and tuple(r.found_time), r.found_index) == (best[2], best[1])
    for r in asof.nearest_times(*tables, ["k"], "t", "s", "j", seconds=seconds).collect() if not options else []:
        fit = [(abs(exact(s) - exact(r.t)), exact(s), j) for k, s, j in right if k == r.k and None not in (s, r.t)]
        assert r.nearest_index == min(fit, default=(0, 0, None))[2]


LIMITS = Limits.of(2, 4)


def _sliding(buffer, *numbers, limits=LIMITS):
    for n in numbers:
        buffer = marking.store_sliding(buffer, Reference(100 + n, n, n), limits)
    return buffer


def test_sliding_window_goes_by_wrapped_frame_number():
    assert [r.frame_num for r in _sliding(Buffer(), 14, 15, 0).held] == [15, 0]
    refreshed = marking.store_refresh(9, 0, True)
    assert [(r.index, r.long_index) for r in _sliding(refreshed, 1).held] == [(9, 0), (101, None)]
    one = Limits.of(0, 4)
    assert [r.frame_num for r in _sliding(marking.store_refresh(5, 0, False), 1, limits=one).held] == [1]
    with pytest.raises(ValueError):
        Limits.of(17, 4)
    with pytest.raises(marking.Refused):
        _sliding(Buffer(), 3, 3)
    with pytest.raises(marking.Refused):
        _sliding(marking.store_refresh(1, 0, True), 1, limits=one)


def test_commands_hold_all_or_not_at_all():
    four = Limits.of(4, 4)
    full = _sliding(Buffer(), 0, 1, 2, limits=four)
    done = marking.store_adaptive(full, Reference(13, 3, 3), [(marking.LIMIT_LONG, 2, 0), (marking.ASSIGN_LONG, 2, 1), (marking.FORGET_SHORT, 1, 0), (marking.MARK_LONG, 0, 0)], four)
    assert [(r.frame_num, r.long_index) for r in done.held] == [(0, None), (1, 1), (3, 0)] and done.most_long == 1
    row = {"kind": "picture", "is_reference": True, "is_refresh": False, "long_term": False, "index": 11, "frame_num": 1, "poc": 1, "commands": [(marking.FORGET_ALL, 0, 0), (marking.MARK_LONG, 0, 0)]}
    before = _sliding(Buffer(), 0)
    after, error = marking.store(before, row, LIMITS)
    assert after is before and error.startswith("invalid: long-term index")
    assert marking.store(before, row | {"frame_num": 16}, LIMITS) == (before, "invalid: frame number is out of range")
    assert marking.store(before, row | {"kind": "end_of_sequence"}, LIMITS) == (Buffer(), None)


def _stream(spark, tmp_path, rows, ddl, run, name):
    """What a stream over the rows gives, one file of them a batch, and the rows left in its state."""
    from framelake.streaming.pictures import STATE_STORE

    spark.conf.set(*STATE_STORE)
    third = len(rows) // 3 + 1
    for j in range(3):
        table(spark, rows[j * third : (j + 1) * third], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = run(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    left = sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
    spark.conf.unset(STATE_STORE[0])
    return spark.table(name), left


_MARK_ROW = "stream long, index long, kind string, is_reference boolean, is_refresh boolean, long_term boolean, frame_num long, poc long, commands array<struct<op:int,a:int,b:int>>"


def _mark_rows(n):
    rng = random.Random(8)
    command = lambda: (rng.randint(1, 6), rng.randint(0, 3), rng.randint(0, 2))
    rows = []
    for i in range(n):
        kind = rng.choice(["picture"] * 9 + ["delimiter", "end_of_sequence"])
        rows.append((i % 3, i, kind, rng.random() < 0.8, rng.random() < 0.1, rng.random() < 0.4, rng.choice([None, *range(20)]) if i % 7 == 0 else i // 3 % 16, rng.randint(0, 9), rng.choice([None, None, [], [command()], [command(), command()]])))
    return rows


def test_streaming_marks_equal_batch_and_end(spark, tmp_path):
    from framelake.streaming.pictures import mark_references_stream

    rows = _mark_rows(200) + [(s, 1000 + s, "end_of_stream", None, None, None, None, None, None) for s in range(3)]
    got, left = _stream(spark, tmp_path, rows, _MARK_ROW, lambda source: mark_references_stream(source, 3, 4), "marks")
    batch = marking.mark_references(table(spark, rows, _MARK_ROW), ["stream"], 3, 4)
    key = lambda df: sorted(((r.stream, r["index"], r.error, [tuple(x) for x in r.held]) for r in df.collect()), key=str)
    assert key(got) == key(batch) and left == 0
    assert {r.error for r in batch.collect()} - {None}


def _shown(rows, depth):
    out = []
    for s in sorted({r[0] for r in rows}):
        waiting, n = [], 0
        for _, i, poc, kind in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]) + [(s, 0, 0, "end_of_stream")]:
            leaving = []
            if kind in ("refresh", "end_of_sequence", "end_of_stream"):
                leaving, waiting = sorted(waiting), []
            if kind in ("discontinuity", "refresh_discarding"):
                waiting = []
            if kind in ("picture", "refresh", "refresh_discarding"):
                heappush(waiting, (poc, i))
                if len(waiting) > depth:
                    leaving.append(heappop(waiting))
            out += [(s, at, p, n + j) for j, (p, at) in enumerate(leaving)]
            n += len(leaving)
    return sorted(out)


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_display_order_equals_batch_and_stream(spark, tmp_path, depth):
    from framelake.streaming.pictures import display_order_stream

    rng = random.Random(9)
    kinds = ["picture"] * 8 + ["refresh", "refresh_discarding", "discontinuity", "end_of_sequence", "other"]
    rows = [(i % 3, i, rng.randint(0, 20), rng.choice(kinds)) for i in range(200)] + [(s, 1000 + s, 0, "end_of_stream") for s in range(3)]
    ddl = "stream long, index long, poc long, kind string"
    key = lambda df: sorted(tuple(r) for r in df.select("stream", "index", "poc", "output_index").collect())
    assert key(reorder.display_order(table(spark, rows, ddl), ["stream"], depth)) == _shown(rows, depth)
    assert key(reorder.display_order(table(spark, rows[:150], ddl), ["stream"], depth)) == _shown(rows[:150], depth)
    if depth == 1:
        got, left = _stream(spark, tmp_path, rows, ddl, lambda source: display_order_stream(source, depth), "shown")
        assert key(got) == _shown(rows, depth) and left == 0


def test_null_streams_and_empty_tables(spark):
    ddl = "stream long, index long, poc long, kind string"
    assert reorder.display_order(table(spark, [], ddl), ["stream"], 2).count() == 0
    got = reorder.display_order(table(spark, [(None, 1, 5, "picture"), (None, 2, None, "picture"), (None, 3, 1, None)], ddl), ["stream"], 0)
    assert sorted((r["index"], r.poc, r.output_index) for r in got.collect()) == [(1, 5, 0), (2, 0, 1)]
    assert marking.mark_references(table(spark, [], _MARK_ROW), ["stream"], 2, 4).count() == 0
    assert asof.as_of_times(table(spark, [], "k int, t struct<value:bigint,timescale:bigint>"), table(spark, [], "k int, s struct<value:bigint,timescale:bigint>, j long"), ["k"], "t", "s", "j").count() == 0
    assert _sizes(spark, []) == {}
    assert seek.seek_plan(table(spark, [], "track int, target long"), table(spark, [], "track int, sample_index long, pts long, sync boolean"), ["track"]).select(F.count("*")).first()[0] == 0

"""Operators against the reference's fixtures, brute force and edge cases."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from framelake.functions import audio, scalars
from framelake.functions import time as media
from framelake.operators import asof, fragments, packets, pictures, runs, seek, streams, summaries, tracks
from framelake.plans import queries as media_queries
from framelake.sources import bitstreams, mp4


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_media_time_is_exact(spark):
    rows = table(spark, [(1, 2, 500, 1000), (1, 2, 501, 1000), (-1, 1, 1, 2), (1, 0, 1, 1), ((1 << 63) - 1, 1, (1 << 63) - 1, (1 << 32) - 1)], "a long, s long, b long, r long")
    got = [r.c for r in rows.select(media.compare_times(media.media_time(F.col("a"), F.col("s")), media.media_time(F.col("b"), F.col("r"))).alias("c")).collect()]
    assert got == [0, -1, -1, None, 1]


def test_timeline_offset_fixture(spark):
    rows = [(1, 0, 500, -1, 1, 0, 1000, 12000), (1, 1, 1000, 1024, 1, 0, 1000, 12000), (2, 0, 1, -1, 1, 0, 3, 2), (2, 1, 1, 0, 1, 0, 3, 2), (3, 0, 1, 5, 1, 0, 1, 1), (3, 1, 1, 5, 1, 0, 1, 1)]
    edits = table(spark, rows, "track int, ordinal int, segment_duration long, media_time long, rate_int int, rate_fraction int, movie_timescale long, media_timescale long")
    got = {r.track: (r.offset, r.supported) for r in runs.timeline_offset(edits, ["track"]).collect()}
    assert got == {1: (4976, True), 2: (None, False), 3: (None, False)}


@pytest.mark.parametrize("bucket", [None, 7])
@pytest.mark.parametrize("options", [{}, {"forward": True}, {"strict": True}, {"greatest_index": True}, {"forward": True, "strict": True}])
def test_as_of_equals_brute_force(spark, options, bucket):
    rng = random.Random(3)
    left = [(rng.randint(0, 2), rng.choice([None, *range(-30, 30)]), i) for i in range(80)]
    right = [(rng.randint(0, 1), rng.choice([None, *range(-30, 30)]), i) for i in range(25)]
    got = asof.as_of(table(spark, left, "k int, t long, i long"), table(spark, right, "k int, s long, j long"), ["k"], "t", "s", "j", bucket=bucket, **options).collect()
    forward, strict, greatest = (options.get(o, False) for o in ("forward", "strict", "greatest_index"))
    assert len(got) == len(left)
    for r in got:
        fit = [(s, j) for k, s, j in right if k == r.k and None not in (s, r.t) and ((s > r.t if strict else s >= r.t) if forward else (s < r.t if strict else s <= r.t))]
        best = min(fit, key=lambda x: (x[0] if forward else -x[0], -x[1] if greatest else x[1]), default=(None, None))
        assert (r.found_time, r.found_index) == best


def test_nearest_prefers_the_earlier(spark):
    left = table(spark, [(1, 5), (1, 4), (1, 6), (1, 100), (2, 1)], "k int, t long")
    right = table(spark, [(1, 3, 0), (1, 7, 1), (1, 7, 2)], "k int, s long, j long")
    got = {(r.k, r.t): r.nearest_index for r in asof.nearest(left, right, ["k"], "t", "s", "j").collect()}
    assert got == {(1, 5): 0, (1, 4): 0, (1, 6): 1, (1, 100): 1, (2, 1): None}


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_reorder_equals_a_heap(spark, depth):
    rng = random.Random(depth)
    rows = [(s, i, rng.randint(0, 9)) for s in range(4) for i in range(30)]
    got = {(r.s, r.i): r.output_index for r in streams.reorder_bounded(table(spark, rows, "s int, i int, v int"), ["s"], ["i"], "v", depth).collect()}
    want = {}
    for s in range(4):
        waiting, out = [], []
        for _, i, v in (r for r in rows if r[0] == s):
            heapq.heappush(waiting, (v, i))
            if len(waiting) > depth:
                out.append(heapq.heappop(waiting))
        out += sorted(waiting)
        want |= {(s, i): n for n, (_, i) in enumerate(out)}
    assert got == want


def test_spacing_cache_and_spans(spark):
    rows = table(spark, [(1, i, x) for i, x in enumerate([0, 29, 30, 31, 61, 20])], "s int, i int, x int")
    assert [r.retained for r in streams.retain_spaced(rows, ["s"], ["i"], "x", 30).orderBy("i").collect()] == [True, False, True, False, True, True]
    blocks = table(spark, [(1, i, b) for i, b in enumerate([0, 1, 0, 2, 1])], "s int, i int, b int")
    assert [r.hit for r in streams.cache_hits(blocks, ["s"], ["i"], "b", 2).orderBy("i").collect()] == [False, False, True, False, False]
    spans = table(spark, [(1, 0, 0, 50), (1, 1, 60, 70), (1, 2, 10, 20)], "s int, i int, a int, b int")
    assert [r.i for r in streams.pack_spans(spans, ["s"], ["i"], "a", "b", 40).collect()] == [0]
    assert streams.pack_spans(spans, ["s"], ["i"], "a", "b", 0).count() == 0


def test_seek_fixtures(spark):
    samples = table(spark, [(1, 0, 0, True), (1, 1, 1024, False), (1, 2, 512, False)], "track int, sample_index long, pts long, sync boolean")
    plan = seek.seek_plan(table(spark, [(1, 1024), (1, 512), (1, -5)], "track int, target long"), samples, ["track"]).collect()
    assert {r.target: (r.keyframe_index, r.selected_index, r.required) for r in plan} == {1024: (0, 1, 3), 512: (0, 2, 3)}
    rows = table(spark, [(20, 30, 40), (20, 30, 10), (20, 15, 10), (20, 20, None)], "k int, c int, f int")
    assert [r.s for r in rows.select(seek.choose_source(F.col("k"), F.col("c"), F.col("f")).alias("s")).collect()] == ["Forward", "Checkpoint", "Keyframe", "Keyframe"]


def test_summary_is_by_nearest_rank(spark):
    r = summaries.service_summary(table(spark, [(1, x) for x in (1, 2, 3, 4, 100)], "k int, d long"), ["k"], "d").first()
    assert (r.n, r.mean, r.p50, r.p95, r.p99, r.longest) == (5, 22, 3, 100, 100, 100)


def test_scalars(spark):
    rows = table(spark, [(0x65,), (0xE5,)], "b int")
    assert [r.h and (r.h.ref_idc, r.h.type) for r in rows.select(scalars.nal_header(F.col("b")).alias("h")).collect()] == [(3, 5), None]
    row = table(spark, [(bytearray(b"\0\0\1\2moov"), 10, 0, 20)], "d binary, c int, f int, s int")
    got = row.select(scalars.big_endian(F.col("d"), 0, 4).alias("n"), scalars.big_endian(F.col("d"), 6, 4).alias("past"), scalars.four_cc(F.substring("d", 5, 4)).alias("k"), scalars.implicit_weight(F.col("c"), F.col("f"), F.col("s")).alias("w"), scalars.is_mp4(F.lit("x.bin"), F.col("d")).alias("mp4")).first()
    assert (got.n, got.past, got.k, got.w, got.mp4) == (258, None, "moov", 32, True)


def test_parsers_give_rows_for_any_bytes(spark):
    index = bytes([0xC9]) + (260).to_bytes(2, "little") + (3).to_bytes(2, "little") + bytes([0xC9])
    assert [len(d) for _, d, e in bitstreams.superframe(bytes(263) + index) if not e] == [260, 3]
    assert [e for _, _, e in bitstreams.superframe(b"\1\2\xc0")] == ["invalid: bad index"]
    assert [(o, d) for o, d, _ in bitstreams.start_code_units(b"\0\0\0\1\x67\1\0\0\1\x68\0")] == [(4, b"\x67\1"), (9, b"\x68")]
    assert bitstreams.unescaped(b"\1\0\0\3\1") == b"\1\0\0\1" and bitstreams.unescaped(b"\0\0\2") is None and bitstreams.unescaped(b"\0\0\3") is None
    bits = bitstreams.Bits(bytes([0b1_010_011_0, 0b0100_0000]))
    assert [bits.unsigned(), bits.unsigned(), bits.signed()] == [0, 1, -1]
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    good = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", b"")))
    for data in [*(good[:k] for k in range(len(good))), *(good[:k] + bytes([good[k] ^ x]) + good[k + 1 :] for k in range(len(good)) for x in (1, 0x80, 0xFF))]:
        list(mp4.box_rows(data))
        for split in (bitstreams.superframe, bitstreams.start_code_units, bitstreams.configuration_sets, lambda d: bitstreams.prefixed_units(d, 4)):
            list(split(data))
    files = table(spark, [("a", bytearray(good)), ("b", bytearray(good[:-3])), ("c", None)], "path string, content binary")
    got = mp4.boxes(files).orderBy("path", "offset").collect()
    assert [(r.kind, r.depth) for r in got if r.path == "a"] == [("ftyp", 0), ("moov", 0), ("trak", 1), ("mdia", 2)]
    assert [r.error for r in got if r.path == "b"][-1].startswith("invalid")


def test_packets_follow_their_timeline(spark):
    samples = table(spark, [(1, 0, 5, 4, "x"), (2, 0, 7, 7, "x"), (None, 0, 1, 1, "x")], "track int, i int, pts long, dts long, timescale_of string")
    timelines = table(spark, [(1, -3, 90000)], "track int, offset long, timescale long")
    got = {r.track: (r.pts, r.dts, r.timescale) for r in packets.packets(samples, timelines, ["track"]).collect()}
    assert got == {1: (2, 1, 90000), 2: (7, 7, None), None: (1, 1, None)}


def test_lookups_say_what_is_missing(spark):
    samples = table(spark, [(1, 1, "a"), (1, 2, "a"), (1, None, "a")], "track int, description int, name string")
    known = table(spark, [(1, 1, None)], "track int, description int, format string")
    got = {r.description: (r.format, r.error) for r in packets.with_description(samples, known, ["track"], ["format"]).collect()}
    assert got == {1: (None, None), 2: (None, "invalid: no such description"), None: (None, "invalid: no such description")}
    fragments = table(spark, [(0, 1), (1, 2), (2, 3), (3, 9), (4, None)], "fragment int, track_id int")
    tracks = table(spark, [(1, 1), (2, 0), (3, 2)], "track_id int, descriptions int")
    found = packets.fragments_of_tracks(fragments, tracks, table(spark, [(1, 40)], "track_id int, duration int"), ["duration"]).collect()
    assert {r.fragment: (r.default_duration, r.error) for r in found} == {0: (40, None), 2: (None, None), 3: (None, "invalid: unknown track"), 4: (None, "invalid: unknown track")}


def test_whole_track_checks(spark):
    rows = table(spark, [(1, "a"), (1, "a"), (2, "a"), (2, None), (3, None), (3, None)], "track int, description string")
    assert {r.track: r.constant for r in packets.keeps_description(rows, ["track"], "description").collect()} == {1: True, 2: False, 3: True}
    held = table(spark, [(1, (1 << 63) - 1), (1, 5), (2, None), (3, 4)], "buffer int, size long")
    assert {r.buffer: r.retained for r in packets.retained_bytes(held, ["buffer"], "size").collect()} == {1: (1 << 63) - 1, 2: 0, 3: 4}
    sync = table(spark, [(1, 9, 0, True), (1, 9, 1, True), (1, 3, 2, True), (1, 1, 3, False)], "track int, t long, i int, sync boolean")
    assert [(r.i, r.position) for r in packets.sync_index(sync, ["track"], "t", "i", "sync").orderBy("position").collect()] == [(2, 0), (0, 1), (1, 2)]
    sizes = table(spark, [(3, 5), (4, 4)], "w long, h long").select(packets.visible_bytes(F.col("w"), F.col("h")).alias("n")).collect()
    assert [r.n for r in sizes] == [15 + 2 * 2 * 3, 16 + 8]


def test_references_are_those_of_the_slots(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.randrange(256), *(rng.randrange(8) for _ in range(3))) for s in range(2) for i in range(40)]
    got = packets.resolve_references(table(spark, rows, "s int, i int, refresh int, a int, b int, c int"), ["s"], ["i"], "i", "refresh", ["a", "b", "c"]).collect()
    want, slots = {}, {}
    for s, i, refresh, *refs in rows:
        held = slots.setdefault(s, [None] * 8)
        want[s, i] = [held[r] for r in refs]
        slots[s] = [i if refresh >> k & 1 else x for k, x in enumerate(held)]
    assert {(r.s, r.i): [r.ref0, r.ref1, r.ref2] for r in got} == want
    assert all((r.error is None) == (None not in want[r.s, r.i]) for r in got)


def test_reference_lists_equal_plain_python(spark):
    rng = random.Random(6)
    buffers = []
    for k in range(60):
        n = rng.randint(0, 5)
        frames, pocs, longs = rng.sample(range(16), n), rng.sample(range(40), n), rng.sample(range(8), n)
        buffers.append((k, [(10 * k + j, frames[j], pocs[j], longs[j] if rng.random() < 0.3 else None) for j in range(n)]))
    rows = table(spark, buffers, f"k int, held {pictures.REFERENCE}")
    p, b = pictures.p_list(F.col("held"), F.lit(8), 16), pictures.b_lists(F.col("held"), F.lit(20))
    got = {r.k: r for r in rows.select("k", p.alias("p"), b.alias("b"), pictures.active_list(p, F.lit(3), F.slice(p, 2, 2)).alias("active")).collect()}
    for k, held in buffers:
        short, long = [x for x in held if x[3] is None], [x[0] for x in sorted(held, key=lambda x: x[3] or 0) if x[3] is not None]
        want = [x[0] for x in sorted(short, key=lambda x: -(x[1] - 16 if x[1] > 8 else x[1]))] + long
        before = [x[0] for x in sorted(short, key=lambda x: -x[2]) if x[2] <= 20]
        after = [x[0] for x in sorted(short, key=lambda x: x[2]) if x[2] > 20]
        one, two = before + after + long, after + before + long
        if one == two and len(two) > 1:
            two[:2] = two[1::-1]
        active = (want + [None] * 3)[:3]
        for at, moved in enumerate(want[1:3]):
            active = (active[:at] + [moved] + [x for x in active[at:] if x != moved])[:3]
        assert (got[k].p, got[k].b.list0, got[k].b.list1, got[k].active) == (want, one, two, active)


def test_reference_lists_hold_the_events_before_each(spark):
    from framelake.plans import queries

    sf = "/root/testdata/sf0.001"
    events = sorted((r.user_id, r.event_id) for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id").collect())
    streams_of: dict[int, list[int]] = {}
    want = {}
    for user, event in events:
        earlier = streams_of.setdefault(user, [])
        want[user, event] = sorted(earlier[-6:])
        earlier.append(event)
    rows = queries.QUERIES["g5_reference_lists"](spark, sf).collect()
    assert len(rows) == len(events) and max(map(len, want.values())) == 6
    for r in rows:
        held = want[r.user_id, r.event_id]
        assert sorted(r.p) == sorted(r.list0) == sorted(r.list1) == held
        short = sorted((x for x in held if x % 5), key=lambda x: (-(x % 16 - 16 if x % 16 > 8 else x % 16), x))
        assert r.p == short + sorted((x for x in held if not x % 5), key=lambda x: (x % 3, x))


def test_configuration_sets_are_whole_or_an_error():
    good = bytes.fromhex("01640028ffe1000267420100016800")
    assert list(bitstreams.configuration_sets(good)) == [(8, b"\x67\x42", None), (13, b"\x68", None)]
    for data in (b"", good[:12], good[:6], good[:5] + b"\xe0" + good[6:], good[:8] + b"\x68" + good[9:], good[:10] + b"\0", b"\2" + good[1:]):
        assert [error is not None for _, _, error in bitstreams.configuration_sets(data)] == [True]


def test_companded_samples_are_those_of_the_standard(spark):
    codes = {0x00: -32124, 0x80: 32124, 0xFF: 0, 0x7F: 0}
    rows = table(spark, [(c,) for c in codes], "c int").select("c", audio.mu_law(F.col("c")).alias("x")).collect()
    assert {r.c: r.x * 32768 for r in rows} == codes
    codes = {0xD5: 8, 0x55: -8, 0xAA: 32256, 0x2A: -32256}
    rows = table(spark, [(c,) for c in codes], "c int").select("c", audio.a_law(F.col("c")).alias("x")).collect()
    assert {r.c: r.x * 32768 for r in rows} == codes


LSB_DDL = "s long, i long, lsb long, ref boolean, idr boolean, reset boolean, delta long, field boolean, bot boolean"


def order_counts(spark, rows):
    got = pictures.order_counts_by_lsb(table(spark, rows, LSB_DDL), ["s"], ["i"], "lsb", 16, "ref", "idr", "reset", "delta", "field", "bot").orderBy("s", "i").collect()
    return [(r.top, r.bottom) for r in got]


def test_order_counts_compare_with_references(spark):
    row = lambda i, lsb, ref=True, idr=False, reset=False, delta=0, field=False, bot=False: (1, i, lsb, ref, idr, reset, delta, field, bot)
    # The row of 2 is no reference, so 12 is compared with 14 and does not turn back.
    assert order_counts(spark, [row(0, 0, idr=True), row(1, 7), row(2, 14), row(3, 2, ref=False), row(4, 12), row(5, 3)]) == [(0, 0), (7, 7), (14, 14), (18, 18), (12, 12), (19, 19)]
    # An IDR picture begins anew; after a reset the next row is compared with the top less the lesser count.
    assert order_counts(spark, [row(0, 14), row(1, 2, idr=True), row(2, 9, reset=True, delta=-9), row(3, 1), row(4, 0, field=True, bot=True)]) == [(-2, -2), (2, 2), (9, 0), (17, 17), (None, 16)]
    assert order_counts(spark, []) == []


def test_whole_frame_numbers_begin_anew(spark):
    rows = table(spark, [(1, i, n, d) for i, (n, d) in enumerate([(14, False), (15, False), (0, False), (1, False), (0, True), (1, False)])], "s long, i long, n long, idr boolean")
    assert [r.abs_frame_num for r in pictures.whole_frame_numbers(rows, ["s"], ["i"], "n", 16, "idr").orderBy("i").collect()] == [14, 15, 16, 17, 0, 1]


def test_drained_order_equals_a_deep_buffer(spark):
    rng = random.Random(2)
    rows = table(spark, [(rng.randint(0, 2), i, rng.randint(0, 9)) for i in range(60)], "s long, i long, v long")
    key = lambda f: sorted(map(tuple, f.select("s", "i", "output_index").collect()))
    assert key(streams.drained_order(rows, ["s"], ["i"], "v")) == key(streams.reorder_bounded(rows, ["s"], ["i"], "v", 1 << 30))


def test_edit_lists_keep_their_errors(spark):
    good = media_queries.sample_file(1)
    at = good.index(b"elst") + 4
    spoilt = {"version": (at, b"\2"), "flags": (at + 3, b"\1"), "count": (at + 7, b"\3"), "time": (at + 8 + 8, (-2).to_bytes(8, "big", signed=True))}
    files = [("good", good)] + [(name, good[:k] + new + good[k + len(new) :]) for name, (k, new) in spoilt.items()]
    got: dict = {}
    for r in tracks.edit_lists(table(spark, files, "path string, content binary")).orderBy("path", "ordinal").collect():
        got.setdefault(r.path, []).append((r.media_time, r.error))
    assert got == {
        "good": [(-1, None), (1024, None)],
        "version": [(None, "unsupported version or flags")],
        "flags": [(None, "unsupported version or flags")],
        "count": [(None, "length differs from count")],
        "time": [(-2, "media time under -1"), (1024, None)],
    }


def test_fragment_samples_by_hand(spark):
    samples = table(spark, [(1, 1, 1, 0, 10, 3, 0), (1, 1, 1, 1, None, 4, 0x10000), (1, 1, 2, 0, 10, 5, None), (2, 1, 1, 0, 10, 3, 0), (3, 2, 1, 0, 10, None, 0), (3, 2, 1, 1, 10, 9, 0)], "f long, t long, run long, k long, duration long, size long, flags long")
    starts = table(spark, [(1, 1, 100, 8), (1, 2, 100, None), (2, 1, 100, None), (3, 1, 0, 0)], "f long, run long, base long, data_offset long")
    defaults = fragments.track_defaults(table(spark, [(1, 1, 7, None, 0)], "t long, description long, duration long, size long, flags long"), ["t"])
    got = [(r.f, r.run, r.k, r.offset, r.duration, r.sync, r.error) for r in fragments.fragment_samples(samples, starts, defaults, ["f"], ["t"]).orderBy("f", "run", "k").collect()]
    assert got == [
        (1, 1, 0, 108, 10, True, None),
        (1, 1, 1, 111, 7, False, None),
        (1, 2, 0, 115, 10, True, None),
        (2, 1, 0, None, 10, True, "unsupported: first run has no data offset"),
        (3, 1, 0, None, 10, True, "invalid: sample has no size"),
        (3, 1, 1, None, 10, True, None),
    ]


def test_table_errors_of_a_sound_and_an_empty_track(spark):
    make = lambda rows, ddl: table(spark, rows, ddl)
    tables = lambda keep: [
        make([(1, 1, 3), (1, 2, 2)] * keep, "track int, run int, count int"),
        make([(1, 1, 5)] * keep, "track int, run int, count int"),
        make([(1, 1, 1000), (1, 2, 2000)] * keep, "track int, chunk int, chunk_offset long"),
        make([(1, 1, 2, 1), (1, 2, 3, 1)] * keep, "track int, first_chunk int, samples_per_chunk int, description int"),
        make([(1, k, 10 + k) for k in range(5)] * keep, "track int, sample_index long, size int"),
    ]
    marks = lambda *n: make([(1, k) for k in n], "track int, sample_number long")
    assert runs.sample_table_errors(*tables(1), marks(1, 4), ["track"]).count() == 0
    assert runs.sample_table_errors(*tables(0), marks(), ["track"]).count() == 0
    assert sorted(r.error for r in runs.sample_table_errors(*tables(1), marks(0, 4, 4), ["track"]).collect()) == ["stss sample number is out of range", "stss sample number is repeated"]


def test_references_by_number_and_of_a_list(spark):
    rows = table(spark, [(1, [(10, 14, 3, None), (11, 2, 5, None), (12, 2, 7, 0), (13, 2, 9, None)]), (2, [])], f"k int, held {pictures.REFERENCE}")
    # The current frame number is 4: 14 is of the turn before, -2; of two equal numbers the first counts.
    at = lambda n: pictures.short_term_by_number(F.col("held"), F.lit(4), 16, F.lit(n))["id"]
    got = rows.orderBy("k").select(at(14), at(-2), at(2), at(3), pictures.long_term_by_index(F.col("held"), F.lit(0))["id"], pictures.long_term_by_index(F.col("held"), F.lit(1))["id"]).collect()
    assert [tuple(r) for r in got] == [(10, 10, 11, None, 12, None), (None,) * 6]
    listed = rows.orderBy("k").select(F.transform(pictures.entries_of_list(F.array(F.lit(13), F.lit(None).cast("long"), F.lit(99)), F.col("held")), lambda x: x["poc"])).collect()
    assert [r[0] for r in listed] == [[9, None, None], [None, None, None]]


def test_tracks_by_index_durations_and_modes(spark):
    tracks = table(spark, [("a", 0, "vide"), ("a", 1, "soun")], "file string, track_index long, kind string")
    asked = table(spark, [("a", 1), ("a", 2), ("a", -1), ("a", None), ("b", 0)], "file string, wanted long")
    got = sorted(((r.file, r.wanted, r.kind, r.error is None) for r in packets.track_by_index(asked, tracks, ["file"], "wanted", ["kind"]).collect()), key=str)
    assert got == sorted([("a", 1, "soun", True), ("a", 2, None, False), ("a", -1, None, False), ("a", None, None, False), ("b", 0, None, False)], key=str)
    times = table(spark, [(1024, 48000), (1, 0), (None, 8000)], "n long, rate long").select(audio.duration_of_frames(F.col("n"), F.col("rate")).alias("t")).collect()
    assert [r.t and tuple(r.t) for r in times] == [(1024, 48000), None, None]
    modes = table(spark, [(5, 5), (6, 5), (6, None), (None, 5)], "n long, most long").select(seek.seek_mode(F.col("n"), F.col("most"))).collect()
    assert [r[0] for r in modes] == ["Exact", "Preview", "Exact", None]


def test_sample_descriptions_say_what_is_wrong(spark):
    vp9 = lambda version=1, flags=0, more=b"", size=0: bytes([version, 0, 0, flags, 0, 10, 0x82, 1, 1, 1, 0, size]) + more
    entry, file = media_queries.video_entry, media_queries.described_file
    cases = {
        "sound": (file(1, entry(b"vp09", 8, 4, vp9(more=b"ab", size=2))), None),
        "two": (file(1, entry(b"avc1", 8, 4, b"a", b"b")), "invalid: more than one configuration"),
        "version": (file(1, entry(b"vp09", 8, 4, vp9(version=2))), "unsupported: version of the configuration"),
        "flags": (file(1, entry(b"vp09", 8, 4, vp9(flags=1))), "invalid: flags of the configuration"),
        "length": (file(1, entry(b"vp09", 8, 4, vp9(size=1))), "invalid: length of the configuration"),
        "short": (file(1, entry(b"vp09", 8, 4, b"\1\0\0\0")), "invalid: truncated configuration"),
        "entry": (file(1, (20).to_bytes(4, "big") + b"avc1" + bytes(12)), "invalid: truncated entry"),
        "more": (file(1, entry(b"avc1", 8, 4, b"a"), entry(b"avc1", 8, 4, b"a")), "invalid: count of entries differs"),
    }
    files = [(k, v[0]) for k, v in cases.items()] + [("null", None), ("none", file(0)), ("junk", bytes(40))]
    rows = tracks.sample_descriptions(table(spark, files, "path string, content binary")).collect()
    assert {r.path: r.error for r in rows} == {k: v[1] for k, v in cases.items()}
    assert [(r.width, r.height, r.bit_depth, r.configuration[-4:]) for r in rows if r.path == "sound"] == [(8, 4, 8, "6162")]
    assert all(r.width is None and r.configuration is None for r in rows if r.error)


def test_descriptions_of_damaged_files_are_rows(spark):
    whole = media_queries.described_file(2, media_queries.video_entry(b"avc1", 640, 360, b"\1\x42"), media_queries.video_entry(b"vp09", 64, 36, bytes([1, *bytes(11)])))
    rng = random.Random(4)
    files = [(f"cut{k}", whole[:k]) for k in range(0, len(whole), 3)]
    for k in range(100):
        bent = bytearray(whole)
        bent[rng.randrange(len(bent))] = rng.randrange(256)
        files.append((f"bent{k}", bytes(bent)))
    rows = tracks.sample_descriptions(table(spark, files, "path string, content binary")).collect()
    assert all(r.error is None or r.width is None for r in rows)
    assert not [r for r in rows if r.path.startswith("cut")]


def test_tiles_cover_the_frame_or_say_why_not(spark):
    rows = [(1, b"h" + bytes([0, 0, 0, 2]) + b"xxyy", 1, 2), (2, b"hyy", 1, 1), (3, b"h\0\0", 1, 2), (4, b"h", 2, 1), (5, b"h", 1, 1), (6, None, 1, 1), (7, b"h\0\0\0\x09xx", 1, 2)]
    found = {r.i: r.t for r in table(spark, rows, "i int, frame binary, start int, tiles int").select("i", scalars.tile_ranges("frame", "start", "tiles").alias("t")).collect()}
    assert [tuple(x) for x in found[1].ranges] == [(5, 7), (7, 9)] and [tuple(x) for x in found[2].ranges] == [(1, 3)]
    assert {k: t.error for k, t in found.items() if t and t.error} == {3: "truncated: tile size", 4: "truncated: tile payload", 5: "invalid: empty tile", 7: "truncated: tile payload"}
    assert found[6] is None
    for blocks, log2 in ((9, 1), (64, 3), (1000, 2)):
        bounds = [tuple(r.t) for r in spark.range(1 << log2).select(scalars.tile_bounds(F.col("id"), F.lit(blocks), F.lit(log2)).alias("t")).collect()]
        assert bounds[0][0] == 0 and bounds[-1][1] == blocks and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))


def test_retargets_go_forward_only(spark):
    outputs = [("a", "Format", None), ("a", "Frame", 5), ("a", "Frame", 9), ("b", "Frame", 5), ("b", "Format", None), ("c", "Frame", 1), ("c", "Frame", None), ("d", "Frame", 1), ("e", "Frame", 1), ("f", "Frame", 1), ("none", "Frame", 0)]
    requests = [("a", 3, 7, False), ("b", 3, 7, False), ("c", 0, 7, None), ("d", None, 7, False), ("e", 9, 7, False), ("f", 3, 7, True), ("g", 3, 7, False), ("h", 3, None, False), ("i", 3, 3, False)]
    waiting = table(spark, outputs, "stream string, kind string, pts long")
    plan = seek.retarget_forward(waiting, table(spark, requests, "stream string, current long, target long, draining boolean"), ["stream"])
    got = {r.stream: (r.error is None, r.starts_at, r.clears, r.reannounces) for r in plan.collect()}
    assert got == {"a": (True, 7, False, False), "b": (True, 7, True, True), "c": (True, 7, False, False), "d": (False, None, False, False), "e": (False, 9, False, False), "f": (False, 3, False, False), "g": (True, 7, True, False), "h": (False, 3, False, False), "i": (True, 3, False, False)}
    kept = seek.kept_outputs(waiting, plan, ["stream"]).collect()
    assert sorted((r.stream, r.kind, str(r.pts)) for r in kept) == sorted([("a", "Format", "None"), ("a", "Frame", "9"), ("c", "Frame", "None"), ("d", "Frame", "1"), ("e", "Frame", "1"), ("f", "Frame", "1"), ("none", "Frame", "0")])


def test_empty_tables(spark):
    rows = table(spark, [], "track int, run int, count int, delta int")
    assert runs.decode_times(rows, ["track"], ["run"], "count", "delta").count() == 0
    assert streams.reorder_bounded(table(spark, [], "s int, i int, v int"), ["s"], ["i"], "v", 2).count() == 0


def test_streaming_reorder_equals_batch(spark, tmp_path):
    from framelake.streaming.reorder import reorder_stream

    rng = random.Random(9)
    rows = [(s, i, rng.randint(0, 50), i == 19) for s in range(3) for i in range(20)]
    for k in range(4):
        table(spark, [r for r in rows if r[1] // 5 == k], "stream long, decode_index long, poc long, last boolean").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema("stream long, decode_index long, poc long, last boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = reorder_stream(source, 2).writeStream.format("memory").queryName("reordered").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.stream, r.decode_index): r.output_index for r in spark.table("reordered").collect()}
    batch = streams.reorder_bounded(table(spark, rows, "stream long, decode_index long, poc long, last boolean"), ["stream"], ["decode_index"], "poc", 2)
    assert got == {(r.stream, r.decode_index): r.output_index for r in batch.collect()}

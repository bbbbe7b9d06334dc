"""Cursors, routing, orders of tables and validators: edge cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from framelake.functions import audio
from framelake.operators import cursors, runs, summaries


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_cursors_equal_a_walk(spark):
    rng = random.Random(1)
    lengths = {0: 0, 1: 3, 2: 20}
    rows = [(t, c, i, rng.choice(["next", "next", "next", "seek", "rewind", None]), rng.choice([None, -1, 0, 2, 3, 19, 20, 21])) for t in range(4) for c in range(2) for i in range(60)]
    got = {(r.t, r.c, r.i): (r.packet, r.position, r.error is not None) for r in cursors.cursor_reads(table(spark, rows, "t int, c int, i long, op string, target long"), table(spark, list(lengths.items()), "t int, packets int"), ["t", "c"], ["t"], "i").collect()}
    at, want = {}, {}
    for t, c, i, op, target in rows:
        n, p = lengths.get(t, 0), at.get((t, c), 0)
        packet = p if op == "next" and p < n else None
        wrong = op == "seek" and (target is None or not 0 <= target <= n)
        p = min(p + 1, n) if op == "next" else 0 if op == "rewind" else target if op == "seek" and not wrong else p
        at[t, c] = p
        want[t, c, i] = (packet, p, wrong)
    assert got == want


def test_packets_go_to_the_last_decoder_that_was_taken(spark):
    rows = table(spark, [(1, 0, None), (1, 1, "vp9"), (1, 2, None), (1, 3, "av1"), (1, 4, None), (1, 5, "h264"), (None, 0, None)], "s int, i long, codec string")
    got = {(r.s, r.i): (r.decoder, r.error) for r in cursors.route_packets(rows, ["s"], "i").collect()}
    assert got == {(1, 0): (None, "invalid: not configured"), (1, 1): ("vp9", None), (1, 2): ("vp9", None), (1, 3): ("vp9", "unsupported: codec"), (1, 4): ("vp9", None), (1, 5): ("h264", None), (None, 0): (None, "invalid: not configured")}


def test_orders_of_tables(spark):
    chunks = table(spark, [(1, 1, 1, 2, 1), (1, 2, 4, 2, 1), (2, 1, 1, 2, 1), (2, 2, 1, 2, 1), (3, 1, 1, 0, 1), (4, 1, 1, 1, 2), (5, 1, None, 1, 1), (6, 1, 1, 1, 1)], "t int, run int, first_chunk int, samples_per_chunk int, description int")
    syncs = table(spark, [(1, 1, 1), (1, 2, 2), (2, 1, 5), (2, 2, 5), (7, 1, None)], "t int, run int, sample_number int")
    got = sorted((r.t, r.error) for r in runs.table_order_errors(chunks, syncs, table(spark, [(t, 1) for t in (1, 2, 3, 4, 5)], "t int, n int"), ["t"]).collect())
    assert got == [(2, "stsc first chunks do not rise"), (2, "stss sample numbers do not rise"), (3, "stsc chunk has no samples"), (4, "stsc description is out of range"), (5, "stsc first chunks do not rise"), (6, "stsc description is out of range"), (7, "stss sample numbers do not rise")]


def test_samples_that_pass_63_bits(spark):
    big = (1 << 63) - 1
    samples = table(spark, [("a", 0, 10), ("a", 1, 10), ("b", big, big), ("c", -1, 1), ("d", 0, 0)], "f string, offset long, size long")
    files = table(spark, [("a", 10), ("b", big), ("c", 9)], "f string, length long")
    got = {(r.f, r.offset): r.error for r in runs.samples_past_end(samples, files, ["f"]).collect()}
    assert got == {("a", 0): None, ("a", 1): "invalid: sample exceeds the input", ("b", big): "invalid: sample exceeds the input", ("c", -1): "invalid: offset is negative", ("d", 0): "invalid: no such file"}


def test_audio_configuration_without_options(spark):
    row = spark.range(1).select(*(audio.decoder_config_error(F.lit(c), F.lit(1), F.lit(1), F.lit(None).cast("binary"), *[F.lit(None).cast("int")] * 4).alias(c) for c in ("mp3", "alac", "adpcm_ima_qt"))).first()
    assert tuple(row) == (None, "invalid: codec needs data", "invalid: codec needs frame counts")


def test_totals_of_tables_that_miss_each_other(spark):
    got = summaries.table_totals(table(spark, [(1, 2, 10), (1, 3, 1), (2, 1, 5), (3, None, 1)], "t int, count int, delta int"), table(spark, [(1, 4)] * 5 + [(4, 9), (4, None)], "t int, size int"), ["t"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5, 23, 5, 20, True), (2, 1, 5, 0, 0, False), (3, 0, 0, 0, 0, True), (4, 0, 0, 1, 9, False)]

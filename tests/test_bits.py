"""The batch bit cursor and fragments from bytes, against plain Python."""

from __future__ import annotations

import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.operators import fragment_bytes
from framelake.plans import byte_queries
from framelake.sources import mp4
from framelake.sources.bits import BitBatch, bit_fields, read_picture_sets, read_sequence_sets
from framelake.sources.bitstreams import Bits
from framelake.sources.frame_heads import read_frame_heads
from framelake.sources.slices import read_slice_heads
from framelake.storage import written


class Plain(Bits):
    """One row's cursor, which stays where it was on failure."""

    def __init__(self, data):
        super().__init__(data)
        self.size = self.left

    def step(self, kind, n=None):
        before = self.left
        try:
            if kind == "bits":
                return self.read(n)
            if kind == "skip":
                return self.read(n) * 0
            if kind == "align":
                return self.read((-(self.size - self.left)) % 8) * 0
            if kind == "trailing":
                if not self.left or not self.read(1) or self.read(self.left):
                    raise ValueError
                return 1
            code = self.unsigned()
            if code >= 1 << 32:
                raise ValueError
            if kind == "signed":
                code = (code + 1) // 2 if code % 2 else -(code // 2)
                if code >= 1 << 31:
                    raise ValueError
            return code
        except (EOFError, ValueError):
            self.left = before
            return None


def test_batch_equals_one_row_at_a_time():
    rng = random.Random(1)
    rows = [None, b"", *(bytes(rng.choice([0, 0, 1, 128, rng.randint(0, 255)]) for _ in range(rng.randint(0, 24))) for _ in range(400))]
    rows += [bytes([0, 0, 0, 0, 128, 0, 0, 0, 0]), bytes([0, 0, 0, 0, 128, 0, 0, 0, 1]), bytes([0, 0, 0, 0, 64, 0, 0, 0, 0]), b"\0\0\0\1\xff\xff\xff\xff"]
    for seed in range(12):
        steps = [(k, *([rng.randint(0, 32)] if k in ("bits", "skip") else [])) for k in random.Random(seed).choices(["bits", "unsigned", "signed", "skip", "align"], k=6)] + [("trailing",)]
        batch = BitBatch(pa.array(rows, pa.binary()))
        alive = [Plain(r) if r is not None else None for r in rows]
        for kind, *n in steps:
            got = getattr(batch, {"bits": "read"}.get(kind, kind))(*n)
            values, read = got if isinstance(got, tuple) else (np.zeros(len(rows)), got)
            for j, plain in enumerate(alive):
                want = plain.step(kind, *n) if plain else None
                assert (values[j] if read[j] else None) == (want if want is None or kind not in ("skip", "align") else 0), (seed, kind, rows[j])
                if want is None:
                    alive[j] = None
    assert np.array_equal(batch.ok, [p is not None for p in alive])


def test_peek_and_rewind_leave_the_rest():
    batch = BitBatch(pa.array([b"\xa5\x0f", b"\xa5"], pa.binary()))
    assert batch.peek(12)[0].tolist() == [0xA50, 0] and batch.position.tolist() == [0, 0]
    batch.read(4)
    batch.read(12)
    assert batch.ok.tolist() == [True, False] and batch.position.tolist() == [16, 4]
    batch.rewind(np.array([4, 0]), np.array([True, True]))
    assert batch.read(4)[0].tolist() == [5, 10] and batch.ok.all()
    batch.read(4, np.array([False, True]))
    assert batch.position.tolist() == [8, 8] and batch.align().all()


def test_fields_of_null_and_empty_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"\xc0"))], "i int, d binary")
    got = rows.select("i", bit_fields(F.col("d"), [("a", "bits", 1), ("t", "trailing")]).alias("f")).select("i", "f.*").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, None, None, 0, False), (2, None, None, 0, False), (3, 1, 1, 8, True)]


def test_parameter_sets_survive_any_bytes():
    rng = random.Random(2)
    rows = [None, b"", *(bytes([rng.choice([66, 77, 100]), 0, 30]) + bytes(rng.choice([0, 255, rng.randint(0, 255)]) for _ in range(rng.randint(0, 30))) for _ in range(3000))]
    got = read_sequence_sets(pa.array(rows, pa.binary())).to_pylist()
    assert len(got) == len(rows) and all((r["width"] is None) == (r["error"] is not None) for r in got)
    assert {"invalid: truncated set", "invalid: trailing bits", None} <= {r["error"] for r in got}
    pictures = read_picture_sets(pa.array([r and r[3:] for r in rows], pa.binary())).to_pylist()
    assert all((r["qp"] is None) == (r["error"] is not None) for r in pictures) and None in {r["error"] for r in pictures}


def test_slice_heads_survive_any_bytes_and_missing_sets():
    rng = random.Random(4)
    n = 2000
    rows = [None, b"", *(bytes([rng.choice([0xE0, 0x88, 0x62, 0xFF])]) + bytes(rng.choice([0, 255, rng.randint(0, 255)]) for _ in range(rng.randint(0, 20))) for _ in range(n - 2))]
    column = lambda *values: pa.array([rng.choice(values) for _ in range(n)], pa.int64())
    got = read_slice_heads(
        pa.array(rows, pa.binary()), column(1, 5, 1, 7, None), column(0, 1), column(4, 16, None), column(0, 1, 2), column(4, 16), column(0, 1), column(0, 1), column(0, 1), column(0, 1), column(320), column(320)
    ).to_pylist()
    assert len(got) == n and all((r["kind"] is None) == (r["error"] is not None) for r in got)
    assert {"invalid: missing parameter set", "unsupported: unit type", "invalid: truncated header", None} <= {r["error"] for r in got}
    assert all(not r["is_bottom"] or r["is_field"] for r in got if r["error"] is None)


def test_frame_heads_survive_any_bytes():
    rng = random.Random(3)
    rows = [None, b"", *(bytes([rng.choice([0x80, 0x82, 0x86, 0x88, 0x8B, 0x90, 0xA0, 0xB0, 0x84])]) + rng.choice([b"", b"\x49\x83\x42"]) + bytes(rng.choice([0, 255, rng.randint(0, 255)]) for _ in range(rng.randint(0, 20))) for _ in range(2000))]
    got = read_frame_heads(pa.array(rows, pa.binary())).to_pylist()
    assert len(got) == len(rows) and all((r["profile"] is None) == (r["error"] is not None) for r in got)
    shown = [r for r in got if r["show_existing"] is not None]
    assert shown and all(r["size_slot"] == r["show_existing"] and r["width"] is None and r["refresh"] == 0 for r in shown)
    # A frame has a size of its own or a slot to take it from.
    assert all((r["width"] is None) != (r["size_slot"] is None) for r in got if r["error"] is None)


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def numbers(*values):
    return struct.pack(f">{len(values)}I", *values)


def fragments(spark, *trafs, extends=(box(b"trex", numbers(0, 1, 1, 10, 20, 0)),)):
    """What is read of a file with one fragment for each of ``trafs``."""
    data = box(b"moov", box(b"mvex", *extends)) + b"".join(box(b"moof", t) for t in trafs)
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    rows = fragment_bytes.samples_of_fragments(files).orderBy("fragment", "run", "k").collect()
    return [(r.k, r.offset, r.size, r.dts, r.pts, r.duration, r.sync, r.error) for r in rows]


def traf(*more, flags=0x20000):
    return box(b"traf", box(b"tfhd", numbers(flags, 1)), *more)


def test_runs_go_on_where_the_one_before_ended(spark):
    first = box(b"trun", numbers(0x205, 2, 100, 0x10000, 5, 6))
    second = box(b"trun", numbers(0x100, 1, 3))
    got = fragments(spark, traf(box(b"tfdt", b"\1\0\0\0", struct.pack(">Q", 1000)), first, second))
    moof = 8 + 8 + 32
    assert got == [(0, moof + 100, 5, 1000, 1000, 10, False, None), (1, moof + 105, 6, 1010, 1010, 10, True, None), (0, moof + 111, 20, 1020, 1020, 3, True, None)]


@pytest.mark.parametrize(
    ("part", "error"),
    [
        (traf(), "invalid: fragment has no run"),
        (traf(flags=0x30000), None),
        (traf(box(b"trun", numbers(1, 1, 0)), flags=0x30000), "invalid: empty fragment has a run"),
        (traf(box(b"trun", numbers(1, 1, 0)), flags=0), "unsupported: no data base"),
        (traf(box(b"trun", numbers(0, 1))), "unsupported: first run has no data offset"),
        (traf(box(b"trun", numbers(0x405, 0, 0, 0))), "invalid: flags of the first and of each sample"),
        (traf(box(b"trun", numbers(1, 1)[:6])), "invalid: truncated run"),
        (traf(box(b"tfhd", numbers(0x20000, 1)), box(b"trun", numbers(1, 1, 0))), "invalid: more than one header"),
        (box(b"traf", box(b"trun", numbers(1, 1, 0))), "invalid: fragment has no header"),
        (box(b"traf", box(b"tfhd", numbers(0x20000, 0)), box(b"trun", numbers(1, 1, 0))), "invalid: track id is zero"),
        (traf(box(b"tfdt", numbers(0, 1, 2)), box(b"trun", numbers(1, 1, 0))), "invalid: length"),
        (traf(box(b"trun", numbers(0x101, 1, 0, 0))), "invalid: sample has no duration"),
    ],
)
def test_faults_of_fragments(spark, part, error):
    assert [r[-1] for r in fragments(spark, part)] == ([error] if error else [])


def test_two_defaults_of_a_track_are_an_error(spark):
    twice = (box(b"trex", numbers(0, 1, 1, 10, 20, 0)),) * 2
    assert [r[-1] for r in fragments(spark, traf(box(b"trun", numbers(1, 1, 0))), extends=twice)] == ["invalid: duplicate track"]


def test_samples_of_fragments_are_dealt_once(spark):
    """Rows of samples are neither joined nor dealt again: the only join and the shuffles are of boxes, before there are samples."""
    data = box(b"moov", box(b"mvex", box(b"trex", numbers(0, 1, 1, 10, 20, 0)))) + box(b"moof", traf(box(b"trun", numbers(1, 2, 100)))) + box(b"moof", traf()) + box(b"moof", traf(box(b"trun", numbers(0x201, 1, 9, 7))))
    found = fragment_bytes.samples_of_fragments(spark.createDataFrame([("f", bytearray(data))], "path string, content binary"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode(")]
    assert "Exchange" not in above and "Join" not in above and plan.count("Join") == 1
    got = [(r.run, r.k, r.size, r.dts, r.error) for r in found.orderBy("fragment", "run", "k").collect()]
    assert got == [(0, 0, 20, 0, None), (0, 1, 20, 10, None), (None, None, None, None, "invalid: fragment has no run"), (0, 0, 7, 20, None)]


def longest_method(df) -> int:
    """Bytes of the longest method that is generated for a plan; none over 8,000 is ever compiled."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    spark.conf.unset("spark.sql.adaptive.enabled")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


def test_methods_of_fragments_are_short_enough_to_be_compiled(spark, monkeypatch):
    made = []
    monkeypatch.setattr(fragment_bytes, "written", lambda df: made.append(longest_method(df)) or written(df))
    made.append(longest_method(byte_queries.fragments_of_files(spark, "/root/testdata/sf0.001")))
    assert len(made) == 2 and max(made) < 8000


def test_samples_of_fragments_are_sorted_once(spark):
    plan = byte_queries.fragments_of_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode(")]
    assert above.count("Sort [") == 1 and above.count("Window [") == 5


def test_long_runs_and_times_that_start_anew(spark):
    """A run of more entries than are cut at once, an error that the next own time ends, and a second track that nothing touches."""
    n = 2 * fragment_bytes.PIECE_ENTRIES + 3
    sizes = [1 + k % 50 for k in range(n)]
    other = box(b"traf", box(b"tfhd", numbers(0x20000, 2)), box(b"tfdt", numbers(0, 7)), box(b"trun", numbers(0x201, 1, 50, 3)))
    bad = traf(box(b"trun", numbers(0x101, 2, 9, 4, 0)))
    parts = [traf(box(b"tfdt", numbers(0, 500)), box(b"trun", numbers(0x201, n, 100, *sizes))), bad, other, traf(box(b"trun", numbers(1, 1, 9))), traf(box(b"tfdt", numbers(0, 9000)), box(b"trun", numbers(1, 1, 9)))]
    got = fragments(spark, *parts, extends=(box(b"trex", numbers(0, 1, 1, 10, 20, 0)), box(b"trex", numbers(0, 2, 1, 30, 40, 0))))
    first = got[:n]
    start = first[0][1]
    assert [(r[0], r[1] - start, r[2], r[3]) for r in first] == [(k, sum(sizes[:k]), sizes[k], 500 + 10 * k) for k in range(n)]
    assert [(r[0], r[3], r[5], r[7]) for r in got[n:]] == [(0, 500 + 10 * n, 4, None), (1, None, 0, "invalid: sample has no duration"), (0, 7, 30, None), (0, None, 10, None), (0, 9000, 10, None)]


def test_boxes_of_many_files_are_those_of_each():
    rng = random.Random(7)

    def some(depth=0):
        parts = []
        for _ in range(rng.randint(0, 3)):
            kind = rng.choice([b"moov", b"trak", b"stsd", b"avc1", b"uuid", b"\xff\xfe\0a", b"trun"])
            body = some(depth + 1) if depth < 5 and rng.random() < 0.6 else bytes(rng.randint(0, 40))
            long, wrong = struct.pack(">I4sQ", 1, kind, rng.choice([16 + len(body), 0, 15, 1 << 40, (1 << 64) - 1])), struct.pack(">I4s", rng.choice([0, 2, 7, 9, 1000, (1 << 32) - 1]), kind)
            parts.append(rng.choice([box(kind, body)] * 5 + [long + body, wrong + body]))
        data = b"".join(parts)
        return data[: rng.randint(0, len(data))] if rng.random() < 0.2 else data

    deep = b""
    for _ in range(40):
        deep = box(b"moov", deep, b"abc")
    for files in ([some() for _ in range(2000)] + [deep] * 40 + [None, b""], [some() for _ in range(mp4.FEW_LEVELS - 1)], []):
        # The first two are cut off, as batches may begin inside their buffers.
        data, starts, lengths = mp4._contents(pa.array([None, b"zz", *files], pa.binary())[2:])
        rows = zip(*(c.tolist() for c in mp4.scan_batch(data, starts, lengths)), strict=True)
        got = [(f, at, size, None if kind < 0 else kind.to_bytes(4, "big").decode("latin-1"), *more, None if error < 0 else mp4.ERRORS[error]) for f, at, size, kind, *more, error in rows]
        assert got == [(k, *row) for k, content in enumerate(files) for row in mp4.box_rows(content or b"")]


def test_holders_of_contents_and_of_parsed_boxes(spark):
    stray, kinds = box(b"trex", numbers(9)), ["tfhd", "trun", "trex"]
    data = stray + box(b"moov", box(b"mvex", stray, stray)) + box(b"moof", box(b"tfhd", b"abcd"), traf(box(b"trun", b"one"), box(b"free"), box(b"trun", b"two")), box(b"traf"))
    files = spark.createDataFrame([("a", bytearray(data)), ("b", None), ("c", bytearray(b"abc"))], "path string, content binary")
    key = lambda rows: sorted((r.path, r.box, r.parent, *([bytes(x) for x in r[k]] for k in kinds)) for r in rows)
    found = {r.box: r for r in mp4.holders(files, "traf", kinds).collect()}
    trafs = [r for r in found.values() if r.parent is not None]
    assert sorted(([bytes(x) for x in r.trun], len(r.tfhd)) for r in trafs) == [([], 0), ([b"one", b"two"], 1)] and {len(r.trex) for r in trafs} == {0}
    assert len(found[-1].trex) == 1 and sorted(len(r.trex) for r in found.values()) == [0, 0, 0, 1, 2]
    same = [mp4.holders(f, "traf", kinds).na.fill({"parent": -2}).collect() for f in (files, mp4.parsed(files, kinds))]
    assert key(same[0]) == key(same[1])

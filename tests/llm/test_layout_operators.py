"""Sharding, nearest neighbours, mixing and the pipeline: laws, brute force and edge cases."""

from __future__ import annotations

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import ann_partitions, kd_shards, pfair_mix, queries
from framelake.llm.shared import stored

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "\n", "en", "a"), (4, "the same text", "en", "b"), (5, "the same text", "de", "a"), (5, "the same text", "de", "a"), (None, "no id", "en", "a"), (6, "word " * 20_000, "en", "a")]
DDL = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL).withColumn("size", F.lit("clash")).withColumn("shard", F.lit("clash")).withColumn("mix_slot", F.lit("clash"))


def empty(spark):
    return spark.createDataFrame([], DDL)


# Sharding


def check_shards(rows, texts, shards):
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}
    slots: dict[int, list[int]] = {}
    for r in rows:
        assert 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_near_equal_in_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op3_kd_shards(spark, "/root/testdata/sf0.01").collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 16)
    sizes = np.zeros(16)
    for r in rows:
        sizes[r.shard] += r.size
    assert sizes.max() / sizes.mean() < 1.1 and sizes.min() / sizes.mean() > 0.9


def test_hot_group_of_copies_is_spread(spark):
    rng = random.Random(5)
    docs = [(k, "copied text of some length " * 3 if k % 3 == 0 else "".join(rng.choices("abc ", k=rng.randint(50, 120))), "en", "s" + str(k % 4)) for k in range(1500)]
    rows = kd_shards.shard_documents(spark.createDataFrame(docs, DDL), 8).collect()
    check_shards(rows, [d[:2] for d in docs], 8)
    sizes = np.zeros(8)
    for r in rows:
        sizes[r.shard] += r.size
    assert sizes.max() / sizes.mean() < 1.1 and sizes.min() / sizes.mean() > 0.9


def test_light_copies_share_a_shard_and_target_bytes(spark):
    docs = [(k, f"text number {k // 2} " * 4, "en", "s" + str(k % 4)) for k in range(1200)]
    rows = kd_shards.shard_documents(spark.createDataFrame(docs, DDL), target_bytes=10_000).collect()
    total = sum(r.size for r in rows)
    assert {r.shard for r in rows} == set(range(math.ceil(total / 10_000)))
    by_text: dict[int, set] = {}
    for r in rows:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_shards_edge_cases(spark, odd):
    check_shards(kd_shards.shard_documents(odd, 4).collect(), [r[:2] for r in ODD], 4)
    assert kd_shards.shard_documents(empty(spark), 4).count() == 0


def test_ranks_of_values(spark):
    names = [f"https://common.beginning/{k}" for k in range(300)] + ["", "zz", "a"]
    rows = spark.createDataFrame([(n,) for n in names * 3], "source string")
    assert {r.source: r._source for r in kd_shards._dense_ranks(rows, "source").collect()} == {n: k for k, n in enumerate(sorted(names))}


def test_sources_of_a_common_beginning_split_the_tree(spark):
    docs = [(k, f"text {k:05d}", "en", f"https://common.beginning/{k % 8}" if k % 8 else None) for k in range(1600)]
    rows = kd_shards.shard_documents(spark.createDataFrame(docs, DDL), 8).collect()
    by_shard: dict[int, set] = {}
    for r in rows:
        by_shard.setdefault(r.shard, set()).add(r.doc_id % 8)
    assert sorted(map(sorted, by_shard.values())) == [[k] for k in range(8)]


def plain_tree(units: list[dict], first: int, shards: int, out: dict) -> None:
    """Cuts ``units`` at the weighted median of their widest dimension until each leaf is one shard."""
    if shards == 1 or not units:
        out.update((u["text"], first) for u in units)
        return
    spread = {d: [f(u[d] for u in units) for f in (min, max)] for d in kd_shards.DIMENSIONS}
    widths = {d: (high[0] - low[0], (high[0] << 38) + high[1] - (low[0] << 38) - low[1]) for d, (low, high) in spread.items()}
    widest = max(kd_shards.DIMENSIONS, key=lambda d: widths[d])
    units = sorted(units, key=lambda u: u[widest])
    half = shards // 2
    wanted, before, at = sum(u["bytes"] for u in units) * half / shards, 0, 0
    while before + units[at]["bytes"] < wanted:
        before += units[at]["bytes"]
        at += 1
    if wanted - before >= before + units[at]["bytes"] - wanted:
        at += 1
    plain_tree(units[:at], first, half, out)
    plain_tree(units[at:], first + half, shards - half, out)


def test_shards_equal_a_plain_tree(spark):
    rng = random.Random(9)
    docs = [(k, "".join(rng.choices("abcdé ", k=rng.randint(0, 400))), rng.choice(["en", "de", "fr", None]), "s" + str(int(rng.random() ** 2 * 30))) for k in range(400)]
    docs += [(1000 + k, docs[k][1], "zz", "a") for k in range(0, 400, 40)]
    frame = spark.createDataFrame(docs, DDL)
    tie = F.shiftrightunsigned(F.xxhash64(F.xxhash64("text"), F.lit(0).cast("long")), 26)
    ties = {r.text: r.tie for r in frame.select("text", tie.alias("tie")).collect()}
    ranks = [{v: k for k, v in enumerate(sorted({d[c] or "" for d in docs}))} for c in (2, 3)]
    units: dict[str, dict] = {}
    for _, text, lang, source in docs:
        u = units.setdefault(text, {"text": text, "bytes": 0, "length": len(text), "lang": math.inf, "source": math.inf})
        u["bytes"] += len(text.encode()) + 1
        u["lang"], u["source"] = min(u["lang"], ranks[0][lang or ""]), min(u["source"], ranks[1][source or ""])
    for d in kd_shards.DIMENSIONS:
        low, high = min(u[d] for u in units.values()), max(u[d] for u in units.values())
        for u in units.values():
            u[d] = (math.floor((u[d] - low) / max(high - low, 1) * (2**24 - 1)), ties[u["text"]])
    want: dict[str, int] = {}
    plain_tree(list(units.values()), 0, 6, want)
    rows = kd_shards.shard_documents(frame, 6).collect()
    texts = {d[0]: d[1] for d in docs}
    assert {texts[r.doc_id]: r.shard for r in rows} == want


# Nearest neighbours


def brute_neighbours(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, points = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        out[ids[q]] = [(ids[i], d[i]) for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return out


def found_by_query(frame):
    out: dict[int, list] = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_neighbours_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute_neighbours(rows, 20, 10)
    for part_vectors in (1500, 60):
        old, ann_partitions.PART_VECTORS = ann_partitions.PART_VECTORS, part_vectors
        try:
            got = found_by_query(ann_partitions.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20))
        finally:
            ann_partitions.PART_VECTORS = old
        hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        scores = {q: dict(want[q]) for q in want}
        assert all(math.isclose(s, scores[q][v], rel_tol=1e-12) for q in got for v, s in got[q] if v in scores[q])
        assert all([s for _, s in near] == sorted(s for _, s in near) for near in got.values())


def test_recall_with_the_most_parts(spark, monkeypatch):
    monkeypatch.setattr(ann_partitions, "PART_VECTORS", 32)
    rng = np.random.default_rng(3)
    points = rng.standard_normal((80, 16))[rng.integers(0, 80, 9_000)] + 0.4 * rng.standard_normal((9_000, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    assert ann_partitions.build_index(ann_partitions.sound_vectors(table, "vec_id", "embedding")).parts == ann_partitions.MOST_PARTS
    want, got = brute_neighbours(rows, 30, 10), found_by_query(ann_partitions.nearest_neighbours(table, 30))
    assert all(len(got[q]) == 10 for q in want)
    assert sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_visits_go_on_until_enough_vectors_are_held():
    p = np.array([[0.997, 0.001, 0.001, 0.001, 0.0], [0.3, 0.3, 0.2, 0.1, 0.1]])
    visited = lambda counts: [sorted(part.tolist()) for row, part in [ann_partitions.parts_to_visit(p, np.array(counts), 11)] for part in (part[row == 0], part[row == 1])]
    assert visited([20] * 5) == [[0, 1, 2], [0, 1, 2, 3, 4]]
    assert visited([2, 2, 2, 2, 9]) == [[0, 1, 2, 3, 4], [0, 1, 2, 3, 4]]
    assert visited([2, 2, 2, 9, 9])[0] == [0, 1, 2, 3]


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (200, [float("inf"), 1.0]), (7, [2.0, 2.0])] + [(k, [1.0, 0.0]) for k in range(20, 60)]
    ddl = "vec_id long, embedding array<float>"
    got = found_by_query(ann_partitions.nearest_neighbours(spark.createDataFrame(rows, ddl).withColumn("part", F.lit("clash"))))
    assert got == {q: [(int(v), float(s)) for v, s in near] for q, near in brute_neighbours(rows, 100, 10).items()}
    assert ann_partitions.nearest_neighbours(spark.createDataFrame([], ddl)).count() == 0
    few = found_by_query(ann_partitions.nearest_neighbours(spark.createDataFrame(rows[:1] + rows[3:4] + [(9, [1.0, 2.0, 3.0])], ddl)))
    assert [v for v, _ in few[0]] == [2]
    assert ann_partitions.nearest_neighbours(spark.createDataFrame(rows[:1], ddl)).count() == 0


def test_shares_of_a_part_do_not_change_the_result(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = found_by_query(ann_partitions.nearest_neighbours(table, 5))
    monkeypatch.setattr(ann_partitions, "SPLIT_VECTORS", 100)
    monkeypatch.setattr(ann_partitions, "BLOCK_QUERIES", 20)
    assert found_by_query(ann_partitions.nearest_neighbours(table, 5)) == whole


def test_parts_are_balanced():
    points = np.random.default_rng(0).standard_normal((600, 8))
    parts = ann_partitions.balanced_parts(ann_partitions.exact_neighbours(points, 8), 7)
    sizes = np.bincount(parts)
    assert len(sizes) == 7 and sizes.max() <= 2.2 * sizes.min()


# Mixing


def check_pfair(weights, blocks):
    """Windows are kept, and each source is within a block of its weight until it is spent."""
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(w) / total for s, w in weights.items()}
    plan = pfair_mix.pfair_schedule(weights, blocks)
    assert {s: len(p) for s, p in plan.items()} == blocks
    assert len({p[2] for places in plan.values() for p in places}) == sum(blocks.values())
    for s, places in plan.items():
        for i, (release, deadline, slot) in enumerate(places):
            assert (release, deadline) == (math.floor(i / share[s]), math.ceil((i + 1) / share[s])) and release <= slot < deadline
            # After slot, i + 1 blocks are done; just before it, i.
            assert abs(i + 1 - share[s] * (slot + 1)) < 1 and abs(i - share[s] * slot) < 1


def test_schedule_is_pfair():
    for seed in range(20):
        rng = random.Random(seed)
        weights = {f"s{k}": rng.random() + 0.01 for k in range(rng.randint(1, 30))}
        check_pfair(weights, {s: rng.randint(1, 300) for s in weights})
    check_pfair({"a": 0.99999, "b": 1e-5}, {"a": 20_000, "b": 3})
    check_pfair({"a": 1, "b": Fraction(1, 10**9), "c": 3e-7}, {"a": 3_000, "b": 2, "c": 4})
    assert pfair_mix.pfair_schedule({}, {}) == {}
    with pytest.raises(ValueError, match="positive"):
        pfair_mix.pfair_schedule({"a": 0.0}, {"a": 1})


def test_small_weights_are_not_rounded_up():
    plan = pfair_mix.pfair_schedule({"a": 0.99995, "b": 0.00005}, {"a": 99_995, "b": 100})
    assert sum(p[2] < 100_000 for p in plan["b"]) in (4, 5, 6)


def test_blocks_grow_with_the_bytes():
    assert pfair_mix.block_size(10) == pfair_mix.BLOCK_BYTES == pfair_mix.block_size(pfair_mix.BLOCK_BYTES * pfair_mix.MOST_BLOCKS)
    assert pfair_mix.block_size(10**14) * pfair_mix.MOST_BLOCKS >= 10**14


def test_mix_places_every_row_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    rows = pfair_mix.mix_sources(docs, pfair_mix.root_weights(pfair_mix.source_sizes(docs)), block_bytes=2000).collect()
    assert len(rows) == docs.count()
    by_source: dict[str, list] = {}
    slot_source: dict[int, str] = {}
    for r in rows:
        assert r.mix_release <= r.mix_slot < r.mix_deadline and 0 <= r.mix_offset < 2000
        assert slot_source.setdefault(r.mix_slot, r.source) == r.source
        by_source.setdefault(r.source, []).append((r.mix_block * 2000 + r.mix_offset, len((r.text or "").encode()) + 1))
    for places in by_source.values():
        at = 0
        for place, size in sorted(places):
            assert place == at
            at += size


def test_mix_edge_cases(spark, odd):
    weights = pfair_mix.root_weights(pfair_mix.source_sizes(odd))
    rows = pfair_mix.mix_sources(odd, weights, block_bytes=64).collect()
    assert len(rows) == len(ODD) and all(isinstance(r.mix_slot, int) for r in rows)
    assert pfair_mix.in_mixed_order(odd, weights, block_bytes=64).columns == odd.columns
    assert pfair_mix.mix_sources(empty(spark), {}).count() == 0
    with pytest.raises(Exception, match="no weight for source"):
        pfair_mix.mix_sources(odd, {"a": 1.0}).collect()


def test_mixed_order_is_written(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = pfair_mix.root_weights(pfair_mix.source_sizes(docs))
    slots = {r.doc_id: (r.mix_slot, r.mix_offset) for r in pfair_mix.mix_sources(docs, weights, block_bytes=1000).collect()}
    ordered = [slots[r.doc_id] for r in pfair_mix.in_mixed_order(docs, weights, block_bytes=1000).collect()]
    assert ordered == sorted(ordered) and len(ordered) == len(slots)


# Pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF), f"test_{name}")
        assert docs.columns == columns
        seen[name] = (before, docs)
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["quality"]
    assert sum(labels[d] == 1 for d in ids(before) - ids(after) if d in labels) <= 2 and ids(after) < ids(before)
    before, after = seen["near_duplicates"]
    from tests.llm.test_text_operators import brute_components

    want = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80) if d == c}
    assert ids(after) == want
    before, after = seen["pii"]
    assert ids(before) == ids(after)
    old, new = ({r.doc_id: r.text for r in f.collect()} for f in (before, after))
    changed = [d for d in old if old[d] != new[d]]
    assert all(any(c.isdigit() for c in old[d]) for d in changed)
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.doc_id in changed)
    before, after = seen["mix"]
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == ids(docs)


def test_sequences_follow_the_mix(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").cache()
    weights = pfair_mix.root_weights(pfair_mix.source_sizes(docs))
    placed = pfair_mix.mix_sources(docs, weights).drop("text").collect()
    slot = {r.doc_id: r.mix_slot for r in placed}
    rows = corpus_pipeline.pack(spark, docs, sf).collect()
    in_order = [slot[r.doc_id] for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert in_order == sorted(in_order) and {r.doc_id for r in rows} == set(slot)
    assert {r.sequence_id for r in rows} == set(range(1 + max(r.sequence_id for r in rows)))
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False)) for x in by_sequence.values())
    # The blocks of each source in any first stretch are within one of its weight, until a source is spent.
    total = sum(weights.values())
    source_of = {r.mix_slot: r.source or "" for r in placed}
    last: dict[str, int] = {}
    for r in placed:
        last[r.source or ""] = max(last.get(r.source or "", 0), r.mix_slot)
    assert len(set(in_order)) > 10
    for end in sorted(x for x in set(in_order) if x <= min(last.values())):
        for s, weight in weights.items():
            assert abs(sum(source_of[x] == s for x in set(in_order) if x <= end) - Fraction(weight * (end + 1), total)) < 1


def test_pack_takes_the_order_that_the_mix_stored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = pfair_mix.source_sizes(docs)
    packed = lambda mixed: sorted((r.sequence_id, r.offset, r.doc_id) for r in corpus_pipeline.pack(spark, mixed, SF).collect())
    mixed = corpus_pipeline.mix(spark, docs, SF)
    one = packed(stored(mixed, "test_mixed"))
    assert one == packed(mixed) == packed(docs)
    other = pfair_mix.in_mixed_order(docs, {s: 1 + k * k for k, s in enumerate(sorted(sizes))}, sizes, block_bytes=4000)
    assert packed(stored(other, "test_mixed")) != one


def test_slots_are_those_of_the_stored_order_and_read_in_few_scans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    mixed = stored(pfair_mix.in_mixed_order(docs, pfair_mix.root_weights(pfair_mix.source_sizes(docs)), block_bytes=4000), "test_mixed")
    read, slots = pfair_mix.stored_slots(mixed, 4000)
    joined = read.join(slots, ["mix_file", "mix_row"])
    # A plan that repeats its steps took more of the driver's memory than all stages before it.
    assert joined._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 4
    rows = sorted(joined.collect(), key=lambda r: (r.mix_file, r.mix_row))
    at, first, blocks = {}, {}, []
    for k, r in enumerate(rows):
        s = r.source or ""
        block = (s, at.get(s, 0) // 4000)
        at[s] = at.get(s, 0) + len((r.text or "").encode()) + 1
        first.setdefault(block, k)
        blocks.append(block)
    number = {block: n for n, block in enumerate(sorted(first, key=first.get))}
    assert [r.mix_slot for r in rows] == [number[block] for block in blocks]
    assert len(rows) == docs.count() and len(number) > 10


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

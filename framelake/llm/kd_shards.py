"""K-d tree partitioning: split at weighted medians along the widest metadata dimension.

Texts that are equal form one unit as long as it is light; heavy units are cut
into parts by hash, as a shard could not hold them evenly. Every node of the
tree is split along the dimension in which its units spread widest, at the point
that divides its bytes in proportion to the shards on either side, until each
leaf has the target bytes. A split point is found by counting bytes in buckets
and looking again into the bucket that holds it; only such counts reach the
driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import small_table, stored

#: Metadata dimensions, by name; each is a whole number per unit.
DIMENSIONS = ("length", "lang", "source")

#: Bits of a dimension's value, and of the hash behind it that orders equal values.
VALUE_BITS, TIE_BITS = 24, 38

#: Buckets per node in one round of the search for split points.
BUCKETS = 4096

#: Units up to this share of a shard stay whole.
UNIT_SHARE = 0.04

#: The search for a split point ends where it is known to this share of a shard.
CUT_SHARE = 0.004

#: Rows of a shard are numbered in so many groups.
SLOT_GROUPS = 256


@dataclass
class Node:
    """Units of this node end up in ``shards`` shards from ``first`` on."""

    id: int
    first: int
    shards: int
    bytes: float = 0.0
    dimension: str | None = None
    cut: int | None = None
    below: int | None = None
    above: int | None = None


def _dense_ranks(rows: DataFrame, name: str) -> DataFrame:
    """``name`` and its place, from 0, among the distinct values of the column.

    Values are sorted in ranges and each range is numbered by itself, on top of
    the counts of the ranges before it; there are as many ranges as partitions.
    """
    ranged = rows.select(name).distinct().repartitionByRange(name).select(name, F.spark_partition_id().alias("_range"))
    ranged = stored(ranged, f"{name}_ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(name)
    return stored(ranged.withColumn("_at", F.row_number().over(inside) - 1).join(bases, "_range").select(name, (F.col("_base") + F.col("_at")).alias(f"_{name}")), f"{name}_ranks")


def _units(rows: DataFrame, shard_bytes: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` with _part, and one row per unit (_text, _part) with its bytes and dimension values."""
    heavy = rows.groupBy("_text").agg(F.sum("size").alias("_sum")).where(F.col("_sum") > shard_bytes * UNIT_SHARE)
    # A heavy unit holds over UNIT_SHARE of a shard, so there are at most shards / UNIT_SHARE of them.
    parts = heavy.select(F.col("_text").alias("_heavy"), F.ceil(F.col("_sum") / (shard_bytes * UNIT_SHARE)).cast("long").alias("_parts"))
    cut = rows.join(F.broadcast(parts), F.col("_text") == F.col("_heavy"), "left")
    cut = cut.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("doc_id", "source", "lang"), F.col("_parts")), F.lit(0))).drop("_heavy", "_parts")
    units = cut.groupBy("_text", "_part").agg(F.sum("size").alias("bytes"), *(F.min(f"_{d}").alias(f"_{d}") for d in DIMENSIONS))
    return cut, units


def _ordinals(units: DataFrame) -> DataFrame:
    """Units with, per dimension, one number that orders by value and then by hash."""
    bounds = units.agg(*(f(f"_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max)))).first()
    tie = F.shiftrightunsigned(F.xxhash64("_text", "_part"), 64 - TIE_BITS)
    out = []
    for d in DIMENSIONS:
        low, high = bounds[f"low_{d}"] or 0, bounds[f"high_{d}"] or 0
        value = F.floor((F.col(f"_{d}") - F.lit(low)).cast("double") / F.lit(float(max(high - low, 1))) * F.lit(float((1 << VALUE_BITS) - 1))).cast("long")
        out.append(F.shiftleft(value, TIE_BITS).bitwiseOR(tie).alias(d))
    return units.select("_text", "_part", "bytes", *out)


def _node_of(nodes: list[Node]) -> Column:
    """The leaf that a unit falls into: one branch per split made so far."""
    by_id = {n.id: n for n in nodes}

    def walk(node: Node) -> Column:
        if node.cut is None:
            return F.lit(node.id)
        return F.when(F.col(node.dimension) < F.lit(node.cut), walk(by_id[node.below])).otherwise(walk(by_id[node.above]))

    return walk(by_id[0])


def _find_cuts(units: DataFrame, open_: list[Node], bounds: dict[int, tuple[int, int]], slack: float) -> None:
    """Sets the cut of each node: units under it hold the bytes of the shards below."""
    wanted = {n.id: n.bytes * (n.shards // 2) / n.shards for n in open_}
    search = {n.id: (bounds[n.id][0], bounds[n.id][1] + 1, 0.0) for n in open_}
    spark = units.sparkSession
    while search:
        step = {k: max(1, -(-(high - low) // BUCKETS)) for k, (low, high, _) in search.items()}
        of = {n.id: n for n in open_}
        frame = small_table(spark, [{"_node": k, "_low": low, "_high": high, "_step": step[k]} for k, (low, high, _) in search.items()], "_node int, _low long, _high long, _step long")
        value = F.lit(None).cast("long")
        for k in search:
            value = F.when(F.col("node") == k, F.col(of[k].dimension)).otherwise(value)
        hit = units.withColumn("_value", value).join(F.broadcast(frame), F.col("node") == F.col("_node")).where("_value >= _low and _value < _high")
        counted = hit.groupBy("node", F.expr("(_value - _low) div _step").alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        buckets: dict[int, list] = {k: [] for k in search}
        for r in counted:
            buckets[r["node"]].append((r["bucket"], float(r["bytes"]), r["n"]))
        for k, found in buckets.items():
            low, high, before = search.pop(k)
            found.sort()
            for at, size, n in found:
                if before + size >= wanted[k] or at == found[-1][0]:
                    start = low + at * step[k]
                    if n == 1 or size <= slack or step[k] == 1:
                        short, over = wanted[k] - before, before + size - wanted[k]
                        of[k].cut = start if short < over else start + step[k]
                    else:
                        search[k] = (start, min(high, start + step[k]), before)
                    break
                before += size


def build_tree(units: DataFrame, shards: int, total: float) -> list[Node]:
    """Nodes of the tree; leaves have one shard. ``units`` is read several times per level."""
    nodes = [Node(0, 0, shards, total)]
    slack = total / shards * CUT_SHARE
    while open_ := [n for n in nodes if n.cut is None and n.shards > 1]:
        placed = units.withColumn("node", _node_of(nodes))
        rows = placed.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max)))).collect()
        seen = {r["node"]: r for r in rows}
        bounds = {}
        for n in open_:
            r = seen.get(n.id)
            n.bytes = float(r["bytes"]) if r else 0.0
            if not r:
                n.dimension, n.cut = DIMENSIONS[0], 0
                continue
            # Spread in whole values first: a dimension of one value is as narrow as its hash.
            width = {d: ((r[f"high_{d}"] >> TIE_BITS) - (r[f"low_{d}"] >> TIE_BITS), r[f"high_{d}"] - r[f"low_{d}"]) for d in DIMENSIONS}
            n.dimension = max(DIMENSIONS, key=lambda d: (width[d], -DIMENSIONS.index(d)))
            bounds[n.id] = (r[f"low_{n.dimension}"], r[f"high_{n.dimension}"])
        _find_cuts(placed, [n for n in open_ if n.id in bounds], bounds, slack)
        for n in open_:
            half = n.shards // 2
            n.below, n.above = len(nodes), len(nodes) + 1
            nodes += [Node(n.below, n.first, half), Node(n.above, n.first + half, n.shards - half)]
    return nodes


def shard_documents(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``.

    The law is ``bytes``: shards are of nearly equal bytes, a text counting its
    UTF-8 bytes and one more. ``target_bytes`` sets the number of shards from
    the total. Dimensions are the length of the text and the places of ``lang``
    and ``source`` among their distinct values;
    rows of equal texts take the least values among them and share a shard as
    long as they make up at most UNIT_SHARE of one. Slots are gapless from 0
    in each shard. grown_shard is null, as the law does not foresee it. Null
    texts are empty (size 1), null langs and sources come first; repeated rows
    each get a slot; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    hashed = docs.select(
        F.col("doc_id").cast("long"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"), F.char_length(text).cast("long").alias("_length"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")
    )
    rows = stored(hashed, "shard_rows")
    total = float(rows.agg(F.sum("size")).first()[0] or 0)
    if target_bytes:
        shards = max(1, math.ceil(total / target_bytes))
    for name in ("lang", "source"):
        rows = rows.join(_dense_ranks(rows, name), name)
    cut, units = _units(rows, max(total, 1.0) / shards)
    units = stored(_ordinals(units), "shard_units")
    nodes = build_tree(units, shards, total)
    shard = F.lit(None).cast("int")
    for n in nodes:
        if n.cut is None:
            shard = F.when(F.col("_node") == n.id, F.lit(n.first)).otherwise(shard)
    leaves = units.select(F.col("_text").alias("_t"), F.col("_part").alias("_p"), _node_of(nodes).alias("_node")).select("_t", "_p", shard.alias("shard"))
    placed = cut.join(leaves, (F.col("_text") == F.col("_t")) & (F.col("_part") == F.col("_p"))).withColumn("_group", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_GROUPS)))
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_n")).select("shard", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_group").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("_at", F.row_number().over(inside) - 1).join(bases, ["shard", "_group"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("_base") + F.col("_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

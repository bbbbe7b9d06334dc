"""Cursors over packets and the decoders that packets go to, from the commands of each stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: codecs that can be decoded.
CODECS = ("h264", "vp9")


def cursor_reads(commands: DataFrame, lengths: DataFrame, cursor: list[str], track: list[str], order: str) -> DataFrame:
    """``commands`` with packet (the index read, from 0) and position (the next one) behind each.

    Commands: the ``cursor`` columns, of which ``track`` are some, a whole
    ``order`` that a cursor has once, op ("next", "seek" or "rewind") and target.
    ``lengths`` (track, packets) has one row a track. "next" reads the packet at
    the position and moves on, or reads nothing at the end; "seek" goes to a
    target from 0 to the end, and one that is null or outside changes nothing
    and is an error; "rewind" goes to 0. Other commands change nothing. Cursors
    are independent and begin at 0; a track without a length has no packets.

    A position is the last jump and the reads since, at most the end: so it is
    two running aggregates, not a walk.
    """
    sized = commands.join(lengths.select(*track, F.col("packets").cast("long").alias("_n")), track, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    lands = (F.col("op") == "seek") & F.coalesce(F.col("target").between(0, F.col("_n")), F.lit(False))
    jumped = sized.withColumn("_to", F.when(lands, F.col("target")).when(F.col("op") == "rewind", F.lit(0).cast("long")))
    running = Window.partitionBy(*cursor).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = jumped.withColumn("_part", F.count("_to").over(running))
    within = Window.partitionBy(*cursor, "_part").orderBy(order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    reads = F.count_if(F.coalesce(F.col("op") == "next", F.lit(False))).over(so_far)
    base = F.coalesce(F.first("_to").over(so_far), F.lit(0))
    placed = part.withColumns({"_base": base, "_reads": reads})
    before = F.col("_base") + F.col("_reads") - 1
    packet = F.when((F.col("op") == "next") & (before < F.col("_n")), before)
    error = F.when((F.col("op") == "seek") & F.col("_to").isNull(), "invalid: target is out of range")
    return placed.withColumns({"packet": packet, "position": F.least(F.col("_base") + F.col("_reads"), F.col("_n")), "error": error}).drop("_n", "_to", "_part", "_base", "_reads")


def route_packets(rows: DataFrame, stream: list[str], order: str) -> DataFrame:
    """``rows`` with decoder and error: where each packet of a stream goes.

    Rows: the stream, a whole ``order`` that it has once, and codec, which is
    set where a row configures the stream and null for its packets. A codec
    that cannot be decoded is refused and leaves the decoder before; packets
    before any decoder are an error.
    """
    known = F.col("codec").isin(*CODECS)
    running = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(known, F.col("codec")), ignorenulls=True).over(running)
    error = F.when(F.col("codec").isNotNull() & ~known, "unsupported: codec").when(F.col("codec").isNull() & held.isNull(), "invalid: not configured")
    return rows.withColumns({"decoder": held, "error": error})

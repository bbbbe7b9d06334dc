"""Frame sizes that are taken from reference slots, through as many frames as a chain has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.asof import as_of
from framelake.storage import written

#: Fixed value: reference slots of a decoder.
SLOTS = 8

MISSING = "invalid: missing reference"


def _opened(valid: DataFrame, stream: list[str], index: str) -> DataFrame:
    """(stream, slot, since): the first of the given frames that wrote each slot."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.getbit("_refresh", k) == 1)
    return valid.select(*stream, index, F.explode(bits).alias("_slot")).groupBy(*stream, "_slot").agg(F.min(index).alias("_since"))


def readable_frames(frames: DataFrame, stream: list[str], index: str) -> DataFrame:
    """``frames`` (_source slot or null, _refresh) with _ok: whether the slot that a frame takes its size from has been written.

    A frame that cannot be read writes nothing, so what opens a slot depends on
    which frames are readable. A slot once written stays so; in every round at
    least one more slot of a stream is opened for good, so there are at most
    eight, and a stream whose first frame writes all slots needs one.
    """
    opened = written(_opened(frames.where("_source IS NULL"), stream, index))
    while True:
        since = opened.withColumnRenamed("_slot", "_source")
        judged = frames.join(since, [*stream, "_source"], "left").withColumn("_ok", F.col("_source").isNull() | F.coalesce(F.col("_since") < F.col(index), F.lit(False))).drop("_since")
        again = written(_opened(judged.where("_ok"), stream, index))
        if again.exceptAll(opened).isEmpty():
            return judged
        opened = again


def inherited_sizes(frames: DataFrame, stream: list[str], index: str, refresh: str, slots: list[str], flags: list[str], width: str, height: str, bucket: int | None = None) -> DataFrame:
    """``frames`` with size_from (the frame whose own size it has), frame_width, frame_height and error.

    A frame takes the size of the first of its ``slots`` (0 to 7) whose flag is
    set, that is of the last readable frame before it that wrote the slot (bit
    of ``refresh``); without a set flag it has its own ``width`` and ``height``.
    Null flags are not set. A slot that nothing was written to is an error, and
    such a frame writes nothing. ``index`` is the decode order, a whole number
    that a stream has once, and a stream is not null; an empty table gives an empty
    one.

    Chains of frames that took their size from one another are followed by
    pointer doubling: each frame is joined with the source of its source until
    all sources have a size of their own, in as many rounds as the longest
    chain has binary digits. Frames that got there take no further part.
    ``bucket`` splits the lookup of one stream by spans of ``index``.
    """
    source = F.coalesce(*(F.when(F.coalesce(F.col(f), F.lit(False)), F.col(s)) for s, f in zip(slots, flags, strict=True))).cast("int")
    known = written(frames.select(*stream, index, F.col(refresh).cast("int").alias("_refresh"), source.alias("_source"), F.col(width).alias("_w"), F.col(height).alias("_h")))
    judged = written(readable_frames(known, stream, index))
    readable = judged.where("_ok")
    bits = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.getbit("_refresh", k) == 1)
    writers = readable.select(*stream, F.explode(bits).alias("_source"), F.col(index).alias("_written"))
    takers = readable.where("_source IS NOT NULL").select(*stream, "_source", index)
    first = as_of(takers, writers, [*stream, "_source"], index, "_written", "_written", strict=True, bucket=bucket, prefix="_at").select(*stream, index, F.col("_at_index").alias("_to"))
    own = readable.where("_source IS NULL").select(*stream, F.col(index).alias("_to"), "_w", "_h")

    at_end = written(first.join(own.withColumn("_done", F.lit(True)), [*stream, "_to"], "left"))
    done, going = at_end.where("_done").drop("_done"), at_end.where("_done IS NULL").drop("_done")
    while not going.isEmpty():
        # A source's pointer leads on; where it already is at the end, so are all that point to it.
        ends = done.select(*stream, F.col(index).alias("_to"), F.col("_to").alias("_next"), F.col("_w").alias("_nw"), F.col("_h").alias("_nh"), F.lit(True).alias("_done"))
        middle = going.select(*stream, F.col(index).alias("_to"), F.col("_to").alias("_next"), F.lit(None).cast(own.schema["_w"].dataType).alias("_nw"), F.lit(None).cast(own.schema["_h"].dataType).alias("_nh"), F.lit(False).alias("_done"))
        moved = written(going.select(*stream, index, "_to").join(ends.unionByName(middle), [*stream, "_to"]).select(*stream, index, F.col("_next").alias("_to"), F.col("_nw").alias("_w"), F.col("_nh").alias("_h"), "_done"))
        done = done.unionByName(moved.where("_done").drop("_done"))
        going = moved.where("NOT _done").drop("_done")
    chained = done.select(*stream, index, F.col("_to").alias("size_from"), F.col("_w").alias("frame_width"), F.col("_h").alias("frame_height"))
    alone = readable.where("_source IS NULL").select(*stream, index, F.col(index).alias("size_from"), F.col("_w").alias("frame_width"), F.col("_h").alias("frame_height"))
    sized = chained.unionByName(alone).withColumn("_sized", F.lit(True))
    joined = frames.join(sized, [*stream, index], "left")
    return joined.withColumn("error", F.when(F.col("_sized").isNull(), MISSING)).drop("_sized")

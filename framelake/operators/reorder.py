"""Display order of decoded pictures behind a buffer of bounded depth that refreshes, gaps and ends empty."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.marking import keys_of

#: What a row can be, and whether the pictures that wait before it are shown or lost.
SHOWS_WAITING = {"refresh": True, "refresh_discarding": False, "discontinuity": False, "end_of_sequence": True, "end_of_stream": True}

PICTURES = ["picture", "refresh", "refresh_discarding"]


def release(waiting: list[tuple[int, int]], kind: str, poc: int, index: int, depth: int) -> list[tuple[int, int]]:
    """What leaves ``waiting``, a heap of (poc, index), in order, as one row comes; see ``display_order``."""
    out = []
    if kind in SHOWS_WAITING:
        if SHOWS_WAITING[kind]:
            out += sorted(waiting)
        waiting.clear()
    if kind in PICTURES:
        heappush(waiting, (poc, index))
        if len(waiting) > depth:
            out.append(heappop(waiting))
    return out


def display_order(rows: DataFrame, stream: list[str], depth: int) -> DataFrame:
    """(stream, index, poc, output_index) of every picture that is shown, numbered from 0 in each stream.

    Rows: the stream, index (decode order, unique in a stream), poc and kind. A
    "picture" enters the buffer, and when more than ``depth`` wait the one of
    least (poc, index) leaves. A "refresh" first shows all that wait, in that
    order; "refresh_discarding" and "discontinuity" lose them; "end_of_sequence"
    and "end_of_stream" show them. What waits at the end of the rows without an
    end is shown as well. Null kinds and kinds of other names change nothing.

    What is shown between two such rows depends on nothing outside: so a stream
    is cut there, its parts are worked on apart, each read in order with at most
    ``depth`` pictures in hand, and numbered on by the sums of the parts before.
    """
    cuts = F.col("kind").isin(*SHOWS_WAITING)
    ordered = Window.partitionBy(*stream).orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    part = F.coalesce(F.sum(F.coalesce(cuts, F.lit(False)).cast("long")).over(ordered), F.lit(0))
    cut = rows.select(*stream, "index", "poc", "kind").withColumn("_part", part)
    # The row that ends a part says what becomes of what waits; it goes along as the part's last.
    closing = cut.where(cuts).select(*stream, "index", F.lit(None).cast("long").alias("poc"), F.when(F.col("kind").isin(*(k for k, shows in SHOWS_WAITING.items() if not shows)), "discontinuity").otherwise("end_of_sequence").alias("kind"), (F.col("_part") - 1).alias("_part"))
    opening = cut.withColumn("kind", F.when(F.col("kind").isin(*PICTURES), "picture").otherwise("none"))
    keyed = opening.withColumn("poc", F.col("poc").cast("long")).unionByName(closing).repartition(*stream, "_part").sortWithinPartitions(*stream, "_part", "index")
    names = [*stream, "_part"]

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, n = None, [], 0

        def shown(pictures: list[tuple[int, int]]) -> list[tuple]:
            nonlocal n
            n += len(pictures)
            return [(*key, index, poc, n - len(pictures) + j) for j, (poc, index) in enumerate(pictures)]

        for frame in frames:
            out = []
            for own, index, poc, kind in zip(keys_of(frame, names), frame["index"], frame["poc"], frame["kind"], strict=True):
                if own != key:
                    out += shown(sorted(waiting))
                    key, waiting, n = own, [], 0
                out += shown(release(waiting, kind, 0 if pd.isna(poc) else int(poc), int(index), depth))
            yield pd.DataFrame(out, columns=[*names, "index", "poc", "_at"])
        yield pd.DataFrame(shown(sorted(waiting)) if key else [], columns=[*names, "index", "poc", "_at"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    placed = keyed.mapInPandas(play, ", ".join([*(f"`{s}` {types[s]}" for s in stream), "_part long, index long, poc long, _at long"]))
    before = Window.partitionBy(*stream).orderBy("_part", "_at")
    return placed.withColumn("output_index", (F.row_number().over(before) - 1).cast("long")).drop("_part", "_at")


def waiting_heap(rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    heapify(rows)
    return rows

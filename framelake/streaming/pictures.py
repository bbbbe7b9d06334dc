"""Reference marking and display order of streams that arrive piece by piece, with state that ends with its stream.

Both take the rows of a stream in decode order; rows of one batch are sorted,
and a batch holds nothing that lies before an earlier one. Nothing is dropped
for being late, so there is no watermark. State is kept by stream in the
state store, which must be able to hold lists: set
``spark.sql.streaming.stateStore.providerClass`` to
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``
(in Spark 4.1 under that name; see ``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.operators.marking import HELD, Buffer, Limits, Reference, held_rows, plain_rows, store
from framelake.operators.reorder import release, waiting_heap

#: Setting and value of a state store that holds lists.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Marker(StatefulProcessor):
    """Holds the references of a stream, at most 16, and the greatest long-term index."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "index long, frame_num long, poc long, long_index int")
        self.most_long = handle.getValueState("most_long", "most_long int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = tuple(Reference(*r) for r in self.held.get())
        buffer = Buffer(held, self.most_long.get()[0] if self.most_long.exists() else None)
        out, ended = [], False
        for row in plain_rows(pd.concat(list(rows)).sort_values("index")):
            buffer, error = store(buffer, row, self.limits)
            ended = row["kind"] == "end_of_stream"
            out.append((key[0], row["index"], error, held_rows(buffer)))
        self.held.clear()
        self.most_long.clear()
        if not ended:
            if buffer.held:
                self.held.put([(r.index, r.frame_num, r.poc, r.long_index) for r in buffer.held])
            if buffer.most_long is not None:
                self.most_long.update((buffer.most_long,))
        yield pd.DataFrame(out, columns=["stream", "index", "error", "held"])

    def close(self) -> None:
        pass


def mark_references_stream(rows: DataFrame, references: int, log2_frame_nums: int) -> DataFrame:
    """As ``operators.marking.mark_references``, over a stream of rows with a column ``stream`` (long); the state of a stream ends with "end_of_stream"."""
    return rows.groupBy("stream").transformWithStateInPandas(_Marker(Limits.of(references, log2_frame_nums)), f"stream long, index long, error string, held {HELD}", "Append", "None")


class _Reorderer(StatefulProcessor):
    """Holds the pictures of a stream that wait, at most ``depth``, and how many were shown."""

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "poc long, index long")
        self.shown = handle.getValueState("shown", "shown long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        waiting = waiting_heap([tuple(r) for r in self.waiting.get()])
        n = self.shown.get()[0] if self.shown.exists() else 0
        out, ended = [], False
        for index, poc, kind in pd.concat(list(rows)).sort_values("index")[["index", "poc", "kind"]].itertuples(index=False):
            for at_poc, at in release(waiting, kind, 0 if pd.isna(poc) else int(poc), int(index), self.depth):
                out.append((key[0], at, at_poc, n))
                n += 1
            ended = kind == "end_of_stream"
        self.waiting.clear()
        self.shown.clear()
        if not ended:
            if waiting:
                self.waiting.put(waiting)
            self.shown.update((n,))
        yield pd.DataFrame(out, columns=["stream", "index", "poc", "output_index"])

    def close(self) -> None:
        pass


def display_order_stream(rows: DataFrame, depth: int) -> DataFrame:
    """As ``operators.reorder.display_order``, over a stream of rows with a column ``stream`` (long).

    What waits when a stream stops without an end stays in its state. The state
    ends with "end_of_stream"; rows that come after it are another stream,
    numbered from 0.
    """
    return rows.groupBy("stream").transformWithStateInPandas(_Reorderer(depth), "stream long, index long, poc long, output_index long", "Append", "None")

"""Bounded reordering of a stream that arrives piece by piece, with its buffer as state."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "stream long, decode_index long, poc long, output_index long"
STATE = "waiting string, released long"


def reorder_stream(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (stream, decode_index, poc, last) with output_index as a buffer of ``depth`` releases them.

    The row with ``last`` drains the buffer. Nothing is dropped for being late,
    so there is no watermark; the state of a stream is the rows that wait, at
    most ``depth``. Rows of one batch are taken in order of decode_index.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packed, released = state.get if state.exists else ("", 0)
        waiting = [tuple(map(int, x.split(":"))) for x in packed.split()]
        out = []
        rows = pd.concat(list(frames)).sort_values("decode_index")
        for at, poc, last in rows[["decode_index", "poc", "last"]].itertuples(index=False):
            heappush(waiting, (int(poc), int(at)))
            while waiting and (len(waiting) > depth or last):
                p, a = heappop(waiting)
                out.append((key[0], a, p, released))
                released += 1
        state.update((" ".join(f"{p}:{a}" for p, a in waiting), released))
        yield pd.DataFrame(out, columns=["stream", "decode_index", "poc", "output_index"])

    return rows.groupBy("stream").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)

"""Token counts: greedy longest-match pieces per text, counted by a linear automaton.

A trie over the vocabulary carries failure links. Where no edge fits, the
automaton follows the link and adds the number of pieces that this settles,
which is known beforehand, so no piece is ever built or looked up twice.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framelake.llm.shared import Memo, row_chunks

#: What stands before each word, as in the vocabulary's pieces that begin a word.
WORD_START = b" "


class LongestMatch:
    """Counts the pieces of greedy longest match from the left in linear time."""

    def __init__(self, pieces: tuple[bytes, ...]):
        # Per node: edges by byte, failure link (-1: none) and the pieces settled by following it.
        self.edges: list[dict[int, int]] = [{}]
        ends = {0: False}
        for piece in pieces:
            node = 0
            for byte in piece:
                after = self.edges[node].get(byte)
                if after is None:
                    after = self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                    ends[after] = False
                node = after
            if piece:
                ends[node] = True
        self.fail, self.settled = [-1] * len(self.edges), [0] * len(self.edges)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in self.edges[node].items():
                    below.append(child)
                    if ends[child]:
                        self.fail[child], self.settled[child] = 0, 1
                        continue
                    at, count = self.fail[node], self.settled[node]
                    while at >= 0 and byte not in self.edges[at]:
                        count += self.settled[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.settled[child] = self.edges[at][byte], count
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of the word; -1 where the vocabulary cannot cover it."""
        edges, fail, settled = self.edges, self.fail, self.settled
        node = pieces = 0
        for byte in word:
            after = edges[node].get(byte)
            while after is None:
                if fail[node] < 0:
                    return -1
                pieces += settled[node]
                node = fail[node]
                after = edges[node].get(byte)
            node = after
        while node:
            if fail[node] < 0:
                return -1
            pieces += settled[node]
            node = fail[node]
        return pieces


def vocabulary_pieces(path: str) -> tuple[bytes, ...]:
    """The byte pieces of a ``.tiktoken`` file (base64 and rank per line) or of a JSON list of texts."""
    with open(path, "rb") as file:
        data = file.read()
    if path.endswith(".json"):
        return tuple(x.encode() for x in json.loads(data))
    return tuple(base64.b64decode(line.split()[0]) for line in data.splitlines() if line)


@lru_cache(maxsize=2)
def _automaton(pieces: tuple[bytes, ...]) -> LongestMatch:
    """One automaton per Python worker."""
    return LongestMatch(pieces)


COUNT_FIELDS = [StructField("n_words", LongType()), StructField("n_pieces", LongType()), StructField("n_unknown", LongType())]


def count_tokens(docs: DataFrame, pieces: tuple[bytes, ...]) -> DataFrame:
    """``docs`` with n_words, n_pieces and n_unknown of ``text``, by greedy longest match.

    Words are the runs between ASCII white space; a word is matched with a
    space before it. A word that the vocabulary cannot cover is one unknown
    piece: it counts in n_pieces and in n_unknown. Null and empty texts have no
    words. Whole texts are read whatever their length; repeated rows repeat;
    an empty table stays empty; other columns stay, and columns named like the
    three counts are replaced.
    """
    names = {f.name for f in COUNT_FIELDS}
    fields = [f for f in docs.schema.fields if f.name.lower() not in names]
    schema = StructType([*fields, *COUNT_FIELDS])
    kept = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    at = kept.columns.index("text")
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shipped.value)
        memo = Memo(lambda word: automaton.count(WORD_START + word))
        for batch in row_chunks(batches):
            words, found, unknown = [], [], []
            for text in batch.column(at).to_pylist():
                split = (text or "").encode().split()
                counts = list(map(memo.__getitem__, split))
                lost = counts.count(-1)
                words.append(len(split))
                found.append(sum(counts) + 2 * lost)
                unknown.append(lost)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(found, pa.int64()), pa.array(unknown, pa.int64())], names=schema.names)

    return kept.mapInArrow(count_batches, schema)

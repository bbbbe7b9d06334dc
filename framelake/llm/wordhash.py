"""64-bit hashes of the words of many texts at once, straight from their bytes.

Words are the runs between ASCII white space. The hash of a word is a
polynomial over its bytes, read off running sums, and then mixed; equal words
have equal hashes on every machine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: White space, and A-Z as a-z.
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])

#: An odd multiplier, and one that spreads sums.
BASE = 0x9E3779B97F4A7C15 | 1
SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes hashed at once; a longer word is still hashed whole.
BLOCK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=2)
def _byte_values(fold: bool) -> np.ndarray:
    values = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
    return values[FOLD] if fold else values


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers from 0 on, and to those downwards, modulo 2^64."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def word_hashes(data: np.ndarray, bounds: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has. ``fold`` takes A-Z as a-z."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = bounds[:-1][bounds[:-1] < len(data)]
    first[opens] = inside[opens]
    starts = np.flatnonzero(first)
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    values = _byte_values(fold)
    out = np.empty(len(starts), np.uint64)
    word = 0
    while word < len(starts):
        begin = starts[word]
        stop = max(word + 1, int(np.searchsorted(ends, begin + BLOCK_BYTES, side="right")))
        block = data[begin : ends[stop - 1]]
        up, down = _powers(1 << max(BLOCK_BYTES, len(block)).bit_length())
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(values[block] * up[: len(block)], out=sums[1:])
        s, e = starts[word:stop] - begin, ends[word:stop] - begin
        out[word:stop] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        word = stop
    return mix(out), counts


def hash_words(words: list[bytes], fold: bool = False) -> np.ndarray:
    """The hash of each of the given words, which hold no white space."""
    return word_hashes(*joined_bytes(words), fold=fold)[0]


def sequence_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash per run of ``k`` units in order; the runs overlap and cross whatever lies in ``units``."""
    n = max(0, len(units) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * SPREAD + units[j : j + n])
    return out

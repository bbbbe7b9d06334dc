"""Subword lattice of a word: all ways to cut it into vocabulary pieces, many words at once.

Words of one length are handled as a table, long words each by itself in runs
of its positions. From each position only what begins some piece is followed;
position after position the log probabilities of all segmentations up to there
are added in log space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from framelake.llm.wordhash import SPREAD

#: What stands before each word, as in the pieces that begin a word.
WORD_START = b" "

#: Words of one length that are handled at once.
TABLE_WORDS = 1 << 14

#: Bytes of a table; fewer long words are handled at once.
TABLE_BYTES = 1 << 20

#: Longer words are handled each by itself, so many positions at once.
LONG_BYTES = 512
RUN_BYTES = 1 << 16

#: Bits of a slot in the table of beginnings; what shares a slot is followed in vain.
BEGIN_BITS = 22

#: Bits of a slot in the tables of pieces, and what spreads the pieces over them.
SLOT_BITS = 20
FIRST_ODD = np.uint64(0x9FB21C651E98DF25)
SECOND_ODDS = [np.uint64((0xD6E8FEB86659FD93 + (k << 20)) & ((1 << 64) - 1)) for k in range(1000)]


class Lattice:
    """The pieces that may stand in a word: any of the vocabulary that holds no white space behind its first byte."""

    def __init__(self, pieces: tuple[bytes, ...]):
        white = set(b" \t\n\v\f\r")
        usable = [k for k, p in enumerate(pieces) if p and not white.intersection(p[1:]) and p[0] not in white - set(WORD_START)]
        self.ids = np.array(usable, np.int64)
        self.longest = max(len(pieces[k]) for k in usable)
        self.values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self._byte = self.values.tolist()
        keys = np.array([self._state(pieces[k]) for k in usable], np.uint64)
        self.keys = np.append(keys, np.uint64(0))
        # Two tables with slots of their own; what collides in the first lies in the second.
        at = np.arange(len(keys))
        self.first, self.second = (np.full(1 << SLOT_BITS, len(keys), np.int32) for _ in range(2))
        self.first[self._slots(keys, FIRST_ODD)] = at
        lost = at[self.first[self._slots(keys, FIRST_ODD)] != at]
        self.second_odd = next(odd for odd in SECOND_ODDS if len(np.unique(self._slots(keys[lost], odd))) == len(lost))
        self.second[self._slots(keys[lost], self.second_odd)] = lost
        self.begins = np.zeros(1 << BEGIN_BITS, bool)
        begins = {pieces[k][:end] for k in usable for end in range(1, len(pieces[k]))}
        states = np.array([self._state(b) - self._length_share(len(b)) & (1 << 64) - 1 for b in begins], np.uint64)
        self.begins[self._slots(states, FIRST_ODD, BEGIN_BITS)] = True

    @staticmethod
    def _slots(states: np.ndarray, odd: np.uint64, bits: int = SLOT_BITS) -> np.ndarray:
        return ((states * odd) >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def _length_share(length: int) -> int:
        """A piece's state begins with its length: what that adds to the state of its bytes."""
        return length * pow(int(SPREAD), length, 1 << 64) & (1 << 64) - 1

    def _state(self, piece: bytes) -> int:
        state = len(piece)
        for byte in piece:
            state = state * int(SPREAD) + self._byte[byte] & (1 << 64) - 1
        return state

    def __len__(self) -> int:
        return len(self.ids)

    def hits(self, table: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of all pieces in the words of a table that begin at the first ``starts`` positions."""
        n, length = table.shape
        none = len(self)
        word, start = np.divmod(np.arange(n * starts, dtype=np.int64), starts)
        state = np.zeros(n * starts, np.uint64)
        out = [[], [], [], []]
        for size in range(1, self.longest + 1):
            if size > 1:
                go = self.begins[self._slots(state, FIRST_ODD, BEGIN_BITS)] & (start + size <= length)
                word, start, state = word[go], start[go], state[go]
            if not len(word):
                break
            state = state * SPREAD + self.values[table[word, start + size - 1]]
            own = state + np.uint64(self._length_share(size))
            index = self.first[self._slots(own, FIRST_ODD)]
            other = self.second[self._slots(own, self.second_odd)]
            index = np.where(self.keys[index] == own, index, np.where(self.keys[other] == own, other, none))
            hit = np.flatnonzero(index != none)
            for column, values in zip(out, (word[hit], start[hit], start[hit] + size, index[hit]), strict=True):
                column.append(values)
        return tuple(np.concatenate(column) if column else np.zeros(0, np.int64) for column in out)

    def arcs(self, table: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For each start and end the index of the piece of every word there; len(self) where there is none."""
        n, length = table.shape
        word, start, end, piece = self.hits(table, length)
        code = start * (length + 1) + end
        order = np.argsort(code, kind="stable")
        word, piece, code = word[order], piece[order], code[order]
        codes, first = np.unique(code, return_index=True)
        found = {}
        for c, lo, hi in zip(codes.tolist(), first.tolist(), [*first[1:].tolist(), len(code)], strict=True):
            dense = np.full(n, len(self), np.int64)
            dense[word[lo:hi]] = piece[lo:hi]
            found[divmod(c, length + 1)] = dense
        return found

    def runs(self, word: bytes, backwards: bool = False) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        """Run by run of a long word's positions: the ends and pieces from each start that has any, in order of the starts."""
        data = np.frombuffer(WORD_START + word, np.uint8)
        bases = range(0, len(data), RUN_BYTES)
        for base in reversed(bases) if backwards else bases:
            part = data[base : base + RUN_BYTES + self.longest - 1][None]
            _, start, end, piece = self.hits(part, min(RUN_BYTES, len(data) - base))
            order = np.argsort(start, kind="stable")
            end, piece = end[order] + base, piece[order]
            starts, first = np.unique(start[order], return_index=True)
            bounds = [*first.tolist(), len(end)]
            yield [(int(s) + base, end[lo:hi], piece[lo:hi]) for s, lo, hi in zip(starts, bounds, bounds[1:], strict=False)]

    def long_forward(self, word: bytes, scores: np.ndarray) -> np.ndarray:
        """As forward, for one long word: log probabilities by position and column of ``scores``."""
        out = np.full((len(word) + len(WORD_START) + 1, *scores.shape[1:]), -np.inf)
        out[0] = 0
        for run in self.runs(word):
            for start, ends, pieces in run:
                out[ends] = np.logaddexp(out[ends], out[start] + scores[pieces])
        return out

    def long_uses(self, word: bytes, scores: np.ndarray) -> np.ndarray:
        """How often each piece is used over all segmentations of one long word."""
        ahead = self.long_forward(word, scores)
        uses, behind = np.zeros(len(self)), np.full(len(ahead), -np.inf)
        behind[-1] = 0
        if np.isfinite(ahead[-1]):
            for run in self.runs(word, backwards=True):
                for start, ends, pieces in reversed(run):
                    ways = scores[pieces] + behind[ends]
                    behind[start] = np.logaddexp.reduce(ways)
                    np.add.at(uses, pieces, np.exp(ahead[start] + ways - ahead[-1]))
        return uses

    def tables(self, words: list[bytes]):
        """(positions in ``words``, table of bytes) for words of one length each; long words are left out."""
        lengths = np.array([len(w) for w in words], np.int64) + len(WORD_START)
        for length in np.unique(lengths[lengths <= LONG_BYTES]):
            at = np.flatnonzero(lengths == length)
            step = max(1, min(TABLE_WORDS, TABLE_BYTES // int(length)))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                yield part, np.frombuffer(b"".join(WORD_START + words[i] for i in part), np.uint8).reshape(len(part), -1)

    @staticmethod
    def _logsum(terms: list[np.ndarray]) -> np.ndarray | float:
        if not terms:
            return -np.inf
        terms = np.array(terms)
        top = terms.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0)
        terms -= safe
        np.exp(terms, out=terms)
        with np.errstate(divide="ignore"):
            return safe + np.log(terms.sum(axis=0))

    def forward(self, arcs: dict, scores: np.ndarray, n: int, length: int) -> np.ndarray:
        """Log probability of all segmentations up to each position, per word and column of ``scores``."""
        into: dict[int, list] = {}
        for (start, end), index in arcs.items():
            into.setdefault(end, []).append((start, index))
        shape = (n, *scores.shape[1:])
        out = np.full((length + 1, *shape), -np.inf, scores.dtype)
        out[0] = 0
        for end in range(1, length + 1):
            out[end] = self._logsum([out[start] + scores[index] for start, index in into.get(end, [])])
        return out

    def backward(self, arcs: dict, scores: np.ndarray, n: int, length: int) -> np.ndarray:
        out_of: dict[int, list] = {}
        for (start, end), index in arcs.items():
            out_of.setdefault(start, []).append((end, index))
        out = np.full((length + 1, n), -np.inf, scores.dtype)
        out[length] = 0
        for start in range(length - 1, -1, -1):
            out[start] = self._logsum([out[end] + scores[index] for end, index in out_of.get(start, [])])
        return out

    def log_probability(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Natural logarithm of the marginal probability of each word, per column of ``scores`` (pieces x columns)."""
        scores = np.concatenate([scores, np.full((1, *scores.shape[1:]), -np.inf)])
        out = np.empty((len(words), *scores.shape[1:]))
        for at, table in self.tables(words):
            n, length = table.shape
            out[at] = self.forward(self.arcs(table), scores, n, length)[length]
        for k in self.long_words(words):
            out[k] = self.long_forward(words[k], scores)[-1]
        return out

    @staticmethod
    def long_words(words: list[bytes]) -> list[int]:
        return [k for k, w in enumerate(words) if len(w) + len(WORD_START) > LONG_BYTES]

    def expected_counts(self, words: list[bytes], weights: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How often each piece is used over all segmentations of the words, per column of ``weights`` (words x columns)."""
        double = np.append(scores, -np.inf)
        single = double.astype(np.float32)
        total = np.zeros((weights.shape[1], len(self)))
        for at, table in self.tables(words):
            n, length = table.shape
            # Single precision is enough for the shares within a word, unless its logarithm is large.
            scores = single if length <= 64 else double
            arcs = self.arcs(table)
            ahead, behind = self.forward(arcs, scores, n, length), self.backward(arcs, scores, n, length)
            whole = ahead[length]
            sound = np.isfinite(whole)
            used, share, word = [], [], []
            for (start, end), index in arcs.items():
                hit = np.flatnonzero((index < len(self)) & sound & np.isfinite(ahead[start]) & np.isfinite(behind[end]))
                used.append(index[hit])
                share.append(np.exp(ahead[start][hit] + scores[index[hit]] + behind[end][hit] - whole[hit]))
                word.append(at[hit])
            if used:
                used, share, word = np.concatenate(used), np.concatenate(share), np.concatenate(word)
                for column, own in zip(total, weights.T, strict=True):
                    column += np.bincount(used, share * own[word], len(column))
        for k in self.long_words(words):
            total += weights[k][:, None] * self.long_uses(words[k], double)
        return total.T


@lru_cache(maxsize=2)
def lattice_of(pieces: tuple[bytes, ...]) -> Lattice:
    """One lattice per Python worker."""
    return Lattice(pieces)

"""FM-index over word sequences: backward search by wavelet-matrix ranks, sampled positions.

A shard holds the words of many texts as one sequence of symbols, a separator after each
text. At most ``CAPACITY`` symbols fit, so that two ranks and a position pack into 64 bits
and suffixes sort as plain integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BITS = 20
CAPACITY = (1 << _BITS) - 1
#: Every such word of a text has its position stored; the others walk there.
SAMPLE = 16


def _symbols(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and each hash's place among them."""
    n = len(hashes)
    low = np.uint64((1 << _BITS) - 1)
    packed = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    values = hashes[order]
    new = np.ones(n, bool)
    new[1:] = values[1:] != values[:-1]
    vocabulary = values[new]
    if (vocabulary[1:] <= vocabulary[:-1]).any():  # two words agree in all the high bits
        return np.unique(hashes, return_inverse=True)
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return vocabulary, place


def suffix_array(first: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only tied suffixes are sorted again.

    ``first`` holds dense ranks below ``CAPACITY``; the separators' are all different.
    """
    n = len(first)
    index = np.arange(n, dtype=np.uint64)
    low = np.uint64((1 << _BITS) - 1)

    def ordered(ids: np.ndarray, rank: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        ahead = np.minimum(ids + step, n - 1)
        keys = (rank[ids].astype(np.uint64) << np.uint64(_BITS)) | rank[ahead].astype(np.uint64)
        packed = np.sort((keys << np.uint64(_BITS)) | index[ids])
        new = np.ones(len(ids), bool)
        new[1:] = (packed[1:] >> np.uint64(_BITS)) != (packed[:-1] >> np.uint64(_BITS))
        return (packed & low).astype(np.int64), new

    sa, new = ordered(np.arange(n), first, 1)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.arange(n)
    step = 2
    while True:
        last = np.append(new[1:], True)
        tied = ~(new & last)
        if not tied.any():
            return sa
        slots = slots[tied]
        ids, new = ordered(sa[slots], rank, step)
        sa[slots] = ids
        rank[ids] = np.maximum.accumulate(np.where(new, slots, 0))
        step *= 2


def _directory(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits as 64-bit words, and the number of set bits before each word."""
    room = np.zeros((len(bits) // 64 + 1) * 64, bool)
    room[: len(bits)] = bits
    words = np.packbits(room, bitorder="little").view(np.uint64)
    before = np.zeros(len(words), np.int32)
    np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
    return words, before


def _rank(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    at = i >> 6
    mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
    return before[at] + np.bitwise_count(words[at] & mask)


@dataclass
class Index:
    n: int
    vocabulary: np.ndarray  # sorted hashes; symbol = place + 1, 0 separates
    counts: np.ndarray  # of symbols
    words: list[np.ndarray]  # wavelet matrix, highest bit first
    before: list[np.ndarray]
    zeros: np.ndarray
    marks: tuple[np.ndarray, np.ndarray]  # rows with a stored position
    positions: np.ndarray

    # ---- construction and storage

    @classmethod
    def build(cls, hashes: list[np.ndarray]) -> Index:
        """Index texts, each given as its words' hashes."""
        lengths = np.array([len(h) for h in hashes], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        word = np.ones(n, bool)
        word[ends] = False
        every = np.concatenate(hashes)
        vocabulary, place = _symbols(every) if len(every) else (every, every.astype(np.int64))
        text = np.zeros(n, np.int64)
        text[word] = place + 1
        first = text + len(hashes) - 1
        first[ends] = np.arange(len(hashes))
        sa = suffix_array(first)
        counts = np.bincount(text, minlength=len(vocabulary) + 1)
        level = text[sa - 1].astype(np.uint32)  # the symbol before each suffix; row of position 0 wraps to a separator
        words, before, zeros = [], [], []
        for bit in range(int(len(vocabulary)).bit_length() - 1, -1, -1):
            ones = (level >> np.uint32(bit)) & np.uint32(1) == 1
            w, b = _directory(ones)
            words.append(w)
            before.append(b)
            zeros.append(n - int(ones.sum()))
            level = np.concatenate([level[~ones], level[ones]])
        begin = np.repeat(ends - lengths, lengths + 1)
        sampled = ((np.arange(n) - begin) % SAMPLE == 0)[sa]
        return cls(n, vocabulary, counts, words, before, np.array(zeros, np.int64), _directory(sampled), sa[sampled].astype(np.int32))

    def to_bytes(self) -> list[bytes]:
        flat = lambda arrays: np.concatenate(arrays).tobytes() if arrays else b""
        return [
            np.int64(self.n).tobytes(), self.vocabulary.tobytes(), self.counts.astype(np.int32).tobytes(), flat(self.words),
            flat(self.before), self.zeros.tobytes(), self.marks[0].tobytes(), self.marks[1].tobytes(), self.positions.tobytes(),
        ]

    @classmethod
    def from_bytes(cls, parts: list[bytes]) -> Index:
        kinds = [np.int64, np.uint64, np.int32, np.uint64, np.int32, np.int64, np.uint64, np.int32, np.int32]
        n, vocabulary, counts, words, before, zeros, marks, marked, positions = (
            np.frombuffer(p, k) for p, k in zip(parts, kinds, strict=True)
        )
        width = int(n[0]) // 64 + 1
        rows = lambda a: [a[k * width : (k + 1) * width] for k in range(len(zeros))]
        return cls(int(n[0]), vocabulary, counts.astype(np.int64), rows(words), rows(before), zeros, (marks, marked), positions)

    # ---- search

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where a symbol's occurrences before row ``i`` end in the lowest level."""
        for k, bit in enumerate(range(len(self.zeros) - 1, -1, -1)):
            ones = _rank(self.words[k], self.before[k], i)
            i = np.where((symbols >> bit) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``lo`` to ``hi`` whose suffixes begin with each pattern (hashes, first ``lengths`` of a row)."""
        m = len(lengths)
        lo, hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        if not len(self.vocabulary) or not m:
            return lo, hi
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        place = np.minimum(np.searchsorted(self.vocabulary, patterns), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[place] == patterns, place + 1, 0)
        inside = np.arange(patterns.shape[1])[None, :] < lengths[:, None]
        alive = np.flatnonzero(((symbols > 0) | ~inside).all(axis=1) & (lengths > 0))
        c = symbols[alive, lengths[alive] - 1]
        lo[alive], hi[alive] = starts[c], starts[c + 1]
        for back in range(2, patterns.shape[1] + 1):
            alive = alive[(lengths[alive] >= back) & (hi[alive] > lo[alive])]
            if not len(alive):
                break
            c = symbols[alive, lengths[alive] - back]
            base = self._down(c, np.zeros(len(c), np.int64))
            lo[alive] = starts[c] + self._down(c, lo[alive]) - base
            hi[alive] = starts[c] + self._down(c, hi[alive]) - base
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a stored one and count the steps."""
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        out, steps = np.zeros(len(rows), np.int64), 0
        open_, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_):
            stored = (self.marks[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[open_[stored]] = self.positions[_rank(*self.marks, at[stored])] + steps
            open_, at = open_[~stored], at[~stored]
            if not len(open_):
                break
            c, i = np.zeros(len(at), np.int64), at
            for k in range(len(self.zeros)):
                bit = ((self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
                ones = _rank(self.words[k], self.before[k], i)
                c = (c << 1) | bit
                i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
            at = starts[c] + i - self._down(c, np.zeros(len(c), np.int64))
            steps += 1
        return out

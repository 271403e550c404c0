"""Words and word hashes of Arrow text columns, as numpy arrays over the UTF-8 bytes.

A batch is worked on in slices of about ``SLICE_BYTES``, so what a task holds follows
its longest text, not the number of its rows. Hashes of words are 64 bits wide and
depend on the bytes alone.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 21
#: Rows that Spark hands to a Python worker at once, unless the session says otherwise: what the
#: JVM and the worker hold of a table is this many texts, not Spark's usual 10 000.
BATCH_ROWS = 1000
_BLOCK = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def release() -> None:
    """Give freed memory back to the system: workers live on between stages, and others of the executor need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freeing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, with :func:`release` when a task's rows are through."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def byte_set(outside: bool, *ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of bytes in (or outside) the ranges."""
    table = np.full(256, outside)
    for lo, hi in ranges:
        table[lo : hi + 1] = not outside
    return table


#: Bytes of `[^\x20\x09-\x0D]+` words.
SPACED = byte_set(True, (0x20, 0x20), (0x09, 0x0D))
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words, after lower-casing.
ALNUM = byte_set(True, (0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ODD, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.concatenate([[np.uint64(1)], np.full(_BLOCK, np.uint64(_ODD))]).cumprod(dtype=np.uint64)
        down = np.concatenate([[np.uint64(1)], np.full(_BLOCK, np.uint64(inverse))]).cumprod(dtype=np.uint64)
    return up, down


_UP, _DOWN = _powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


@dataclass
class Slice:
    """Rows ``first`` to ``last`` of a batch; ``offsets`` are their bounds in ``data``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, size: int | None = None) -> Iterator[Slice]:
    """Cut a string column into runs of rows of about ``size`` bytes (``SLICE_BYTES``); nulls are empty."""
    size = size or SLICE_BYTES
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(bounds, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        end = min(end, n)
        yield Slice(at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each text's bounds in that list of words."""
    inside = table[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word."""
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    while at < n:
        base = starts[at]
        end = int(np.searchsorted(ends, base + _BLOCK, side="right"))
        if end <= at:  # one word longer than a block
            digest = hashlib.blake2b(data[base : ends[at]].tobytes(), digest_size=8).digest()
            out[at] = int.from_bytes(digest, "little")
            at += 1
            continue
        part = _VALUES[data[base : ends[end - 1]]] * _UP[: ends[end - 1] - base]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[at:end] - base, ends[at:end] - base
        out[at:end] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = end
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * np.uint64((_ODD * (2 * k + 3) ** 5 | 1) & _MASK)
    return mix(total)


def string_hash(word: str) -> int:
    """``word_hashes`` of one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column has them."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches set to ``BATCH_ROWS`` where they are unset."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df

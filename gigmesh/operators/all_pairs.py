"""All pairs of distinct strings within a ratio, for strings whose rare marks don't tell them apart.

Strings are dealt out to ``G`` groups by their hash, and every pair of groups is a tile that one task works on, with the
names of two groups in memory. Inside a tile, blocks of strings are compared at once: the bit-parallel longest common
subsequence of :func:`gigmesh.functions.fuzzy.lcs_of`, with a word per pair. The work is that of all pairs, the memory a tile's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmesh.functions import fuzzy

#: Strings of a group (on average), most tasks, characters of a word, and strings on either side of a block.
GROUP, TASKS, WORD = 8192, 2048, 64
LEFT, RIGHT = 1024, 256
#: Numbers in a block's table of characters.
TABLE = 1 << 22


def codes(strings: list[str]) -> np.ndarray:
    """Code points by string and place, -1 behind the end."""
    length = np.array([len(s) for s in strings])
    out = np.full((len(strings), length.max(initial=0)), -1, np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def common(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences, a row for each of ``right``; strings of ``left`` have at most ``WORD`` characters."""
    a, b = codes(left), codes(right)
    letters = np.unique(a[a >= 0])
    kind = next(t for t, bits in ((np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if a.shape[1] <= bits)
    masks = np.zeros((len(letters) + 1, len(left)), kind)  # the last row is of characters that ``left`` has not
    for j in range(a.shape[1]):
        own = np.flatnonzero(a[:, j] >= 0)
        masks[np.searchsorted(letters, a[own, j]), own] |= kind(1 << j)
    spot = np.minimum(np.searchsorted(letters, b), max(len(letters) - 1, 0))
    rows = np.where(letters[spot] == b, spot, len(letters)) if len(letters) else np.full(b.shape, 0)
    full = np.bitwise_or.reduce(masks, axis=0)
    row = np.repeat(full[None], len(right), 0)
    hit, total = np.empty_like(row), np.empty_like(row)
    for j in range(b.shape[1]):
        np.take(masks, rows[:, j], axis=0, out=hit, mode="clip")
        hit &= row
        np.add(row, hit, out=total)  # a carry beyond the string's end meets no mask again
        row -= hit
        row |= total
    row &= full
    return np.bitwise_count(full).astype(np.int32) - np.bitwise_count(row)


def near(left: list[str], right: list[str], percent: int, strict: bool, same: bool) -> Iterator[tuple[list[str], list[str]]]:
    """Pairs within the ratio, block by block; ``same`` says that both lists are one, of which each pair is wanted once."""
    left, right = sorted(left, key=len), sorted(right, key=len)
    reaches = (lambda lcs, total: 200 * lcs > percent * total) if strict else (lambda lcs, total: 200 * lcs >= percent * total)
    i = 0
    while i < len(left):
        block = left[i : i + LEFT]
        block = block[: max(1, TABLE // max(1, len(set("".join(block)))))]
        start = 0 if not same else i
        if len(block[-1]) > WORD:  # long strings one by one
            block = block[:1]
            own = block[0]
            for at, other in enumerate(right[start:], start):
                fits = reaches(min(len(own), len(other)), len(own) + len(other))
                if fits and not (same and at <= i) and reaches(fuzzy.lcs_of(own, other), len(own) + len(other)):
                    yield [own], [other]
            i += 1
            continue
        la = np.array([len(s) for s in block], np.int32)
        for at in range(start, len(right), RIGHT):
            others = right[at : at + RIGHT]
            if not reaches(min(la[-1], len(others[-1])), 2 * min(la[-1], len(others[-1]))) or not (
                reaches(la[-1], la[-1] + max(la[-1], len(others[0]))) and reaches(len(others[-1]), len(others[-1]) + max(la[0], len(others[-1])))
            ):
                continue
            lb = np.array([len(s) for s in others], np.int32)
            good = reaches(common(block, others), la[None] + lb[:, None])
            if same:
                good &= (np.arange(len(others)) + at)[:, None] > (np.arange(len(block)) + i)[None]
            y, x = np.nonzero(good)
            if len(x):
                yield [block[k] for k in x.tolist()], [others[k] for k in y.tolist()]
        i += len(block)


def all_pairs(names: DataFrame, count: int, percent: int, strict: bool) -> DataFrame:
    """``a < b`` of the ``count`` distinct strings ``s`` whose ratio reaches ``percent``, or is above it if ``strict``."""
    groups = max(1, -(-count // GROUP))
    own, other = F.pmod(F.xxhash64("s"), F.lit(groups)).cast("int"), F.sequence(F.lit(0), F.lit(groups - 1))
    dealt = names.select("s", own.alias("own"), F.explode(other).alias("other"))
    tiles = dealt.select("s", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    # Few bytes but much work: as many tasks as tiles, however small they are.
    spread = tiles.repartition(min(TASKS, groups * (groups + 1) // 2), "x", "y").sortWithinPartitions("x", "y")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(tile: tuple[int, int], sides: tuple[list, list]) -> Iterator[pa.RecordBatch]:
            same = tile[0] == tile[1]
            for xs, ys in near(sides[0], sides[0] if same else sides[1], percent, strict, same):
                ordered = [(x, y) if x < y else (y, x) for x, y in zip(xs, ys, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in ordered], pa.string()), pa.array([p[1] for p in ordered], pa.string())], names=["a", "b"])

        open_, sides = None, ([], [])
        for batch in batches:
            for s, own, x, y in zip(*(batch.column(c).to_pylist() for c in ("s", "own", "x", "y")), strict=True):
                if open_ != (x, y):
                    if open_ is not None:
                        yield from found(open_, sides)
                    open_, sides = (x, y), ([], [])
                sides[0 if own == x else 1].append(s)
        if open_ is not None:
            yield from found(open_, sides)

    return spread.mapInArrow(compared, "a string, b string")

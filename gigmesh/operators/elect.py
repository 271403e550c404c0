"""Leaders of all blocks in one sorted pass over their rows.

A block's rows come in order to one task; a row joins the first leader that it matches and leads itself
when it matches none. Only leaders are held: a block is a stream, however many rows it has, and no pair of rows is
ever formed, moved or stored. A row is compared with all leaders of its block at once: for each field, what a value
has in common with each leader is one byte, kept per value and continued as leaders are added.

:mod:`gigmesh.operators.resolve` states the same test on pairs of rows; tests compare the two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from gigmesh import fixed_values as fx
from gigmesh.functions import fuzzy

#: Fields that a row is compared by, in order, after its block's two and its number.
FIELDS = ["vkey", "vid", "head", "supports", "many", "time", "minutes", "adv", "door", "age"]
#: Bytes of kept comparisons, and rows whose leaders are kept for copies, in one block.
KEPT, COPIES = 1 << 26, 1 << 16
#: A check that was made, and one that agreed: bytes of all checks are added, so totals are in the low half.
MADE, AGREED = 1, 16

_CODES = np.arange(256)
_TOTAL, _HITS = _CODES % AGREED, _CODES // AGREED
#: By added checks: votes that suffice, and votes that lack one.
ENOUGH = (_TOTAL >= 3) & (_HITS >= _TOTAL // 2 + 1)
LACKS_ONE = (_TOTAL >= 3) & (_HITS + 1 == _TOTAL // 2 + 1)


@lru_cache(maxsize=1 << 17)
def close_names(a: str, b: str) -> bool:
    total = len(a) + len(b)
    return a == b or 200 * min(len(a), len(b)) >= fx.NAME_RATIO * total and 200 * fuzzy.lcs_of(a, b) >= fx.NAME_RATIO * total


@lru_cache(maxsize=1 << 17)
def same_head(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and (a == b or fuzzy._same_performer(a, b))


def same_place(a: tuple[str, str], b: tuple[str, str]) -> bool:
    return a[1] != "" and a[1] == b[1] or close_names(a[0], b[0])


def check(made: bool, same: bool) -> int:
    return (MADE + (AGREED if same else 0)) if made else 0


def check_time(a: tuple[str, int], b: tuple[str, int]) -> int:
    unread = a[1] < 0 or b[1] < 0
    near = a[0].lower() == b[0].lower() if unread else abs(a[1] - b[1]) <= fx.SAME_SHOW_MINUTES
    return check(a[0] != "" and b[0] != "", near)


def check_price(a, b) -> int:
    return check(a is not None or b is not None, a == b)


def check_age(a: str, b: str) -> int:
    return check(a != "" and b != "", a == b)


TESTS = {"place": same_place, "head": same_head, "time": check_time, "adv": check_price, "door": check_price, "age": check_age}


class Leaders:
    """The leaders of one block so far."""

    def __init__(self, block: tuple) -> None:
        self.block, self.seqs, self.supports, self.led = block, [], [], set()
        self.many = bytearray()
        self.values = {name: [] for name in TESTS}
        self.kept = {name: {} for name in TESTS}
        self.size, self.copies = 0, {}

    def compared(self, name: str, value) -> np.ndarray:
        """A byte for each leader: what ``value`` has in common with the leader's."""
        known = self.kept[name].get(value)
        if known is None:
            if self.size > KEPT:
                self.kept, self.size = {n: {} for n in TESTS}, 0
            known = self.kept[name][value] = bytearray()
        if len(known) < len(self.seqs):
            test, others = TESTS[name], self.values[name][len(known) :]
            known.extend([test(other, value) for other in others])
            self.size += len(others)
        return np.frombuffer(bytes(known), np.uint8)

    def first_match(self, row: dict, supports, many: bool) -> int | None:
        """Number of the first leader that the row matches."""
        if not self.seqs:
            return None
        found = {name: self.compared(name, value) for name, value in row.items()}
        here, similar, time = found["place"] > 0, found["head"] > 0, found["time"]
        votes = time + found["adv"] + found["door"] + found["age"]
        if many:
            votes = votes + np.frombuffer(bytes(self.many), np.uint8)
        sure = here & np.where(similar, time != MADE, ENOUGH[votes])
        first = int(sure.argmax())
        best = first if sure[first] else None
        if many:
            # What supporting acts decide is only asked of leaders before that one.
            open_ = here & ~similar & LACKS_ONE[votes] & (np.frombuffer(bytes(self.many), np.uint8) > 0)
            for k in np.flatnonzero(open_[:best]):
                if any(close_names(x, y) for x in self.supports[k] for y in supports):
                    return int(k)
        return best

    def place(self, seq: int, fields: tuple) -> int | None:
        """The leader that the row joins; None if it leads itself."""
        vkey, vid, head, supports, many, time, minutes, adv, door, age = fields
        whole = (vkey, vid, head, tuple(supports), many, time, minutes, adv, door, age)
        # Copies without a performer need not match each other.
        at = self.copies.get(whole) if head is not None else None
        if at is None:
            row = {"place": (vkey, vid), "head": head, "time": (time, minutes), "adv": adv, "door": door, "age": age}
            at = self.first_match(row, supports, many)
            leads = at is None
            if leads:
                at = len(self.seqs)
                self.seqs.append(seq)
                self.supports.append(supports)
                self.many.append(many)
                for name, value in row.items():
                    self.values[name].append(value)
            if len(self.copies) >= COPIES:
                self.copies.clear()
            # A copy's first match is the row's own leader, or the row if it leads.
            self.copies[whole] = at
            if leads:
                return None
        self.led.add(at)
        return self.seqs[at]


def with_leaders(batches: Iterator[pa.RecordBatch], columns: list[str], block: list[str], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """``columns`` and ``leader`` of rows sorted by ``block`` and ``seq``; rows without any match have none.

    Rows of a block that goes on in the next batch are given out at once, but for its leaders.
    """
    open_, held = None, []

    def out(rows: pa.RecordBatch, leader: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(leader, pa.int64())], names=[*columns, "leader"])

    def given(leaders: Leaders) -> Iterator[pa.RecordBatch]:
        for rows, numbers in held:
            yield out(rows, [leaders.seqs[k] if k in leaders.led else None for k in numbers])
        held.clear()

    for batch in batches:
        leader, own = [None] * batch.num_rows, []
        read = [batch.column(c).to_pylist() for c in (*block, "seq", *fields)]
        for i, row in enumerate(zip(*read, strict=True)):
            key, seq = row[: len(block)], row[len(block)]
            if open_ is None or open_.block != key:
                if open_ is not None:
                    yield from given(open_)
                    for j, k in own:
                        leader[j] = open_.seqs[k] if k in open_.led else None
                open_, own = Leaders(key), []
            leader[i] = open_.place(seq, row[len(block) + 1 :])
            if leader[i] is None:
                own.append((i, len(open_.seqs) - 1))
        if own:
            waits = np.zeros(batch.num_rows, bool)
            waits[[i for i, _ in own]] = True
            held.append((batch.filter(pa.array(waits)), [k for _, k in own]))
            yield out(batch.filter(pa.array(~waits)), [x for x, w in zip(leader, waits, strict=True) if not w])
        elif batch.num_rows:
            yield out(batch, leader)
    if open_ is not None:
        yield from given(open_)

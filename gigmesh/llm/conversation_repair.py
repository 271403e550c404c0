"""Repair of conversation structure at least cost, with the least audit trail.

A repaired conversation is empty or reads ``(s?(ua)+)?`` by the first letters of its roles. Each
row is kept (K, free), given another role (R, 1) or deleted (D, 2); an empty user or assistant row
may be inserted anywhere (I, 5). Blank and repeated rows must go; a truncated row that stays costs
5 more. Of the cheapest edits, those whose letters in order are least by ASCII are taken.

Method. Rows, in order, become blocks of at most ``ROWS`` rows and about ``BYTES`` bytes, so a conversation
of any length is spread over tasks. A node is a place between rows and what the grammar has read
(nothing, s, u, a). A block's least costs from each state to each state are a four by four table; the tables,
taken from the end of a conversation, give each block the costs behind it (the cost DP). Inside a
block the arcs that keep to least costs are ranked by prefix doubling: ranks of audits of one letter, then
of two, four, ..., each from two ranks of half the length, with pointers doubled alongside. From a
node each letter leads to one node only, so a least audit of any length has one end. The ranks pick
each node's arc, the doubled pointers list the path for each state in which a block may be entered, and a last
pass over the blocks in order follows the states, writes the audit and hashes the repaired rows.

Cases. Null roles and texts read as one space. Rows are ordered by turn (null first), then role and digest of
the text; equal rows are kept once with their count. Rows without ``conv_id`` form one conversation.
A role's first letter decides what it is; an unknown one cannot be kept, only given a role or
deleted. Repeated rows of a conversation are duplicates. An empty table gives no rows. Only
``conv_id, turn, role, text`` are read. Audit and digest are one value per conversation: the last pass
streams a conversation's blocks through one task, which holds one block and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmesh.llm.crcsql import crc32_sql
from gigmesh.runtime import cut_lineage

ROWS = 1024
BYTES = 1 << 20
_SPACE = " \t\n\x0b\x0c\r"

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, S, U, A = range(4)
#: State after keeping a row whose role starts with neither, s, u, a; -1: not allowed.
KEEP = np.array([[-1, S, U, -1], [-1, -1, U, -1], [-1, -1, -1, A], [-1, -1, U, -1]])
#: State after a user or assistant row is inserted, or a row given that role.
SPEAK = np.array([U, U, A, U])
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
LETTERS = b"DIKR"
#: Costs behind the last row: what must be inserted to end well.
BEHIND = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_FAR = 1 << 40


# -- rows and blocks -------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Rows with the faults that a hash of conversation and turn deals out; ``times`` is 0 for a dropped row.

    A dropped row stays as an empty one without turn, so that its conversation is still known.
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(name, "utf-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("times"),
    ).select(
        "conv_id", *[F.when(F.col("times") > 0, F.col(c)).otherwise(F.lit(empty)).alias(c) for c, empty in (("turn", None), ("role", ""), ("text", ""))], "times"
    )


def _named(*parts: Column) -> Column:
    """Digest of the parts; null differs from every value."""
    return F.unhex(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``times``, order key ``said`` and ``code``: four times the fault, plus 0 to 3 for the role."""
    said = _named(F.length("role"), F.col("role"), F.col("text"))
    named = rows.withColumn("said", said).withColumn("place", _named(F.col("conv_id"), F.col("turn"), F.hex("said")))
    one = named.groupBy("place").agg(*[F.any_value(c).alias(c) for c in ("conv_id", "turn", "role", "text", "said")], F.sum("times").alias("times"))
    # The place of the first row that says the same; the join on places has no frequent key.
    first = named.where("times > 0").groupBy("conv_id", "said").agg(F.min(F.struct("turn", "place"))["place"].alias("place"))
    marked = one.join(first.select("place", F.lit(True).alias("first")), "place", "left")
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(bare == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    return marked.select("conv_id", "turn", "role", "said", "text", "times", (fault * 4 + role).cast("tinyint").alias("code"))


def blocks(rows: DataFrame) -> DataFrame:
    """Runs of a conversation's rows as arrays; ``block`` numbers follow the order of rows."""
    order = ["conv_id", "turn", "role", "said"]
    ordered = judged(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("said")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id")
            ids, gone = np.asarray(conv.fill_null(0)), np.asarray(conv.is_null())
            fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (gone[1:] != gone[:-1])])
            size = np.cumsum(np.asarray(pa.compute.binary_length(batch.column("text")))) // BYTES
            since = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            fresh |= (since % ROWS == 0) | np.concatenate([[True], size[1:] != size[:-1]])
            starts = np.flatnonzero(fresh)
            offsets = pa.array(np.append(starts, n).astype(np.int32))
            listed = {c: pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("turn", "role", "text", "times", "code")}
            numbers = pa.array(block + np.arange(len(starts)))
            block += len(starts)
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(starts)), numbers, *listed.values()], names=["conv_id", "block", *listed])

    return ordered.mapInArrow(
        cut, "conv_id bigint, block bigint, turn array<bigint>, role array<string>, text array<string>, times array<bigint>, code array<tinyint>"
    )


# -- least costs ---------------------------------------------------------------------


class Steps:
    """Rows of several blocks as steps: one per row, and one for its copies, which can only be deleted."""

    def __init__(self, codes: np.ndarray, times: np.ndarray, bounds: np.ndarray) -> None:
        fault = codes >> 2
        must = (fault == BLANK) | (fault == DUPLICATE)
        more = ~must & (times > 1)
        width = 1 + more
        at = np.cumsum(width) - width
        n = int(width.sum())
        self.gone = np.zeros(n, bool)
        self.count = np.ones(n, np.int64)
        self.role = np.zeros(n, np.int64)
        self.extra = np.zeros(n, np.int64)
        self.gone[at], self.role[at] = must, codes & 3
        self.extra[at] = np.where(fault == TRUNCATED, CUT_OFF, 0)
        self.count[at[must]] = times[must]
        copies = at[more] + 1
        self.gone[copies], self.count[copies] = True, times[more] - 1
        ends = np.append(at, n)[bounds]
        self.first, self.size = ends[:-1], np.diff(ends)

    def least(self, behind: np.ndarray) -> list[np.ndarray]:
        """Least cost from each state before each step to the end: one (blocks, 4, x) array per place.

        ``behind`` are the costs at the end. A place holds the blocks that reach it, longest first (``order``).
        """
        self.order = np.argsort(-self.size, kind="stable")
        size, first = self.size[self.order], self.first[self.order]
        now, out = behind[self.order].copy(), []
        places = int(size[0]) if len(size) else 0
        for i in range(places - 1, -1, -1):
            m = int(np.searchsorted(-size, -i, side="left"))  # blocks with more than i steps
            s = first[:m] + i
            ahead = now[:m]
            kept = np.where(KEEP[:, self.role[s]].T[..., None] >= 0, ahead[np.arange(m)[:, None], KEEP[:, self.role[s]].T], _FAR)
            spoken = ahead[:, SPEAK] + RETYPE
            stay = np.minimum(kept, spoken) + self.extra[s][:, None, None]
            here = np.where(self.gone[s][:, None, None], _FAR, stay)
            here = np.minimum(here, ahead + (DELETE * self.count[s])[:, None, None])
            u = np.minimum(here[:, U], INSERT + here[:, A])
            a = np.minimum(here[:, A], INSERT + here[:, U])
            here = np.minimum(np.stack([here[:, START], here[:, S], u, a], 1), np.stack([INSERT + u, INSERT + u, u, a], 1))
            now[:m] = here
            out.append(here.copy())
        self.start = np.empty_like(now)
        self.start[self.order] = now
        return out[::-1]

    def tables(self) -> np.ndarray:
        """(blocks, 4, 4): least cost from a state at the start to a state at the end."""
        units = np.full((len(self.size), 4, 4), _FAR, np.int64)
        units[:, range(4), range(4)] = 0
        self.least(units)
        return np.minimum(self.start, _FAR)

    def audits(self, behind: np.ndarray, last: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
        """For each block and state of entry: letters of the least audit, step by step, and the state at the end."""
        n_blocks = len(self.size)
        base = 4 * (np.cumsum(self.size + 1) - self.size - 1)  # first node of each block
        n = 4 * int((self.size + 1).sum())
        cost = np.empty(n, np.int64)
        states = np.arange(4)
        ends = base + 4 * self.size
        cost[ends[:, None] + states] = behind
        for i, here in enumerate(self.least(behind[..., None])):
            cost[(base[self.order[: len(here)]] + 4 * i)[:, None] + states] = here[..., 0]
        block = np.repeat(np.arange(n_blocks), self.size)
        node = (base[block] + 4 * (np.arange(len(block)) - self.first[block]))[:, None] + states  # of each step and state
        price, target = np.full((n, 4), _FAR, np.int64), np.tile(np.arange(n)[:, None], (1, 4))
        stays = ~self.gone[:, None]
        keep = KEEP[:, self.role].T
        after = node[:, :1] + 4
        for letter, allowed, paid, to in (
            (0, True, (DELETE * self.count)[:, None], node + 4),
            (1, True, INSERT, node[:, :1] + SPEAK),
            (2, stays & (keep >= 0), self.extra[:, None], after + keep),
            (3, stays, RETYPE + self.extra[:, None], after + SPEAK),
        ):
            price[node, letter] = np.where(allowed, paid, _FAR)
            target[node, letter] = np.where(allowed, to, node)
        tail = ends[last][:, None] + np.array([S, U])  # what is missing at the end is inserted
        price[tail, 1], target[tail, 1] = INSERT, ends[last][:, None] + SPEAK[[S, U]]
        optimal = (price < _FAR) & (price + cost[target] == cost[:, None])
        letter, pointers = ranked(optimal, target)
        entries = (base[:, None] + states).ravel()
        path, owner, step = entries[letter[entries] >= 0], np.flatnonzero(letter[entries] >= 0), np.zeros(int((letter[entries] >= 0).sum()), np.int64)
        for k, pointer in enumerate(pointers):
            then = pointer[path]
            on = letter[then] >= 0
            path, owner, step = np.concatenate([path, then[on]]), np.concatenate([owner, owner[on]]), np.concatenate([step, step[on] + (1 << k)])
        line = np.lexsort((step, owner))
        written = np.frombuffer(LETTERS, np.uint8)[letter[path[line]]].tobytes().decode()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(entries)))]).tolist()
        said = [written[i:j] for i, j in zip(cuts, cuts[1:])]
        left = (pointers[-1][entries] if pointers else entries).reshape(-1, 4) - ends[:, None]
        return [said[k : k + 4] for k in range(0, len(said), 4)], left


def ranked(arcs: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least paths by prefix doubling.

    ``arcs[v, l]`` tells whether letter ``l`` leads from node ``v`` to ``target[v, l]``. Returns each
    node's letter (-1 at an end) and its pointers 1, 2, 4, ... letters on.
    """
    ends = ~arcs.any(1)
    nodes, letters = np.nonzero(arcs)
    ahead = target[nodes, letters]
    rank = letters + 1
    chosen, pointers = np.zeros(len(arcs), np.int64), []
    best, pointer = np.zeros(len(arcs), np.int64), np.arange(len(arcs))
    while True:
        # Arcs of a node by rank, so that the last one written is the least.
        order = np.lexsort((-rank, nodes))
        chosen[nodes[order]], best[nodes[order]] = letters[order], rank[order]
        pointer[nodes[order]] = ahead[order]
        pointers.append(pointer.copy())
        if ends[pointer].all():
            break
        pair = rank * (int(rank.max(initial=0)) + 1) + best[ahead]
        rank = np.unique(pair, return_inverse=True)[1] + 1
        ahead = pointer[ahead]
    return np.where(ends, -1, chosen), pointers


def _flat(batch: pa.RecordBatch) -> Steps:
    code, times = batch.column("code"), batch.column("times")
    bounds = np.asarray(code.offsets)
    return Steps(np.asarray(code.flatten()).astype(np.int64), np.asarray(times.flatten()), bounds - bounds[0])


def costs_behind(cut: DataFrame) -> DataFrame:
    """``block, last, behind``: least costs from each state at the end of a block to the end of its conversation."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = _flat(batch).tables().reshape(-1)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 16, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), column], names=["conv_id", "block", "costs"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, table, behind, fresh = None, None, BEHIND, True
        for batch in batches:
            ids, costs = batch.column("conv_id").to_pylist(), np.asarray(batch.column("costs").flatten()).reshape(-1, 4, 4)
            last, found = np.zeros(len(ids), bool), np.empty((len(ids), 4), np.int64)
            for i, c in enumerate(ids):
                if fresh or c != conv:
                    conv, behind, fresh, last[i] = c, BEHIND, False, True
                else:
                    behind = (table + behind).min(1)
                found[i], table = behind, costs[i]
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(ids) + 1, 4, dtype=np.int32)), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(last), column], names=["block", "last", "behind"])

    priced = cut.select("conv_id", "block", "code", "times").mapInArrow(tables, "conv_id bigint, block bigint, costs array<bigint>")
    backwards = priced.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    return backwards.mapInArrow(back, "block bigint, last boolean, behind array<bigint>")


def audited(cut: DataFrame) -> DataFrame:
    """``conv_id, block, audits, ends``: for each state of entry, the letters of the block and the state at its end."""

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                behind = np.asarray(batch.column("behind").flatten()).reshape(-1, 4)
                audits, ends = _flat(batch).audits(behind, np.asarray(batch.column("last")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), batch.column("block"), pa.array(audits, pa.list_(pa.string())), pa.array(ends.tolist(), pa.list_(pa.int32()))],
                    names=["conv_id", "block", "audits", "ends"],
                )

    known = cut.select("conv_id", "block", "code", "times").join(costs_behind(cut), "block")
    return known.mapInArrow(letters, "conv_id bigint, block bigint, audits array<string>, ends array<int>")


# -- the repaired conversation ---------------------------------------------------------


class Repair:
    """One conversation, block after block."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.cost = [0, 0, 0, 0], 0, 0
        self.least = self.most = self.turn = self.before = None
        self.turns, self.state, self.audit, self.rows = 0, START, [], 0
        self.digest = hashlib.sha256()

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"\n{role}:{text}".encode() if self.rows else f"{role}:{text}".encode())
        self.rows += 1

    def speak(self) -> str:
        self.state = int(SPEAK[self.state])
        return "user" if self.state == U else "assistant"

    def insert(self, letters: str, at: int) -> int:
        while at < len(letters) and letters[at] == "I":
            self.write(self.speak(), "")
            self.audit.append("I")
            self.cost += INSERT
            at += 1
        return at

    def delete(self, times: int) -> None:
        self.audit.append("D" * times)
        self.cost += DELETE * times

    def look(self, turn: int | None, role: str, times: int) -> None:
        """What the damaged rows themselves tell."""
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turn = self.most = turn
            self.turns += 1
        initial = role[:1]
        pairs = [(self.before, 1)] if self.before is not None else []
        self.illegal += sum(n for first, n in [*pairs, (initial, times - 1)] if first + initial not in ("su", "ua", "au"))
        self.before = initial

    def add(self, row: dict, audits: list[str]) -> None:
        letters, at = audits[self.state], 0
        for turn, role, text, times, code in zip(row["turn"], row["role"], row["text"], row["times"], row["code"], strict=True):
            fault = code >> 2
            if times:
                self.look(turn, role, times)
            at = self.insert(letters, at)
            if fault in (BLANK, DUPLICATE):
                self.faults[fault] += times
                self.delete(times)
                at += 1
                continue
            self.faults[fault] += 1
            letter, at = letters[at], at + 1
            if letter == "D":
                self.delete(1)
            else:
                if letter == "K":
                    self.state = int(KEEP[self.state, code & 3])
                else:
                    role, self.cost = self.speak(), self.cost + RETYPE
                self.audit.append(letter)
                self.cost += CUT_OFF if fault == TRUNCATED else 0
                self.write(role, text)
            if times > 1:
                self.faults[DUPLICATE] += times - 1
                at = self.insert(letters, at)
                self.delete(times - 1)
                at += 1
        self.insert(letters, at)

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (``conv_id, turn, role, text, times``): its faults, the audit and digest of its repair."""
    cut = cut_lineage(blocks(rows))
    parts = ["turn", "role", "text", "times", "code"]
    told = audited(cut).select("conv_id", "block", F.lit(0).alias("kind"), "audits", "ends", *[F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in parts])
    held = cut.select(
        "conv_id", "block", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("audits"), F.lit(None).cast("array<int>").alias("ends"), *parts
    )
    both = told.unionByName(held).repartition("conv_id").sortWithinPartitions("conv_id", "block", "kind")
    names = [x.split()[0] for x in RESULT.split(", ")]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, one, audits, out = None, None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("conv_id", "kind")}
                if one is None or row["conv_id"] != conv:
                    if one is not None:
                        out.append((conv, *one.result()))
                    conv, one = row["conv_id"], Repair()
                if row["kind"] == 0:
                    audits = batch.column("audits")[i].as_py()
                else:
                    one.add({c: batch.column(c)[i].as_py() for c in parts}, audits)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)
                out = []
        if one is not None:
            out.append((conv, *one.result()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)

    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RESULT.split(", ")])
    return both.mapInArrow(follow, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _with(letter: str, paid: str, then: str) -> str:
    return f"{{'c': {then}.c + {paid}, 'a': '{letter}' || {then}.a}}"


def _edits(state: str, spoken: str, kept: dict[str, str]) -> str:
    keep = " ".join(f"WHEN initial = '{x}' THEN {_with('K', 'stay', 'b.' + to)}" for x, to in kept.items())
    return _least(
        _with("D", "2", f"b.{state}"), f"CASE WHEN must THEN NULL {keep} END", f"CASE WHEN NOT must THEN {_with('R', 'stay + 1', 'b.' + spoken)} END"
    )


#: Least (cost, audit) per state from the last row to the first, then the edits carried out letter by letter.
ORACLE = f"""WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE k WHEN 0 THEN CAST([] AS INT[]) WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || '|' || role || '|' || text), copy) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, role[1:1] AS initial FROM damaged),
faulty AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
rows_ AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stay FROM faulty),
counted AS (
  SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id),
back(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n + 1, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 10::BIGINT, 'a': 'II'}}, {{'c': 5::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}} FROM counted
  UNION ALL
  SELECT conv_id, i, {_least("r0", _with("I", "5", "u"))}, {_least("r1", _with("I", "5", "u"))}, u, a FROM (
    SELECT *, {_least("r2", _with("I", "5", "r3"))} AS u, {_least("r3", _with("I", "5", "r2"))} AS a FROM (
      SELECT b.conv_id, r.i, {_edits("s0", "s2", {"s": "s1", "u": "s2"})} AS r0, {_edits("s1", "s2", {"u": "s2"})} AS r1,
        {_edits("s2", "s3", {"a": "s3"})} AS r2, {_edits("s3", "s2", {"u": "s2"})} AS r3
      FROM back b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1))),
best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM back WHERE i = 1),
done(conv_id, p, i, q, said) AS (
  SELECT conv_id, 1, 1, 0, CAST([] AS VARCHAR[]) FROM best
  UNION ALL
  SELECT conv_id, p + 1, CASE WHEN l = 'I' THEN i ELSE i + 1 END,
    CASE WHEN l = 'D' THEN q WHEN l = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN q = 2 THEN 3 ELSE 2 END,
    CASE WHEN l = 'D' THEN said WHEN l = 'K' THEN list_append(said, role || ':' || text)
      ELSE list_append(said, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN l = 'R' THEN text ELSE '' END) END
  FROM (SELECT d.*, e.audit[d.p:d.p] AS l, r.role, r.text, r.initial FROM done d JOIN best e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
    LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i WHERE d.p <= length(e.audit))),
final AS (SELECT conv_id, arg_max(said, p) AS said FROM done GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

"""Prefix trie of conversations in double arrays, one per shard of sorted conversations.

A node is a distinct sequence of a conversation's first turns (role and text); its members are the
conversations that start with it. Per node: smallest member and depth, the parent's smallest member,
members, children, leaves below, tokens saved if shared prefixes are stored once, and a digest of
the members that end there.

Method. Texts stay where they are read: a turn becomes a 128-bit digest and its number of words.
Equal conversations become one path with a weight. Paths are cut into segments of ``SEGMENT`` turns;
a segment's root is the digest of all turns before it. The segments of one level are sorted over all
tasks and cut into shards of about ``SHARD`` turns. A shard gives its turns dense ids, packs the arrays BASE and CHECK
(from a node's slot, id ``c`` leads to slot ``BASE + c``, whose CHECK names the node) and sends all its
paths through them. Only nodes on a shard's first or last path can also be in other shards: these upper nodes'
counts are merged over all shards by digest, and sums move up their known ancestors; all others are final. Levels
are worked on from the deepest one in which two different conversations still share their root (usually
the first). Below that a conversation is alone, and its nodes follow from its words.

Cases. Null roles and texts are empty. Turns are ordered by number (null first), then by digest;
repeated rows are turns. Rows without ``conv_id`` belong to no conversation and are left out. A
conversation without turns is a member of the root. An empty table gives no rows. Only
``conv_id, turn, role, text`` are read. Turns are told apart by 128-bit digests. A conversation's turns, and the ids that end in one
node, pass in order through one task, which holds one segment, or one id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gigmesh.llm.crcsql import crc32_sql
from gigmesh.runtime import cut_lineage

SEGMENT = 256
SHARD = 1 << 16
#: Conversations that may share the first turns of one, and how many turns at most.
FAMILY, BORROWED = 20, 3
NO_ENDS = hashlib.sha256(b"").hexdigest()
TOP = hashlib.md5(b"").digest()
_NONE = 1 << 62


def longer(prefix: bytes, turn: bytes) -> bytes:
    return hashlib.md5(prefix + turn).digest()


# -- conversations as paths ------------------------------------------------------------


def turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, key, words`` of every row with a ``conv_id``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.md5(F.encode(F.concat_ws("|", F.length(role), role, text), "utf-8"))).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )


def rebuilt(rows: DataFrame) -> DataFrame:
    """Turns ``conv_id, part, turn, key, words, skip`` after each conversation borrows first turns from its family's first.

    Part 0 are borrowed turns, part 1 its own, of which the first ``skip`` give way.
    """
    own = turns(rows)
    share = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % (BORROWED + 1)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "key"))
    heads = own.where(F.col("conv_id") % FAMILY == 0).withColumn("place", place).where(F.col("place") <= BORROWED)
    wishes = own.select("conv_id").distinct().select(F.col("conv_id").alias("to"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("conv_id"))
    lent = heads.join(wishes, "conv_id").select(
        F.col("to").alias("conv_id"), F.lit(0).alias("part"), F.col("place").cast("bigint").alias("turn"), "key", "words"
    )
    both = lent.unionByName(own.withColumn("part", F.lit(1))).withColumn("skip", share)
    return both.where("part = 1 OR turn <= skip")


def segments(ordered: DataFrame) -> DataFrame:
    """Paths in segments: ``conv_id, level, root, keys, words, next, cum`` and, in the last one, ``last`` is true."""
    schema = "conv_id bigint, level int, root binary, keys array<binary>, words array<bigint>, next binary, cum bigint, last boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, skip, state = [], None, 0, None

        def flush(last: bool) -> None:
            out.append((conv, state["level"], state["root"], state["keys"], state["words"], state["at"], state["cum"], last))
            state.update(level=state["level"] + 1, root=state["at"], keys=[], words=[])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "key", "words", "skip")]
            for c, part, key, n, own_skip in zip(*columns, strict=True):
                if c != conv:
                    if conv is not None:
                        flush(True)
                    conv, skip, state = c, own_skip, {"level": 0, "root": TOP, "keys": [], "words": [], "at": TOP, "cum": 0}
                if part:
                    skip -= 1
                    if skip >= 0:
                        continue
                if len(state["keys"]) == SEGMENT:
                    flush(False)
                state["keys"].append(key)
                state["words"].append(n)
                state["at"] = longer(state["at"], key)
                state["cum"] += n
            if out:
                yield _batch(names, out, kinds)
                out = []
        if conv is not None:
            flush(True)
            yield _batch(names, out, kinds)

    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.bool_()]
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "key").mapInArrow(cut, schema)


def _batch(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)


def equal_paths(cut: DataFrame) -> DataFrame:
    """One row for each distinct path: its smallest ``conv_id``, ``weight``, total of words and the digest of its conversations."""
    schema = "conv_id bigint, weight bigint, total bigint, ends string"
    names, kinds = [c.split()[0] for c in schema.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state, out = None, None, []
        for batch in batches:
            for c, key, total in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "next", "cum")], strict=True):
                if key != path:
                    if state:
                        out.append((state[0], state[1], state[2], state[3].hexdigest()))
                    path, state = key, [c, 1, total, hashlib.sha256(str(c).encode())]
                else:
                    state[1] += 1
                    state[3].update(f",{c}".encode())
            if out:
                yield _batch(names, out, kinds)
                out = []
        if state:
            yield _batch(names, [(state[0], state[1], state[2], state[3].hexdigest())], kinds)

    finals = cut.where("last").select("next", "conv_id", "cum")
    return finals.repartition("next").sortWithinPartitions("next", "conv_id").mapInArrow(digest, schema)


# -- one shard --------------------------------------------------------------------------


class DoubleArray:
    """A trie packed into BASE and CHECK, from (parent, id) of its nodes, parents first; node 0 is the top, in slot 0."""

    def __init__(self, parent: np.ndarray, ids: np.ndarray) -> None:
        n = len(parent)
        self.slot = np.zeros(n, np.int64)
        base = np.zeros(n, np.int64)
        order = np.lexsort((ids, parent))[1:] if n else np.zeros(0, np.int64)  # the top comes first, with parent -1
        heads = np.flatnonzero(np.diff(parent[order], prepend=-2))
        sizes = np.diff(np.append(heads, len(order)))
        used = np.zeros(max(2 * n, 16), bool)
        used[0], low, size = True, 1, 1
        several = np.flatnonzero(sizes > 1)
        for g in several[np.argsort(-sizes[several], kind="stable")]:
            own = order[heads[g] : heads[g] + sizes[g]]
            steps = ids[own] - ids[own[0]]
            need = size + int(steps[-1]) + 1
            if need > len(used):
                used = np.concatenate([used, np.zeros(need, bool)])
            free = low + np.flatnonzero(~used[low : min(low + 1024, size)])
            spot = next((int(f) for f in free[:32] if not used[f + steps].any()), size)
            if not len(free) and low + 1024 < size:
                low += 1024
            used[spot + steps] = True
            self.slot[own] = spot + steps
            size = max(size, spot + int(steps[-1]) + 1)
            base[parent[own[0]]] = spot - ids[own[0]]
        alone = order[heads[sizes == 1]]
        gaps = np.flatnonzero(~used[:size])[: len(alone)]
        self.slot[alone] = np.concatenate([gaps, size + np.arange(len(alone) - len(gaps))])
        base[parent[alone]] = self.slot[alone] - ids[alone]
        width = int(self.slot.max(initial=0)) + 1
        self.base, self.check = np.zeros(width, np.int64), np.full(width, -1, np.int64)
        self.base[self.slot] = base
        self.check[self.slot[1:]] = self.slot[parent[1:]]

    def step(self, slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots that the ids lead to; -1 where there is no such child."""
        to = self.base[slots] + ids
        known = (to >= 0) & (to < len(self.check))
        return np.where(known & (self.check[np.where(known, to, 0)] == slots), to, -1)


NODE = (
    "upper boolean, top boolean, depth bigint, conv_id bigint, parent_conv_id bigint, parent_key binary, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, words bigint, above array<binary>,"
    " b_children bigint, b_leaves bigint, b_saved bigint"
)
_NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]
_NODE_KINDS = [
    pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
    pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64(),
]


def shard_nodes(part: pa.Table, depth: int) -> pa.RecordBatch:
    """Nodes of one shard of sorted segments. ``depth`` is that of the segments' roots; a root is a step below the top of the arrays."""
    part = part.combine_chunks()
    keys = part.column("keys").combine_chunks()
    roots = part.column("root").combine_chunks()
    n, bounds = len(part), np.asarray(keys.offsets).astype(np.int64)
    bounds, length = bounds - bounds[0], np.diff(bounds) + 1  # the root counts as the first turn
    where = np.concatenate([np.arange(n), np.repeat(np.arange(n), length - 1)])  # row and depth of every turn, roots first
    level = np.concatenate([np.zeros(n, np.int64), np.arange(bounds[-1]) - np.repeat(bounds[:-1], length - 1) + 1])
    broad = np.lexsort((where, level))
    flat = pa.concat_arrays([roots, keys.flatten()]).take(pa.array(broad))
    ids = np.asarray(flat.dictionary_encode().indices).astype(np.int64)  # dense, by first appearance
    where, level = where[broad], level[broad]
    words = np.concatenate([np.zeros(n, np.int64), np.asarray(part.column("words").combine_chunks().flatten())])[broad]
    cuts = np.searchsorted(level, np.arange(int(length.max(initial=0)) + 1))
    # Nodes level by level: a row starts one where its path differs from the row before.
    node_at, ids_at = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    parent, label, count = [np.array([-1])], [np.array([-1])], 1
    fresh = np.concatenate([[True], np.zeros(n - 1, bool)])
    for lo, hi in zip(cuts, cuts[1:]):
        rows = where[lo:hi]
        ids_at[:] = -1
        ids_at[rows] = ids[lo:hi]
        fresh[1:] |= ids_at[1:] != ids_at[:-1]
        own = fresh[rows]
        parent.append(node_at[rows[own]])
        label.append(ids[lo:hi][own])
        node_at[rows] = count + np.cumsum(own) - 1
        count += int(own.sum())
    trie = DoubleArray(np.concatenate(parent), np.concatenate(label))
    # Every path goes through the arrays; its slots collect what it carries.
    width = len(trie.check)
    weight, conv, root_conv = (np.asarray(part.column(c)) for c in ("weight", "conv_id", "root_conv"))
    convs, least = np.zeros(width, np.int64), np.full(width, _NONE, np.int64)
    deep, said = np.full(width, -1, np.int64), np.zeros(width, np.int64)
    at, slots = np.zeros(n, np.int64), []
    edges: dict[int, list[int]] = {0: [], n - 1: []}  # slots of the first and of the last path
    for d, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        rows = where[lo:hi]
        to = trie.step(at[rows], ids[lo:hi])
        at[rows] = to
        np.add.at(convs, to, weight[rows])
        np.minimum.at(least, to, (conv if d else root_conv)[rows])
        deep[to], said[to] = d, words[lo:hi]
        slots.append(np.unique(to))
        for row, line in edges.items():
            if length[row] > d:
                line.append(int(at[row]))
    upper, digests, above = np.zeros(width, bool), {}, {}
    for row, line in edges.items():
        path = [roots[row].as_py()]
        for step in keys[row].as_py():
            path.append(longer(path[-1], step))
        for k, slot in enumerate(line):
            upper[slot], digests[slot], above[slot] = True, path[k], path[:k]
    tops = {int(slot): roots[int(row)].as_py() for slot, row in zip(*np.unique(trie.step(np.zeros(n, np.int64), ids[:n]), return_index=True), strict=True)}
    last = np.asarray(part.column("last"))
    below = np.zeros((3, width), np.int64)
    for k, c in enumerate(("b_children", "b_leaves", "b_saved")):
        below[k, at[~last]] = np.asarray(part.column(c).fill_null(0))[~last]
    children, leaves, saved = np.zeros((3, width), np.int64)
    for s in reversed(slots):
        final = s[~upper[s]]
        children[final] += below[0, final]
        leaves[final] += below[1, final]
        saved[final] += below[2, final] + (convs[final] - 1) * said[final]
        leaves[final[children[final] == 0]] = 1
        up = trie.check[final]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[final])
        np.add.at(saved, up, saved[final])
    ends = np.full(width, None, object)
    ends[at[last]] = np.asarray(part.column("ends").to_pylist(), object)[last]
    s = np.concatenate(slots)
    up, open_ = trie.check[s], upper[s]
    known = (deep[s] > 0) & ~upper[up]
    below[:, ~upper] = 0
    columns = [
        open_, deep[s] == 0, depth + deep[s], least[s], pa.array(least[up], mask=~known), [digests.get(int(x)) for x in up], convs[s], children[s], leaves[s],
        saved[s], [ends[x] if ends[x] is not None or open_[k] else NO_ENDS for k, x in enumerate(s)], [digests.get(int(x), tops.get(int(x))) for x in s], said[s],
        [above.get(int(x)) for x in s], *below[:, s],
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _NODE_KINDS, strict=True)], names=_NODE_NAMES)


# -- levels -------------------------------------------------------------------------------


def level_nodes(part: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below (and at) the roots of segments that start at ``depth``, and what each root has below it.

    The second frame is ``root, b_children, b_leaves, b_saved``; the first holds the roots only at depth 0.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            sizes = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column("keys"))) + 1)
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                end = min(batch.num_rows, int(np.searchsorted(sizes, done + SHARD - size)) + 1)
                held.append(batch.slice(at, end - at))
                size += int(sizes[end - 1]) - done
                at = end
                if size >= SHARD:
                    yield shard_nodes(pa.Table.from_batches(held), depth)
                    held, size = [], 0
        if held:
            yield shard_nodes(pa.Table.from_batches(held), depth)

    ordered = part.repartitionByRange("root", "keys").sortWithinPartitions("root", "keys")
    found = cut_lineage(ordered.mapInArrow(shards, NODE))
    upper = cut_lineage(merged(found.where("upper")))
    names = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    inner = found.where("NOT upper AND NOT top")
    asked = inner.where("parent_key IS NOT NULL").join(names, "parent_key").withColumn("parent_conv_id", F.col("named"))
    high = upper.where("NOT top").join(names, "parent_key").withColumn("parent_conv_id", F.col("named"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = inner.where("parent_key IS NULL").select(columns).unionByName(asked.select(columns)).unionByName(high.select(columns))
    whole = found.where("NOT upper AND top").select("key", *columns)
    tops = whole.unionByName(upper.where("top").select("key", *columns))
    if depth == 0:
        return nodes.unionByName(tops.select(columns)), tops
    return nodes, tops.select(
        F.col("key").alias("root"), F.col("n_children").alias("b_children"), F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved")
    )


def merged(upper: DataFrame) -> DataFrame:
    """Upper nodes of all shards, one row each, with sums over all that lies below."""
    same = [F.any_value(c).alias(c) for c in ("top", "depth", "parent_key", "words", "above")]
    one = upper.groupBy("key").agg(
        *same, F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("ends_sha256").alias("ends_sha256"),
        *[(F.sum(c) + F.max(b)).alias(c) for c, b in (("n_children", "b_children"), ("n_leaves", "b_leaves"), ("saved_tokens", "b_saved"))],
    )
    one = cut_lineage(one)
    born = one.where("NOT top").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("born"))
    full = one.join(born, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("born", F.lit(0)))
    own = full.select(
        "key", "above", (F.col("n_leaves") + (F.col("n_children") == 0).cast("int")).alias("leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    sums = own.select(F.explode(F.concat("above", F.array("key"))).alias("key"), "leaves", "saved").groupBy("key").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    lost = full.drop("above", "born", "n_leaves", "saved_tokens").join(sums, "key")
    return lost.withColumn("parent_conv_id", F.lit(None).cast("bigint")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def tails(part: DataFrame) -> DataFrame:
    """Nodes of segments whose path no other one shares: their conversation is alone on them."""
    each = part.select("*", F.posexplode("words").alias("i", "n"))
    ahead = F.col("rest") + F.aggregate(F.slice("words", F.col("i") + 1, F.size("words")), F.lit(0).cast("bigint"), lambda s, w: s + w)
    at_end = F.col("last") & (F.col("i") + 1 == F.size("words"))
    return each.select(
        "conv_id", (F.col("level") * SEGMENT + F.col("i") + 1).cast("bigint").alias("depth"), F.when(F.col("i") == 0, F.col("root_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"), F.when(at_end, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("weight") - 1) * ahead).alias("saved_tokens"), F.when(at_end, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def trie(ordered: DataFrame) -> DataFrame:
    """All nodes of the trie over turns ``conv_id, part, turn, key, words, skip``."""
    cut = cut_lineage(segments(ordered))
    paths = cut_lineage(equal_paths(cut))
    work = cut.join(paths, "conv_id").withColumn("rest", F.col("total") - F.col("cum"))
    # Who passes a root: paths that go on behind it, and those that end there.
    passing = work.where("level > 0").select("root", "conv_id", F.lit(1).alias("on")).unionByName(
        work.where(F.col("last") & (F.size("keys") == SEGMENT)).select(F.col("next").alias("root"), "conv_id", F.lit(0).alias("on"))
    )
    roots = passing.groupBy("root").agg(F.min("conv_id").alias("root_conv"), (F.sum("on") > 1).alias("shared"))
    work = cut_lineage(
        work.join(roots, "root", "left")
        .withColumn("root_conv", F.when(F.col("level") == 0, F.col("conv_id")).otherwise(F.col("root_conv")))
        .withColumn("shared", (F.col("level") == 0) | F.col("shared"))
    )
    deepest = work.where("shared").agg(F.max("level")).first()[0]
    nodes, heads = tails(work.where("NOT shared")), None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        part = work.where((F.col("level") == level) & F.col("shared"))
        alone = [F.lit(1).cast("bigint").alias("b_children"), F.lit(1).cast("bigint").alias("b_leaves"), ((F.col("weight") - 1) * F.col("rest")).alias("b_saved")]
        if heads is None:
            part = part.select("*", *alone)
        else:
            part = part.join(heads.withColumnRenamed("root", "next"), "next", "left").select(
                *part.columns, *[F.coalesce(c, own).alias(c) for c, own in zip(("b_children", "b_leaves", "b_saved"), alone, strict=True)]
            )
        found, heads = level_nodes(part, level * SEGMENT)
        nodes = nodes.unionByName(found)
    return nodes


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(rows))


#: Nodes as distinct prefix digests, with all pairs of a node and an ancestor.
ORACLE = f"""WITH said AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || '|' || coalesce(role, '') || '|' || coalesce(text, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p FROM said),
ids AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS family, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {BORROWED + 1} AS h
  FROM (SELECT DISTINCT conv_id FROM said)),
turns AS (SELECT i.conv_id, 0 AS own, p, k, words FROM ids i JOIN placed b ON b.conv_id = i.family AND b.p <= i.h
  UNION ALL SELECT i.conv_id, 1, p, k, words FROM ids i JOIN placed b ON b.conv_id = i.conv_id AND b.p > i.h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d FROM turns),
paths AS (SELECT conv_id, d, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key, words FROM numbered
  UNION ALL SELECT conv_id, 0, md5(''), 0 FROM ids),
passing AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n, any_value(words) AS words,
  string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ended FROM passing GROUP BY key),
born AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
under AS (SELECT DISTINCT a.key AS top, b.key FROM passing a JOIN passing b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT top, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.words) AS saved
  FROM under u JOIN nodes x ON x.key = u.key LEFT JOIN born c ON c.key = u.key GROUP BY top)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(b.n, 0) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ended, '')) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.key = x.parent LEFT JOIN born b ON b.key = x.key JOIN sums s ON s.top = x.key
"""

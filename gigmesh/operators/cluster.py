"""Greedy leader clustering in rounds of bounded size.

Inside a block, rows are taken in order; a row joins the first leader it matches
and becomes a leader itself when it matches none. Leaders only: the relation is
not closed transitively.

Most blocks are small and settle in one pass. A bigger block settles in rounds:
its first ``size`` open rows are decided among themselves, then its other open
rows are tested against the new leaders only and the absorbed ones leave. That
is exact, because a row's leader is the earliest matching leader and every
earlier row has been decided before. No round compares more than ``size`` rows
with each other or with more than ``size`` leaders, and a block of near-copies
shrinks to nothing after its first round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gigmesh.runtime import cut_lineage, largest_group

FIRST_ROUND = 64
LARGEST_ROUND = 256

Matches = Callable[[DataFrame], DataFrame]


def first_of_block(df: DataFrame, n: int, block: str = "block", pos: str = "pos") -> DataFrame:
    """The first ``n`` rows of each block. The rank filter is applied before the shuffle, too."""
    w = Window.partitionBy(block).orderBy(pos)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def _pairs(leading: DataFrame, following: DataFrame, ordered: bool) -> DataFrame:
    a, b = leading.alias("a"), following.alias("b")
    on = F.col("a.block") == F.col("b.block")
    return a.join(b, on & (F.col("a.pos") < F.col("b.pos")) if ordered else on)


def settle(edges: DataFrame) -> DataFrame:
    """Leaders from match edges ``(block, a, b)``, ``a`` before ``b``: rows ``(block, pos, leader)``.

    Edges are taken by ``b``, then ``a``. Both ends come before any later ``b``, so
    ``b`` joins the first ``a`` that has not itself been absorbed. Leaders appear
    with themselves. A block holds one round of rows at most, which bounds the fold.
    """
    start = F.array().cast("array<struct<pos: bigint, leader: bigint>>")

    def step(led, edge):
        settled = F.exists(led, lambda x: (x["pos"] == edge["b"]) | (x["pos"] == edge["a"]))
        joins = F.array(F.struct(edge["b"].alias("pos"), edge["a"].alias("leader")))
        return F.when(settled, led).otherwise(F.concat(led, joins))

    folded = edges.groupBy("block").agg(
        F.aggregate(F.array_sort(F.collect_set(F.struct("b", "a"))), start, step).alias("led")
    )
    heads = F.transform(
        F.array_distinct(F.transform("led", lambda x: x["leader"])), lambda p: F.struct(p.alias("pos"), p.alias("leader"))
    )
    rows = folded.select("block", F.explode(F.concat("led", heads)).alias("x"))
    return rows.select("block", "x.pos", "x.leader")


def leaders(nodes: DataFrame, matches: Matches, size: int = FIRST_ROUND) -> DataFrame:
    """Assign every node with a match to its leader: ``(block, pos, leader)``.

    ``nodes`` needs ``block``, ``pos BIGINT`` (unique per block) and whatever
    ``matches`` reads; ``matches`` gets pairs with aliases ``a`` (earlier) and ``b``
    and returns the matching ones. Nodes without any match are left out.
    """
    biggest = largest_group(nodes, "block")
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def edges(pairs):
        return matches(pairs).select(
            F.col("a.block").alias("block"), F.col("a.pos").alias("a"), F.col("b.pos").alias("b")
        )

    def decide(batch):
        # Few bytes but much work per pair: a fixed width keeps every core busy, and the
        # join and the fold both reuse this partitioning.
        spread = batch.repartition(width, "block")
        return settle(edges(_pairs(spread, spread, ordered=True)))

    if biggest <= size:
        return decide(nodes)

    decided, open_ = [], nodes
    while True:
        batch = cut_lineage(first_of_block(open_, size))
        settled = cut_lineage(decide(batch))
        decided.append(settled)
        absorbed = settled.where("pos <> leader").select("block", "pos")
        chosen = batch.join(absorbed, ["block", "pos"], "left_anti")
        last = batch.groupBy("block").agg(F.max("pos").alias("__last"), F.count("*").alias("__n"))
        rest = (
            open_.join(last.where(F.col("__n") == size), "block").where(F.col("pos") > F.col("__last")).drop("__last", "__n")
        )
        joined = cut_lineage(
            edges(_pairs(chosen, rest, ordered=False)).groupBy("block", F.col("b").alias("pos")).agg(F.min("a").alias("leader"))
        )
        decided.append(joined)
        open_ = cut_lineage(rest.join(joined.select("block", "pos"), ["block", "pos"], "left_anti"))
        if open_.isEmpty():
            break
        size = min(size * 2, LARGEST_ROUND)
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return with_heads(out)


def with_heads(assigned: DataFrame) -> DataFrame:
    """Absorbed rows plus one row for each leader that absorbed any."""
    led = assigned.where("pos <> leader")
    heads = led.select("block", F.col("leader").alias("pos"), "leader").distinct()
    return led.unionByName(heads)

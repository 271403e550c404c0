"""Connected components of an edge table, by alternating stars.

Every round replaces each node's neighbours by the smallest one in reach, first towards
larger nodes, then towards smaller ones; the number of rounds grows with the logarithm of
the largest component. Minima combine before the shuffle, so a hub costs no more than its
edges. Each round is a table in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmesh.runtime import cut_lineage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours ``v`` of ``u`` (all, or the smaller ones) to the smallest of them and ``u``."""
    if larger:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", "m").toDF("u", "v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of edges ``(u, v)``; the component is its smallest node.

    Loops and repeated edges are allowed; edges with a null end are left out.
    """
    edges = cut_lineage(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    while True:
        edges = cut_lineage(_star(_star(edges, True), False))
        # Stable when the edges are stars already: a count and two sums tell.
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

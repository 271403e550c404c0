"""Row numbers in a given order, without one task for all rows.

Rows are sorted over range partitions, each partition numbers its own, and the counts of the partitions before it
are added. Only those counts, one row per partition, meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gigmesh.runtime import cut_lineage

#: Bits below the partition in ``monotonically_increasing_id``.
_WITHIN = 33


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of the given columns. Rows equal in them are in any order."""
    ordered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, _WITHIN)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    # One row per partition.
    joined = ordered.join(F.broadcast(starts), part == F.col("__part"))
    inside = F.col(name).bitwiseAND((1 << _WITHIN) - 1)
    return joined.withColumn(name, inside + F.col("__start")).drop("__part", "__start")

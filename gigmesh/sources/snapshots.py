"""Stored source payloads with an age limit.

A snapshot table has ``source``, ``cached_at`` and ``payload``; a NULL in either of
the last two is an unreadable entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions.text import snapshot_key

C = F.col


def _at(as_of):
    return F.to_timestamp_ntz(F.lit(str(as_of)))


def fresh(df: DataFrame, as_of, ttl_hours: int | None = None, key: str = "source") -> DataFrame:
    """Latest payload per key, if it is readable and no older than the limit (0 means the default)."""
    latest = df.groupBy(key).agg(F.max("cached_at").alias("cached_at"), F.max_by("payload", "cached_at").alias("payload"))
    oldest = _at(as_of) - F.make_dt_interval(F.lit(0), F.lit(ttl_hours or fx.SNAPSHOT_TTL_HOURS))
    return latest.where((C("cached_at") >= oldest) & C("payload").isNotNull())


def pruned(df: DataFrame, as_of, max_age_hours: int = fx.SNAPSHOT_PRUNE_HOURS) -> DataFrame:
    """Snapshots worth keeping: readable and within the age limit."""
    return df.where(_keep(as_of, max_age_hours))


def _keep(as_of, max_age_hours: int):
    oldest = _at(as_of) - F.make_dt_interval(F.lit(0), F.lit(max_age_hours))
    return F.coalesce((C("cached_at") >= oldest) & C("payload").isNotNull(), F.lit(False))


def prune_counts(df: DataFrame, as_of, max_age_hours: int = fx.SNAPSHOT_PRUNE_HOURS) -> DataFrame:
    keep = _keep(as_of, max_age_hours)
    return df.agg(F.count(F.when(keep, 1)).alias("kept"), F.count(F.when(~keep, 1)).alias("removed"))


def save(rows: DataFrame, path: str, source: str, as_of, keep_empty: bool = True) -> None:
    """Append listing rows of one source as its newest snapshot.

    The rows are stored as a table partition; the snapshot row points at it. With
    ``keep_empty`` off, a source that found nothing leaves its last snapshot alone.
    """
    if not keep_empty and rows.isEmpty():
        return
    spark = rows.sparkSession
    safe = spark.range(1).select(snapshot_key(F.lit(source)).alias("k")).first()["k"]
    stamp = str(as_of).replace(" ", "T").replace(":", "")
    rows.write.mode("overwrite").parquet(f"{path}/rows/{safe}/{stamp}")
    entry = spark.range(1).select(
        F.lit(source).alias("source"), _at(as_of).alias("cached_at"), F.lit(f"rows/{safe}/{stamp}").alias("payload")
    )
    entry.write.mode("append").parquet(f"{path}/index")


def load(spark, path: str, source: str, as_of, ttl_hours: int | None = None) -> DataFrame | None:
    """Rows of a source's fresh snapshot, or None."""
    index = spark.read.parquet(f"{path}/index").where(C("source") == source)
    hit = fresh(index, as_of, ttl_hours).first()
    return spark.read.parquet(f"{path}/{hit['payload']}") if hit else None


def clear(spark, path: str) -> None:
    """Forget all snapshots; stored rows stay until the folder is cleaned."""
    spark.createDataFrame([], "source string, cached_at timestamp_ntz, payload string").write.mode("overwrite").parquet(
        f"{path}/index"
    )

"""Venue dimension lookups.

Ids are resolved on the distinct ids of the fact side, so the probe work grows
with the number of venues, and one equi-join brings the answer back. Spark
broadcasts that answer when its measured size allows and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmesh.functions.text import blank, strip


def variant_map(venues: DataFrame) -> DataFrame:
    """``(variant, canonical_id)``; the last registry entry wins a shared variant."""
    own = F.array(F.struct(F.lit(0).alias("rank"), F.col("id").alias("variant")))
    others = F.transform(
        F.coalesce("id_variants", F.array().cast("array<string>")),
        lambda v, i: F.struct((i + 1).alias("rank"), F.lower(v).alias("variant")),
    )
    entries = venues.where(~blank(F.col("id"))).select("pos", "id", F.explode(F.concat(own, others)).alias("e"))
    return entries.groupBy(F.col("e.variant").alias("variant")).agg(
        F.max_by("id", F.struct("pos", "e.rank")).alias("canonical_id")
    )


def canonical_ids(ids: DataFrame, venues: DataFrame, column: str = "venue_id") -> DataFrame:
    """``(column, canonical_id)`` for each distinct id that the registry knows.

    Tried in order: the lower-cased id, spaces as underscores, no underscores.
    """
    key = strip(F.lower(F.col(column)))
    probes = F.array(key, F.translate(key, " ", "_"), F.translate(key, "_", ""))
    wanted = ids.where(~blank(F.col(column))).select(column).distinct()
    probe = wanted.select(column, F.posexplode(probes).alias("rank", "variant"))
    return (
        probe.join(variant_map(venues), "variant")
        .groupBy(column)
        .agg(F.min_by("canonical_id", "rank").alias("canonical_id"))
    )


def venue_info(df: DataFrame, venues: DataFrame, column: str = "venue_id") -> DataFrame:
    """Add the registry record of each row's venue as struct ``venue`` (NULL if unknown)."""
    known = canonical_ids(df, venues, column)
    records = venues.groupBy("id").agg(F.max_by(F.struct(*venues.columns), "pos").alias("venue"))
    info = known.join(records.withColumnRenamed("id", "canonical_id"), "canonical_id", "left")
    return df.join(info, column, "left")


def registry_location(venue: Column) -> Column:
    """``City``, or ``City, ST`` outside the home state; NULL without a city."""
    city, state = venue["location"], F.coalesce(venue["state"], F.lit("MA"))
    return F.when(blank(city), F.lit(None)).when(state == "MA", city).otherwise(F.concat_ws(", ", city, state))


def map_values(df: DataFrame, table: DataFrame, key: str, target: str, default: Column | None = None) -> DataFrame:
    """Replace values through a ``(key, value)`` table, unmatched rows keep ``default``."""
    lookup = table.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    out = df.join(lookup, strip(F.lower(F.col(key))) == F.col("__key"), "left")
    fallback = F.col(key) if default is None else default
    return out.withColumn(target, F.coalesce("__value", fallback)).drop("__key", "__value")

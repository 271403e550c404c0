"""Normalization of raw listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import temporal, text
from gigmesh.operators import dimension
from gigmesh.runtime import computed_once, cut_lineage


def venue_id_by_rule(venue_id: Column, venue_name: Column) -> Column:
    """Ids decided by text rules alone; NULL leaves the id to the registry."""
    vid = text.strip(F.lower(F.regexp_replace(venue_id, "[’‘`]", "'")))
    name = text.strip(F.lower(F.coalesce(venue_name, F.lit(""))))
    rooms = (
        F.when(name.contains("upstairs"), F.lit("middleeast_up"))
        .when(name.contains("downstairs"), F.lit("middleeast_down"))
        .when(name.contains("corner") | name.contains("bakery"), F.lit("middleeast_corner"))
        .when(name.contains("zuzu"), F.lit("middleeast_zuzu"))
        .otherwise(F.lit("middleeast"))
    )
    return (
        F.when(text.blank(venue_id), F.lit("unknown"))
        .when(vid.contains("brien") & ~vid.contains("sally"), F.lit("obriens"))
        .when(vid.contains("sallyobrien") | vid.contains("sally_obrien"), F.lit("sallyobriens"))
        .when(vid.rlike("middle[-_]?east"), rooms)
    )


def venue_id_fallback(venue_id: Column) -> Column:
    vid = text.strip(F.lower(F.regexp_replace(venue_id, "[’‘`]", "'")))
    return F.translate(vid, " ", "_")


def venue_name(name: Column) -> Column:
    known = F.try_element_at(text.literal_map(fx.VENUE_NAMES), text.strip(F.lower(name)))
    return F.when(text.blank(name), F.lit("Unknown Venue")).otherwise(F.coalesce(known, name))


def location(c: Column, registry: Column | None = None) -> Column:
    """City text: the registry wins, then towns out of state, then local spellings."""
    city = text.strip(c)
    low = F.lower(city)
    away = F.try_element_at(text.literal_map(fx.AWAY_LOCATIONS), low)
    home = F.try_element_at(text.literal_map(fx.HOME_LOCATIONS), low)
    tried = [away, home, city] if registry is None else [registry, away, home, city]
    return F.when(text.blank(c), F.lit(fx.DEFAULT_LOCATION)).otherwise(F.coalesce(*tried))


def normalize_listings(df: DataFrame, venues: DataFrame | None = None) -> DataFrame:
    """Clean every field; rows left without a performer are dropped.

    With a venue registry, ids and cities are looked up on the distinct
    ``(venue_id, venue_name)`` pairs and joined back once. Pairs and answers are stored tables, so rows are formed
    once and move only if the answers are too many to be sent to them.
    """
    out = computed_once(df.withColumn("bands", text.normalize_bands(F.col("bands"))), "bands").where(F.size("bands") > 0)
    by_rule = venue_id_by_rule(F.col("venue_id"), F.col("venue_name"))
    fallback = venue_id_fallback(F.col("venue_id"))
    if venues is None:
        new_id, place = F.coalesce(by_rule, fallback), location(F.col("venue_location"))
    else:
        # The pairs of all rows: those of dropped ones answer for no row, and performers are not read for them.
        pairs = cut_lineage(df.select("venue_id", "venue_name").distinct())
        probe = pairs.withColumn("probe", F.regexp_replace("venue_id", "[’‘`]", "'"))
        known = dimension.canonical_ids(probe, venues, "probe")
        final = probe.join(known, "probe", "left").select(
            "venue_id", "venue_name", F.coalesce(by_rule, "canonical_id", fallback).alias("__id")
        )
        info = dimension.venue_info(final, venues, "__id").select(
            "venue_id", "venue_name", "__id", dimension.registry_location(F.col("venue")).alias("__place")
        )
        same = F.col("r.venue_id").eqNullSafe(F.col("i.venue_id")) & F.col("r.venue_name").eqNullSafe(
            F.col("i.venue_name")
        )
        out = out.alias("r").join(cut_lineage(info).alias("i"), same, "left").select("r.*", "__id", "__place")
        new_id, place = F.col("__id"), location(F.col("venue_location"), F.col("__place"))
    return (
        out.withColumn("venue_id", new_id)
        .withColumn("venue_name", venue_name(F.col("venue_name")))
        .withColumn("venue_location", place)
        .withColumn("time", temporal.normalize_time(F.col("time")))
        .withColumn("age_requirement", text.normalize_age(F.col("age_requirement")))
        .withColumn("flags", text.sorted_set(F.col("flags")))
        .drop("__id", "__place")
    )

"""Groupings, first-seen selection, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import temporal, text
from gigmesh.operators import numbering


def first_seen(df: DataFrame, keys: list, order="seq") -> DataFrame:
    """First row per key in ``order``.

    Keeping the minimum combines map-side, so a key holding most of
    the rows costs no more than any other.
    """
    order = [order] if isinstance(order, str) else list(order)
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    rest = [c for c in df.columns if c not in order]
    row = F.min_by(F.struct(*order, F.struct(*rest).alias("rest")), F.struct(*order)).alias("row")
    keyed = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(named)]).agg(row)
    return keyed.select(*[F.col("row")[o].alias(o) for o in order], "row.rest.*").select(*df.columns)


def by_week(df: DataFrame, as_of, weeks: int = fx.WEEKS_AHEAD) -> DataFrame:
    """Listings per week number, weeks without any included."""
    week = temporal.week_number(F.col("date"), as_of)
    counted = df.groupBy(week.alias("week_num")).agg(F.count("*").alias("listings"))
    every = df.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week_num"))
    return every.join(counted, "week_num", "left").select(
        "week_num", F.coalesce("listings", F.lit(0)).cast("bigint").alias("listings")
    )


def by_day(df: DataFrame, as_of, weeks: int = fx.WEEKS_AHEAD) -> DataFrame:
    week = temporal.week_number(F.col("date"), as_of)
    return (
        df.groupBy(week.alias("week_num"), F.to_date("date").alias("day"))
        .agg(F.count("*").alias("listings"))
        .where(F.col("week_num") < weeks)
    )


def band_rows(df: DataFrame) -> DataFrame:
    """One row per listing and billed name longer than one character, with its key."""
    rows = df.select("*", F.posexplode("bands").alias("place", "band")).where(F.length("band") > 1)
    return rows.withColumn("band_key", text.band_key(F.col("band")))


def band_names(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Display name and count per band key: the most frequent spelling, ties to the first seen."""
    at = F.struct("date", "seq", "place") if order is None else order
    spelled = band_rows(df).groupBy("band_key", "band").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "band"))["band"]
    return spelled.groupBy("band_key").agg(best.alias("display_name"), F.sum("n").alias("listings"))


def venue_names(df: DataFrame) -> DataFrame:
    """Display name, city and count per venue, taken from its first listing by date."""
    first = F.min(F.struct("date", "seq", "venue_name", "venue_location"))
    return df.groupBy("venue_id").agg(first.alias("f"), F.count("*").alias("listings")).select(
        "venue_id", F.col("f.venue_name").alias("venue_name"), F.col("f.venue_location").alias("venue_location"), "listings"
    )


def totals(df: DataFrame) -> DataFrame:
    """Listings, distinct bands and distinct venues in one row."""
    bands = band_rows(df).agg(F.countDistinct("band_key").alias("bands"))
    rest = df.agg(F.count("*").alias("listings"), F.countDistinct("venue_id").alias("venues"))
    tall = rest.select("listings", "venues", F.lit(0).cast("bigint").alias("bands")).unionByName(
        bands.select(F.lit(0).cast("bigint").alias("listings"), F.lit(0).cast("bigint").alias("venues"), "bands")
    )
    return tall.agg(*[F.max(c).alias(c) for c in ("listings", "venues", "bands")])


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("listings"))


def top_per_group(df: DataFrame, group: str, order: list, n: int, name: str = "position") -> DataFrame:
    """First ``n`` rows per group with their 1-based position. Ranks are cut before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def numbered(df: DataFrame, order: Column, tie: str = "id", name: str = "position") -> DataFrame:
    """1-based position over all rows by a text key, without sorting them in one task.

    Rows are ranged by key and tie together, so names that begin alike spread over tasks, too. Rows without a key come first.
    """
    out = numbering.numbered(df.withColumn("__order", order), "__order", tie, name=name)
    return out.withColumn(name, (F.col(name) + 1).cast("int")).drop("__order")


def article_free(c: Column) -> Column:
    """Sort key that ignores case and a leading "The "."""
    return F.regexp_replace(F.lower(c), "^the ", "")

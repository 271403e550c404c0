"""Listing tables: nested JSON in and out, snapshots, manual rows, source union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import temporal, text
from gigmesh.operators.numbering import numbered
from gigmesh.runtime import cut_lineage
from gigmesh.schema import COLUMNS, LISTING, NESTED_LISTING, no_strings, place, with_id

C = F.col


def from_nested(df: DataFrame) -> DataFrame:
    """Nested interchange rows to listings, field defaults applied, stored ids kept."""
    stamp = lambda c: F.to_timestamp_ntz(F.regexp_replace(F.substring(c, 1, 19), " ", "T"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    date = F.coalesce(stamp(C("date")), F.to_timestamp_ntz(F.substring("date", 1, 10), F.lit("yyyy-MM-dd")))
    keep = ["seq"] if "seq" in df.columns else []
    rows = df.select(
        *keep,
        C("id").alias("stored_id"),
        date.alias("date"),
        *[F.coalesce(C(f"venue.{f}"), F.lit("")).alias(f"venue_{f}") for f in ("id", "name", "location")],
        F.coalesce("bands", no_strings()).alias("bands"),
        F.coalesce("age_requirement", F.lit(fx.DEFAULT_AGE)).alias("age_requirement"),
        C("price.advance").alias("price_advance"),
        C("price.door").alias("price_door"),
        F.coalesce("time", F.lit(fx.DEFAULT_TIME)).alias("time"),
        F.coalesce("flags", no_strings()).alias("flags"),
        F.coalesce("source", F.lit("")).alias("source"),
        "source_url",
        F.coalesce("genre_tags", no_strings()).alias("genre_tags"),
        stamp(C("last_updated")).alias("last_updated"),
    )
    return with_id(rows).withColumn("id", F.coalesce("stored_id", "id")).drop("stored_id")


def read_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Listings stored as nested JSON. One object per line splits across tasks."""
    return from_nested(spark.read.schema(NESTED_LISTING).json(path, multiLine=multiline, mode="PERMISSIVE"))


def to_nested(df: DataFrame) -> DataFrame:
    """Listings in the nested interchange shape, display fields included."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    keep = ["seq"] if "seq" in df.columns else []
    stamp = iso(C("last_updated")) if "last_updated" in df.columns else F.lit(None).cast("string")
    return df.select(
        *keep,
        "id",
        iso(C("date")).alias("date"),
        F.date_format("date", "EEE").alias("day_of_week"),
        F.struct(C("venue_id").alias("id"), C("venue_name").alias("name"), C("venue_location").alias("location")).alias("venue"),
        "bands",
        "age_requirement",
        F.struct(
            C("price_advance").alias("advance"), C("price_door").alias("door"),
            text.price_display(C("price_advance"), C("price_door")).alias("display"),
        ).alias("price"),
        "time", "flags", "source", "source_url", "genre_tags",
        stamp.alias("last_updated"),
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_nested(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def snapshot_meta(df: DataFrame, as_of) -> DataFrame:
    """The one-row description published with a listing set."""
    return df.agg(
        F.to_timestamp_ntz(F.lit(str(as_of))).alias("last_updated"),
        F.count("*").alias("total"),
        F.lit("gigmesh").alias("generated_by"),
    )


def write_snapshot(df: DataFrame, path: str, as_of) -> None:
    """Rows and their description side by side under ``path``."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    snapshot_meta(rows, as_of).write.mode("overwrite").parquet(f"{path}/meta")


def append_manual(new: DataFrame, path: str) -> None:
    """Add hand-entered listings to the manual set; existing rows are not read."""
    new.write.mode("append").parquet(path)


# -- sources -------------------------------------------------------------------

Source = Callable[[SparkSession], DataFrame]


class SourceRegistry:
    """Listing sources in a fixed order.

    Rows get ``seq`` from their source's rank and their place inside the source, as dense numbers, so
    later steps can rely on ingest order and no two rows share one.
    """

    def __init__(self) -> None:
        self._sources: list[tuple[int, str, Source]] = []

    def register(self, name: str, read: Source, rank: int | None = None) -> None:
        self._sources.append((len(self._sources) if rank is None else rank, name, read))

    def union(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """``(listings, errors)``; a source that fails, when planned or when run, adds no rows and one error.

        Each source is written to a table of its own before the union, so a corrupt file or a failing cast
        costs that source alone. A source may bring its own ``seq`` as position, a number or a
        :func:`gigmesh.schema.place`; otherwise file order is used.
        """
        parts, errors = [], []
        for order, (_, name, read) in enumerate(sorted(self._sources, key=lambda s: s[0])):
            try:
                rows = read(spark)
                known = rows.schema["seq"].dataType.simpleString() if "seq" in rows.columns else None
                at = C("seq") if known and known.startswith("struct") else place(C("seq") if known else F.monotonically_increasing_id(), F.lit(0))
                columns = [at.alias("seq") if c == "seq" else C(c) for c in COLUMNS]
                parts.append(cut_lineage(rows.select(F.lit(order).alias("__source"), *columns)))
            except Exception as error:  # noqa: BLE001
                errors.append((name, f"{type(error).__name__}: {error}"[:500]))
        report = spark.createDataFrame(errors, "source string, error string")
        if not parts:
            return spark.createDataFrame([], LISTING).select(*COLUMNS), report
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        out = numbered(out.withColumnRenamed("seq", "__at"), "__source", "__at", name="seq")
        return out.select(*COLUMNS), report


def source_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("listings"))


def recurring(
    schedule: DataFrame, as_of, venue: tuple[str, str, str] = fx.RECURRING_VENUE, source: str = fx.RECURRING_SOURCE,
    weeks: int = fx.RECURRING_WEEKS, age: str = "21+",
) -> DataFrame:
    """Listings of a weekly schedule: one per entry and matching day of the coming weeks.

    ``schedule`` has ``entry``, ``days``, ``time``, ``bands`` and ``genre_tags``.
    """
    start = temporal.as_date(as_of)
    days = F.sequence(start, F.date_add(start, 7 * weeks - 1))
    names = text.literal_array(fx.WEEKDAYS)
    wanted = F.transform("days", lambda d: F.lower(d))
    hits = F.filter(days, lambda d: F.array_contains(wanted, F.element_at(names, F.weekday(d) + 1)))
    rows = schedule.select("entry", "time", "bands", "genre_tags", F.explode(hits).alias("day"))
    out = rows.select(
        place(C("entry"), F.datediff("day", start)).alias("seq"),
        temporal.event_time(C("day"), C("time")).alias("date"),
        F.lit(venue[0]).alias("venue_id"), F.lit(venue[1]).alias("venue_name"), F.lit(venue[2]).alias("venue_location"),
        "bands", F.lit(age).alias("age_requirement"),
        F.lit(None).cast("int").alias("price_advance"), F.lit(None).cast("int").alias("price_door"),
        "time", no_strings().alias("flags"), F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("source_url"), "genre_tags",
    )
    return with_id(out)


def fixed_schedule(spark: SparkSession) -> DataFrame:
    rows = [(i, *entry) for i, entry in enumerate(fx.RECURRING_SCHEDULE)]
    return spark.createDataFrame(
        rows, "entry bigint, days array<string>, time string, bands array<string>, genre_tags array<string>"
    )

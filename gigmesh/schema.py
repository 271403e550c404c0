"""Shape of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import text
from gigmesh.runtime import computed_once

LISTING = """
    seq BIGINT, id STRING, date TIMESTAMP_NTZ,
    venue_id STRING, venue_name STRING, venue_location STRING,
    bands ARRAY<STRING>, age_requirement STRING,
    price_advance INT, price_door INT, time STRING,
    flags ARRAY<STRING>, source STRING, source_url STRING,
    genre_tags ARRAY<STRING>, last_updated TIMESTAMP_NTZ
"""

NESTED_LISTING = """
    id STRING, date STRING, day_of_week STRING,
    venue STRUCT<id: STRING, name: STRING, location: STRING>,
    bands ARRAY<STRING>, age_requirement STRING,
    price STRUCT<advance: INT, door: INT, display: STRING>,
    time STRING, flags ARRAY<STRING>, source STRING, source_url STRING,
    genre_tags ARRAY<STRING>, last_updated STRING
"""

def place(document: Column, block: Column, item: Column | None = None) -> Column:
    """A row's place in its source as an ordered value: nothing is packed, so no number of blocks or items collides."""
    item = F.lit(0) if item is None else item
    return F.struct(document.cast("bigint").alias("document"), block.cast("int").alias("block"), item.cast("int").alias("item"))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def defaults() -> dict[str, Column]:
    """Default of every optional listing column."""
    return {
        "venue_id": F.lit(""),
        "venue_name": F.lit(""),
        "venue_location": F.lit(""),
        "bands": no_strings(),
        "age_requirement": F.lit(fx.DEFAULT_AGE),
        "price_advance": F.lit(None).cast("int"),
        "price_door": F.lit(None).cast("int"),
        "time": F.lit(fx.DEFAULT_TIME),
        "flags": no_strings(),
        "source": F.lit(""),
        "source_url": F.lit(None).cast("string"),
        "genre_tags": no_strings(),
    }


COLUMNS = [
    "seq", "id", "date", "venue_id", "venue_name", "venue_location", "bands", "age_requirement",
    "price_advance", "price_door", "time", "flags", "source", "source_url", "genre_tags",
]


def as_listings(df: DataFrame, carry: tuple[str, ...] = (), **values: Column) -> DataFrame:
    """Project payload rows to listing columns.

    ``values`` gives listing columns; the rest take their defaults. ``seq`` is
    kept when present, ``id`` is derived when not given. Columns in ``carry`` are kept too.
    """
    cols = {"date": values["date"] if "date" in values else F.col("date")}
    for name, default in defaults().items():
        cols[name] = values.get(name, default)
    extra = [name for name in ("seq", "id", "last_updated") if name in values]
    keep = [values[name].alias(name) for name in extra]
    if "seq" in df.columns and "seq" not in values:
        keep.append(F.col("seq"))
    out = df.select(*keep, *[c.alias(n) for n, c in cols.items()], *carry)
    out = computed_once(out, *[n for n in out.columns if n != "seq" and n not in carry])
    return out if "id" in values else with_id(out)


def with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", text.stable_id(F.col("date"), F.col("venue_id"), F.col("bands"), F.col("time")))

"""Venue registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions.text import blank

C = F.col

VENUE = """id: STRING, name: STRING, location: STRING, state: STRING, address: STRING, phone: STRING, website: STRING,
  notes: STRING, status: STRING, closed_year: INT, capacity: INT, id_variants: ARRAY<STRING>"""
SCHEMA = f"venues ARRAY<STRUCT<{VENUE}>>"


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    """The registry file; entries without an id are dropped, the last of equal ids stays."""
    doc = spark.read.schema(SCHEMA).json(path, multiLine=True)
    rows = doc.select(F.posexplode("venues").alias("pos", "v")).select("pos", "v.*").where(~blank(C("id")))
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "pos").alias("v")).select("v.*")


def default_venues(spark: SparkSession) -> DataFrame:
    """The built-in directory used without a registry file."""
    rows = [(i, *v) for i, v in enumerate(fx.DEFAULT_VENUES)]
    base = spark.createDataFrame(
        rows,
        "pos int, id string, name string, location string, address string, phone string, website string, capacity int, notes string",
    )
    nothing = F.lit(None)
    return base.select(
        "*", nothing.cast("string").alias("state"), nothing.cast("string").alias("status"),
        nothing.cast("int").alias("closed_year"), F.array().cast("array<string>").alias("id_variants"),
    )


def full_name(name, location):
    """``Name, City``."""
    return F.concat_ws(", ", name, location)

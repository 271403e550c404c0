"""Listings derived from order tables, one listing per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmesh.functions import text
from gigmesh.schema import with_id

AS_OF = "1998-01-01"

VENUES = [
    "Paradise Rock Club", "The Paradise Rock Club - Boston", "PARADISE", "The Sinclair", "Sinclair",
    "Royale", "Royale Boston", "Middle East Upstairs", "Middle East - Upstairs", "Lizard Lounge",
    "Deep Cuts", "O'Brien's Pub",
]
TIMES = ["7pm", "8pm", "8:30pm", "10 PM", ""]
AGES = {"1": "21+", "2": "18 and over", "3": "All Ages", "4": "", "5": "16+"}
SOURCES = {"P": "ticketmaster", "F": "seatgeek", "O": "scrape:safe_in_a_crowd"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(text.literal_array(values), index.cast("int") + 1)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings: an order is a show, its lines are the billing.

    Lines are spread by order key as they are and grouped where they arrive, and the join
    with orders reuses that partitioning. Orders meet their customers before, while rows are
    narrow, so billings move once.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    billing = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .drop("p_partkey")
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))).alias("lines"),
            F.array_sort(F.collect_set(F.lower("p_type"))).alias("genre_tags"),
            F.min("l_suppkey").alias("supp"),
        )
    )
    places = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey")
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "n_name")
    )
    # What listings keep of a price and a priority is formed before rows move.
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.floor(F.col("o_totalprice") / 20000).cast("int").alias("advance"),
        F.substring("o_orderpriority", 1, 1).alias("priority"), "o_orderstatus",
    )
    placed = orders.join(places, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey", "c_custkey")
    key = F.col("o_orderkey")
    # The join key's partitioning is set here and kept by the join, however few files hold the orders.
    rows = placed.repartition("o_orderkey").join(billing, key == F.col("l_orderkey"), "left")
    venue = (F.coalesce("supp", F.lit(0)) % 12).cast("int") + 1
    name = F.element_at(text.literal_array(VENUES), venue)
    advance = F.col("advance")
    none = F.array().cast("array<string>")
    out = rows.select(
        key.alias("seq"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("date"),
        # Slugs of fixed names are constants.
        F.element_at(F.array(*[text.slug(F.lit(v), "line") for v in VENUES]), venue).alias("venue_id"),
        name.alias("venue_name"),
        F.col("n_name").alias("venue_location"),
        F.coalesce(F.transform("lines", lambda x: x["p_name"]), none).alias("bands"),
        F.coalesce(
            F.try_element_at(text.literal_map(AGES), F.col("priority")), F.lit("")
        ).alias("age_requirement"),
        advance.alias("price_advance"),
        F.when(key % 3 == 0, advance + 5).alias("price_door"),
        _pick(TIMES, key % 5).alias("time"),
        F.when(key % 7 == 0, F.array(F.lit("$"), F.lit("@"), F.lit("$"))).otherwise(none).alias("flags"),
        F.try_element_at(text.literal_map(SOURCES), F.col("o_orderstatus")).alias("source"),
        F.lit(None).cast("string").alias("source_url"),
        F.coalesce("genre_tags", none).alias("genre_tags"),
    )
    return with_id(out)


def venue_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A venue registry derived from suppliers: ids, variants, city and state."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    name = _pick(VENUES, F.col("s_suppkey") % 12)
    slug = text.slug(name, "line")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("pos"),
        F.concat(F.lit("v"), (F.col("s_suppkey") % 12).cast("string")).alias("id"),
        name.alias("name"),
        F.col("n_name").alias("location"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("MA")).otherwise(F.lit("NH")).alias("state"),
        F.array(F.upper(slug), F.translate(slug, "_", "")).alias("id_variants"),
    )

"""Snapshots, first-seen selection, run-to-run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from gigmesh.operators import filters, grouping
from gigmesh.operators.normalize import normalize_listings
from gigmesh.runtime import checkpoint_dir, cut_lineage
from gigmesh.schema import with_id
from gigmesh.sources import snapshots
from gigmesh.sources.tables import AS_OF, listings, table
from gigmesh.streaming import new_listings
from registry.base import id_sql, query, with_norm

C = F.col
EVENTS_AS_OF = "2024-01-20 12:00:00"


def as_snapshots(spark, d):
    """Events as snapshots: one source per user, error events are unreadable."""
    return table(spark, d, "events").select(
        F.concat(F.lit("user/"), "user_id").alias("source"),
        C("ts").cast("timestamp_ntz").alias("cached_at"),
        F.when(C("event_type") != "error", C("props")).alias("payload"),
    ).where(C("cached_at") <= F.to_timestamp_ntz(F.lit(EVENTS_AS_OF)))


SNAPS = f"""WITH s AS (SELECT 'user/' || user_id AS source, ts AS cached_at, CASE WHEN event_type <> 'error' THEN props END AS payload
  FROM events WHERE ts <= TIMESTAMP '{EVENTS_AS_OF}')"""


@query("fresh_snapshots", SNAPS + f""", l AS (SELECT source, max(cached_at) AS cached_at, list(payload ORDER BY cached_at DESC)[1] AS payload FROM s GROUP BY 1)
  SELECT * FROM l WHERE cached_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 12 HOUR AND payload IS NOT NULL""")
def fresh_snapshots(spark, d):
    return snapshots.fresh(as_snapshots(spark, d), EVENTS_AS_OF)


@query("prune_snapshots", SNAPS + f""" SELECT count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS removed
  FROM (SELECT cached_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR AND payload IS NOT NULL AS k FROM s)""")
def prune_snapshots(spark, d):
    return snapshots.prune_counts(as_snapshots(spark, d), EVENTS_AS_OF)


@query("pruned_rows", SNAPS + f" SELECT * FROM s WHERE cached_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR AND payload IS NOT NULL")
def pruned_rows(spark, d):
    return snapshots.pruned(as_snapshots(spark, d), EVENTS_AS_OF)


@query("first_seen", """SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)
  ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def first_seen(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    return grouping.first_seen(e, ["user_id", "event_type", "day"], "event_id").drop("day")


@query("first_seen_listings", with_norm("""SELECT 'day_headliner' AS key, seq FROM (SELECT seq, row_number() OVER (PARTITION BY CAST(date AS DATE), lower(bands[1]) ORDER BY seq) AS r FROM norm) WHERE r = 1
  UNION ALL SELECT 'day_bands', seq FROM (SELECT seq, row_number() OVER (PARTITION BY CAST(date AS DATE), bands ORDER BY seq) AS r FROM norm) WHERE r = 1
  UNION ALL SELECT 'day_headliner_venue', seq FROM (SELECT seq, row_number() OVER (PARTITION BY CAST(date AS DATE), lower(bands[1]), venue_id ORDER BY seq) AS r FROM norm) WHERE r = 1
  UNION ALL SELECT 'day_venue_time', seq FROM (SELECT seq, row_number() OVER (PARTITION BY CAST(date AS DATE), venue_id, "time" ORDER BY seq) AS r FROM norm) WHERE r = 1
  UNION ALL SELECT 'day_time_title', seq FROM (SELECT seq, row_number() OVER (PARTITION BY CAST(date AS DATE), "time", left(lower(bands[1]), 30) ORDER BY seq) AS r FROM norm) WHERE r = 1"""))
def first_seen_listings(spark, d):
    """The key variants the sources use to drop repeats."""
    rows = cut_lineage(normalize_listings(listings(spark, d)).select("seq", "date", "bands", "venue_id", "time"))
    day, head = F.to_date("date"), F.lower(F.element_at("bands", 1))
    variants = {
        "day_headliner": [day, head],
        "day_bands": [day, F.to_json("bands")],
        "day_headliner_venue": [day, head, C("venue_id")],
        "day_venue_time": [day, C("venue_id"), C("time")],
        "day_time_title": [day, C("time"), F.substring(head, 1, 30)],
    }
    out = None
    for name, keys in variants.items():
        part = grouping.first_seen(rows, keys).select(F.lit(name).alias("key"), "seq")
        out = part if out is None else out.unionByName(part)
    return out


@query("new_since", with_norm(f"""SELECT id, seq, date FROM norm WHERE date >= DATE '{AS_OF}'
  AND id NOT IN (SELECT id FROM norm WHERE seq % 3 <> 0)"""))
def new_since(spark, d):
    rows = normalize_listings(listings(spark, d))
    return new_listings.new_since(filters.not_past(rows, AS_OF), rows.where("seq % 3 <> 0")).select("id", "seq", "date")


@query("stream_new", with_norm(f"SELECT DISTINCT {id_sql()} AS id FROM norm"))
def stream_new(spark, d):
    """All listings through a stream; each id comes out once."""
    import uuid

    base = f"{checkpoint_dir(spark)}/stream/{uuid.uuid4().hex}"
    listings(spark, d).withColumn("last_updated", F.to_timestamp_ntz(F.lit(AS_OF))).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/in")
    query = new_listings.write_stream(new_listings.stream_new(raw), f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(with_id(normalize_listings(spark.read.schema(schema).parquet(f"{base}/in"))).schema).parquet(f"{base}/out").select("id")


@query("stream_digest", with_norm(f"SELECT DISTINCT {id_sql()} AS id, 1 AS n FROM norm WHERE date >= DATE '{AS_OF}'"))
def stream_digest(spark, d):
    """All listings twice through a stream of several batches: each id from today on comes out once."""
    import uuid

    base = f"{checkpoint_dir(spark)}/stream/{uuid.uuid4().hex}"
    rows = listings(spark, d)
    rows.write.parquet(f"{base}/once")
    again = spark.read.schema(rows.schema).parquet(f"{base}/once")
    for _ in range(2):
        again.write.mode("append").parquet(f"{base}/in")
    raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    new_listings.stream_digest(raw, f"{base}/out", f"{base}/checkpoint", AS_OF, horizon="60 days").awaitTermination()
    return spark.read.parquet(f"{base}/out/rows").groupBy("id").agg(F.count("*").alias("n"))

"""Venue registry lookups and value maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.operators import dimension
from gigmesh.operators.normalize import normalize_listings
from gigmesh.sources.tables import listings, table, venue_registry
from registry.base import RAW, VENUE_LIST, line_slug, location_sql, normalize_band_sql, query, sql_case_map, venue_rule_sql

C = F.col

REG = f"""reg AS (SELECT s_suppkey AS pos, 'v' || (s_suppkey % 12) AS id, {VENUE_LIST}[CAST(s_suppkey % 12 AS INT) + 1] AS name, n_name AS location,
    CASE WHEN s_suppkey % 2 = 0 THEN 'MA' ELSE 'NH' END AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  reg1 AS (SELECT *, {line_slug('name')} AS slug FROM reg),
  vmap AS (SELECT variant, arg_max(id, pos * 10 + rank) AS canonical FROM (
    SELECT id AS variant, id, pos, 0 AS rank FROM reg1 UNION ALL SELECT lower(upper(slug)), id, pos, 1 FROM reg1
    UNION ALL SELECT replace(slug, '_', ''), id, pos, 2 FROM reg1) GROUP BY 1),
  rec AS (SELECT id, arg_max(location, pos) AS location, arg_max(state, pos) AS state, arg_max(name, pos) AS name FROM reg1 GROUP BY 1)"""


def canon(x):
    k = f"lower(trim({x}))"
    one = "(SELECT canonical FROM vmap WHERE variant = {})"
    return f"coalesce({one.format(k)}, {one.format(f'replace({k}, chr(32), chr(95))')}, {one.format(f'replace({k}, chr(95), chr(0))'.replace('chr(0)', chr(39) * 2))})"


@query("canonical_venue", f"""WITH {RAW}, {REG}, probe AS (SELECT DISTINCT CASE seq % 3 WHEN 0 THEN venue_id WHEN 1 THEN upper(replace(venue_id, '_', ' ')) ELSE 'none_' || venue_id END AS venue_id FROM raw)
  SELECT venue_id, {canon('venue_id')} AS canonical_id FROM probe WHERE {canon('venue_id')} IS NOT NULL""")
def canonical_venue(spark, d):
    s = C("seq") % 3
    probe = F.when(s == 0, C("venue_id")).when(s == 1, F.upper(F.translate("venue_id", "_", " "))).otherwise(F.concat(F.lit("none_"), "venue_id"))
    return dimension.canonical_ids(listings(spark, d).select(probe.alias("venue_id")), venue_registry(spark, d))


@query("venue_info", f"""WITH {RAW}, {REG}, k AS (SELECT seq, {canon('venue_id')} AS c FROM raw)
  SELECT seq, rec.id AS info_id, rec.name AS info_name, CASE WHEN rec.state = 'MA' THEN rec.location ELSE rec.location || ', ' || rec.state END AS place
  FROM k LEFT JOIN rec ON rec.id = c""")
def venue_info(spark, d):
    out = dimension.venue_info(listings(spark, d).select("seq", "venue_id"), venue_registry(spark, d))
    return out.select("seq", C("venue.id").alias("info_id"), C("venue.name").alias("info_name"), dimension.registry_location(C("venue")).alias("place"))


@query("normalize_with_registry", f"""WITH {RAW}, {REG},
  n0 AS (SELECT *, coalesce({venue_rule_sql('venue_id', 'venue_name')}, {canon('venue_id')}, replace(lower(trim(venue_id)), ' ', '_')) AS vid FROM raw WHERE len(bands) > 0),
  n1 AS (SELECT *, {canon('vid')} AS c FROM n0)
  SELECT n1.seq, vid AS venue_id, {sql_case_map('lower(trim(venue_name))', fx.VENUE_NAMES, 'venue_name')} AS venue_name,
    coalesce(CASE WHEN rec.state = 'MA' THEN rec.location ELSE rec.location || ', ' || rec.state END, {location_sql('venue_location')}) AS venue_location,
    array_to_string(list_transform(bands, lambda b: {normalize_band_sql('b')}), '|') AS bands
  FROM n1 LEFT JOIN rec ON rec.id = c""")
def normalize_with_registry(spark, d):
    out = normalize_listings(listings(spark, d), venue_registry(spark, d))
    return out.select("seq", "venue_id", "venue_name", "venue_location", F.array_join("bands", "|").alias("bands"))


@query("map_values", f"""WITH {RAW} SELECT seq, coalesce('Region ' || n_regionkey, venue_location) AS region FROM raw LEFT JOIN nation ON lower(n_name) = lower(trim(venue_location))""")
def map_values(spark, d):
    n = table(spark, d, "nation")
    lookup = n.select(F.lower("n_name").alias("key"), F.concat(F.lit("Region "), "n_regionkey").alias("value"))
    return dimension.map_values(listings(spark, d), lookup, "venue_location", "region").select("seq", "region")

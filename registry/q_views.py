"""Aggregations and published views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.operators import filters, grouping
from gigmesh.operators.normalize import normalize_listings
from gigmesh.runtime import cut_lineage
from gigmesh.plans import views
from gigmesh.sources.tables import AS_OF, listings, table
from registry.base import price_display_sql, query, sql_list, time_minutes_sql, with_norm

C = F.col
WEEK0 = f"date_trunc('week', DATE '{AS_OF}')"
WEEK = f"CAST(greatest(0, floor(date_diff('day', {WEEK0}, date_trunc('week', date)) / 7)) AS INT)"


def label_sql(week: str) -> str:
    start = f"CAST({WEEK0} AS DATE) + 7 * ({week})"
    return (
        f"strftime(CASE WHEN ({week}) = 0 THEN DATE '{AS_OF}' ELSE {start} END, '%b %-d') || ' - ' || "
        f"strftime({start} + 6, '%b %-d')"
    )


def esc(x: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
        f"'''', '&#x27;')"
    )


def venue_anchor(x: str) -> str:
    return f"left(translate(replace(lower({x}), ' ', '_'), '''.,', ''), 30)"


def band_anchor(x: str) -> str:
    return (
        f"left(regexp_replace(replace(replace(translate(replace(lower({x}), ' ', '_'), '''.,', ''), '&', 'and'), '$', 's'), "
        f"'[^\\p{{L}}\\p{{N}}_]', '', 'g'), 40)"
    )


BAND_KEY = "translate(trim(lower(band)), '''.,', '')"
PRICE = price_display_sql()
BAND_LINKS = f"""array_to_string(list_transform(bands, lambda b: '<a href="by-band.html#' || {band_anchor('b')} || '">' || {esc('b')} || '</a>'), ', ')"""
DETAILS = f"concat_ws(' ', {esc('age_requirement')}, nullif({PRICE}, ''), {esc(chr(34) + 'time' + chr(34))})"
FLAGS = f"coalesce(array_to_string(list_transform(flags, lambda f: {esc('f')}), ' '), '')"
LINE = (
    f"""concat_ws(' ', '<a href="by-club.html#' || {venue_anchor('venue_id')} || '"><b>' || {esc('venue_name')} || ', ' || {esc('venue_location')} || '</b></a>',
    {BAND_LINKS}, {DETAILS}, CASE WHEN len(flags) > 0 THEN {FLAGS} END)"""
)
EXPLODED = (
    "SELECT *, unnest(bands) AS band, generate_subscripts(bands, 1) AS place FROM norm"
)
BANDNAMES = f"""spelled AS (SELECT {BAND_KEY} AS band_key, band, count(*) AS n, min((date, seq, place)) AS first
    FROM ({EXPLODED}) WHERE length(band) > 1 GROUP BY 1, 2),
  bandnames AS (SELECT band_key, list(band ORDER BY n DESC, first)[1] AS display_name, CAST(sum(n) AS BIGINT) AS listings FROM spelled GROUP BY 1)"""
VENUENAMES = """venuenames AS (SELECT venue_id, list(venue_name ORDER BY date, seq)[1] AS venue_name,
    list(venue_location ORDER BY date, seq)[1] AS venue_location, count(*) AS listings FROM norm GROUP BY 1)"""


def norm(spark, d):
    return normalize_listings(listings(spark, d))


@query("by_week", with_norm(f"""SELECT w AS week_num, coalesce(n, 0) AS listings FROM (SELECT CAST(unnest(range({fx.WEEKS_AHEAD})) AS INT) AS w)
  LEFT JOIN (SELECT {WEEK} AS k, count(*) AS n FROM norm GROUP BY 1) ON k = w"""))
def by_week(spark, d):
    return grouping.by_week(norm(spark, d), AS_OF)


@query("by_day", with_norm(f"""SELECT {WEEK} AS week_num, CAST(date AS DATE) AS day, count(*) AS listings FROM norm WHERE {WEEK} < 43 GROUP BY 1, 2"""))
def by_day(spark, d):
    return grouping.by_day(norm(spark, d), AS_OF)


@query("by_band", with_norm(f"SELECT * FROM (WITH {BANDNAMES} SELECT band_key, display_name, listings FROM bandnames)"))
def by_band(spark, d):
    return grouping.band_names(norm(spark, d))


@query("by_venue", with_norm(f"SELECT * FROM (WITH {VENUENAMES} SELECT venue_id, venue_name, venue_location, listings FROM venuenames)"))
def by_venue(spark, d):
    return grouping.venue_names(norm(spark, d))


@query("totals", with_norm(f"""SELECT (SELECT count(*) FROM norm) AS listings, (SELECT count(DISTINCT venue_id) FROM norm) AS venues,
  (SELECT count(DISTINCT {BAND_KEY}) FROM (SELECT unnest(bands) AS band FROM norm)) AS bands"""))
def totals(spark, d):
    return grouping.totals(norm(spark, d))


@query("source_counts", with_norm("SELECT source, count(*) AS listings FROM norm GROUP BY 1"))
def source_counts(spark, d):
    return grouping.source_counts(norm(spark, d))


@query("distinct_flag_union", with_norm("""SELECT venue_id, array_to_string(list_sort(list_distinct(flatten(list(flags)))), '|') AS flags,
  array_to_string(list_sort(list_distinct(flatten(list(genre_tags)))), '|') AS genre_tags FROM norm GROUP BY 1"""))
def distinct_flag_union(spark, d):
    """Union of array values per venue: distinct values before they meet in one row."""
    rows = norm(spark, d)
    tagged = lambda c: F.transform(c, lambda x: F.struct(F.lit(c).alias("k"), x.alias("x")))
    named = F.concat(tagged("flags"), tagged("genre_tags"))
    values = rows.select("venue_id", F.explode_outer(named).alias("v")).distinct()
    one = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col("v.k") == c, F.col("v.x")))), "|").alias(c)
    return values.groupBy("venue_id").agg(one("flags"), one("genre_tags"))


@query("snapshot_meta", with_norm(f"""SELECT TIMESTAMP '{AS_OF} 00:00:00' AS last_updated, count(*) AS total, 'gigmesh' AS generated_by FROM norm"""))
def snapshot_meta(spark, d):
    from gigmesh.sources.listings import snapshot_meta as meta

    return meta(norm(spark, d), AS_OF)


@query("top50_per_week", with_norm(f"""SELECT week_num, position, seq, name, start_date, venue_name, venue_location, performers FROM (
  SELECT {WEEK} AS week_num, CAST(row_number() OVER (PARTITION BY {WEEK} ORDER BY date, seq) AS INT) AS position, seq,
    array_to_string(bands[1:3], ', ') || ' at ' || venue_name AS name, strftime(date, '%Y-%m-%d') AS start_date, venue_name, venue_location,
    array_to_string(bands, '|') AS performers FROM norm WHERE {WEEK} < 43) WHERE position <= 50"""))
def top50_per_week(spark, d):
    items = views.structured_events(norm(spark, d), AS_OF)
    return items.withColumn("performers", F.array_join("performers", "|"))


@query("view_by_date", with_norm(f"""SELECT seq, {WEEK} AS week_num, {label_sql(WEEK)} AS week_label, CAST(date AS DATE) AS day,
  strftime(date, '%a %b %-d') AS day_label, lower(venue_name) AS venue_key, {time_minutes_sql('"time"', 1200, chr(92) + 'd{1,2}')} AS time_key,
  {LINE} AS line, list_contains({sql_list(fx.CHAIN_VENUES)}, venue_id) AS is_chain,
  (coalesce(price_advance, -1) = 0 OR coalesce(price_door, -1) = 0) AS is_free
  FROM norm WHERE {WEEK} < 43 AND CAST(date AS DATE) >= {WEEK0}"""))
def view_by_date(spark, d):
    return views.by_date(norm(spark, d), AS_OF)


@query("by_date_numbered", with_norm(f"""SELECT seq, row_number() OVER (ORDER BY week_num, day, venue_key, time_key, seq) AS position,
  row_number() OVER (PARTITION BY day ORDER BY venue_key, time_key, seq) AS day_position FROM (
  SELECT seq, {WEEK} AS week_num, CAST(date AS DATE) AS day, lower(venue_name) AS venue_key,
    {time_minutes_sql('"time"', 1200, chr(92) + 'd{1,2}')} AS time_key FROM norm WHERE {WEEK} < 43 AND CAST(date AS DATE) >= {WEEK0})"""))
def by_date_numbered(spark, d):
    """The reading order of the date view as positions, over all and within each day."""
    return views.by_date_numbered(norm(spark, d), AS_OF).select("seq", "position", "day_position")


@query("view_by_band", with_norm(f"""SELECT * FROM (WITH {BANDNAMES} SELECT band_key, display_name, {band_anchor('display_name')} AS anchor, lower(display_name) AS sort_key,
   seq, date, strftime(date, '%b %-d') AS day_label, {esc('venue_name')} || ', ' || {esc('venue_location')} AS venue,
   {venue_anchor('venue_id')} AS venue_anchor, {DETAILS} AS details, {FLAGS} AS flag_text, CAST(NULL AS VARCHAR) AS source_url
   FROM (SELECT *, {BAND_KEY} AS band_key FROM ({EXPLODED}) WHERE length(band) > 1) JOIN bandnames USING (band_key))"""))
def view_by_band(spark, d):
    return views.by_band(norm(spark, d))


@query("view_by_venue", with_norm(f"""SELECT * FROM (WITH {VENUENAMES} SELECT venue_id, {esc('v.venue_name')} || ', ' || {esc('v.venue_location')} AS heading,
   {venue_anchor('venue_id')} AS anchor, regexp_replace(lower(v.venue_name), '^the ', '') AS sort_key, seq, date,
   strftime(date, '%b %-d') AS day_label, {BAND_LINKS} AS band_links, {DETAILS} AS details, {FLAGS} AS flag_text,
   CAST(NULL AS VARCHAR) AS source_url FROM norm JOIN venuenames v USING (venue_id))"""))
def view_by_venue(spark, d):
    return views.by_venue(norm(spark, d))


@query("view_index", with_norm(f"""SELECT * FROM (WITH {BANDNAMES}, {VENUENAMES}
  SELECT 'week' AS section, format('{{:03d}}', w) AS sort_key, {label_sql('w')} AS label, 'by-date.' || w || '.html' AS target
    FROM (SELECT CAST(unnest(range(43)) AS INT) AS w)
  UNION ALL SELECT 'band', lower(display_name), {esc('display_name')}, 'by-band.html#' || {band_anchor('display_name')} FROM bandnames
  UNION ALL SELECT 'venue', regexp_replace(lower(f), '^the ', ''), {esc('f')}, 'by-club.html#' || {venue_anchor('venue_id')}
    FROM (SELECT *, venue_name || ', ' || venue_location AS f FROM venuenames))"""))
def view_index(spark, d):
    return views.index(norm(spark, d), AS_OF)


DIR_SQL = """dirv AS (SELECT s_suppkey AS k, 's' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'the ' ELSE '' END || s_name AS name, n_name AS location,
   CASE WHEN s_suppkey % 3 = 0 THEN 'RI' END AS state, 'Street ' || s_suppkey AS address, CASE WHEN s_suppkey % 2 = 0 THEN '555-' || s_suppkey END AS phone,
   CASE WHEN s_suppkey % 4 <> 0 THEN 'https://v' || s_suppkey || '.example' END AS website, CAST(s_suppkey * 10 AS INT) AS capacity,
   CASE WHEN s_suppkey % 7 = 0 THEN 'closed' END AS status, CASE WHEN s_suppkey % 14 = 0 THEN 2020 END AS closed_year
   FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def directory_venues(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), C("s_nationkey") == C("n_nationkey"))
    k = C("s_suppkey")
    return s.select(
        F.concat(F.lit("s"), k).alias("id"),
        F.concat(F.when(k % 5 == 0, F.lit("the ")).otherwise(F.lit("")), "s_name").alias("name"),
        C("n_name").alias("location"), F.when(k % 3 == 0, F.lit("RI")).alias("state"),
        F.concat(F.lit("Street "), k).alias("address"), F.when(k % 2 == 0, F.concat(F.lit("555-"), k)).alias("phone"),
        F.when(k % 4 != 0, F.concat(F.lit("https://v"), k, F.lit(".example"))).alias("website"),
        (k * 10).cast("int").alias("capacity"), F.when(k % 7 == 0, F.lit("closed")).alias("status"),
        F.when(k % 14 == 0, F.lit(2020)).alias("closed_year"), F.lit(None).cast("string").alias("notes"),
    )


@query("venue_directory", f"""WITH {DIR_SQL} SELECT CAST(row_number() OVER (ORDER BY lower(name), id) AS INT) AS position, id,
  CASE WHEN status = 'closed' AND closed_year IS NOT NULL THEN name || ' (Closed ' || closed_year || ')' WHEN status = 'closed' THEN name || ' (Closed)' ELSE name END AS display_name,
  CASE WHEN state IS NOT NULL THEN location || ', ' || state ELSE location END AS place, address,
  concat_ws(' | ', phone, CASE WHEN capacity <> 0 AND status IS DISTINCT FROM 'closed' THEN 'Capacity: ' || capacity END) AS details,
  CASE WHEN status IS DISTINCT FROM 'closed' THEN website END AS website, CAST(NULL AS VARCHAR) AS notes, status IS NOT DISTINCT FROM 'closed' AS closed FROM dirv""")
def venue_directory(spark, d):
    return views.directory(directory_venues(spark, d))


@query("structured_venues", f"""WITH {DIR_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY lower(name), id) AS position FROM dirv)
  SELECT CAST(position AS INT) AS position, '{{"@type":"ListItem","position":' || position || ',"item":{{"@type":"MusicVenue","name":"' || name || '","address":{{"@type":"PostalAddress","streetAddress":"'
    || address || '","addressLocality":"' || location || '"}}' || CASE WHEN website IS NULL THEN '' ELSE ',"url":"' || website || '"' END || '}}}}' AS item FROM p""")
def structured_venues(spark, d):
    return views.structured_venues(directory_venues(spark, d))


@query("venue_totals", f"WITH {DIR_SQL} SELECT count(*) AS venues, count(*) FILTER (WHERE status IS NULL) AS active, count(*) FILTER (WHERE status = 'closed') AS closed FROM dirv")
def venue_totals(spark, d):
    return views.venue_totals(directory_venues(spark, d))


@query("active_venues", f"WITH {DIR_SQL} SELECT id FROM dirv WHERE status IS NULL")
def active_venues(spark, d):
    return filters.active(directory_venues(spark, d)).select("id")


_fixed = ", ".join(f"('{p}', '{r}', '{c}')" for p, r, c in fx.STATIC_PAGES)


@query("sitemap", with_norm(f"""SELECT 'https://example.com/' || page AS loc, '{AS_OF}' AS lastmod, changefreq, priority, listings FROM (
  SELECT * , CAST(NULL AS BIGINT) AS listings FROM (VALUES {_fixed}) v(page, priority, changefreq)
  UNION ALL SELECT 'by-date.' || w || '.html', CASE WHEN w < 4 THEN '0.9' WHEN w < 12 THEN '0.7' ELSE '0.5' END,
    CASE WHEN w < 4 THEN 'daily' ELSE 'weekly' END, coalesce(n, 0) FROM (SELECT CAST(unnest(range(43)) AS INT) AS w)
    LEFT JOIN (SELECT {WEEK} AS k, count(*) AS n FROM norm GROUP BY 1) ON k = w)"""))
def sitemap(spark, d):
    return views.sitemap(norm(spark, d), AS_OF)


SEEN = "seq % 10 <> 0"


@query("digest", with_norm(f"""SELECT CASE WHEN seq IS NOT NULL THEN 'new' END AS mode, seq, id, date, strftime(date, '%a %b %d') AS day_label, venue_name,
  venue_location, array_to_string(bands, ', ') AS artists FROM norm WHERE date >= DATE '{AS_OF}'
  AND id NOT IN (SELECT id FROM norm WHERE {SEEN} AND date >= DATE '{AS_OF}')"""))
def digest(spark, d):
    current = filters.not_past(norm(spark, d), AS_OF)
    return views.digest(current, current.where(SEEN), AS_OF)


@query("digest_upcoming", with_norm(f"""SELECT 'upcoming' AS mode, seq, id, date, strftime(date, '%a %b %d') AS day_label, venue_name,
  venue_location, array_to_string(bands, ', ') AS artists FROM norm WHERE date >= DATE '{AS_OF}' AND date < DATE '{AS_OF}' + 4"""))
def digest_upcoming(spark, d):
    current = filters.not_past(norm(spark, d), AS_OF)
    return views.digest(current, current, AS_OF)


@query("digest_subject", with_norm(f"""SELECT 'new' AS mode, n AS shown, t AS total,
  'listings: ' || n || CASE WHEN n = 1 THEN ' new show' ELSE ' new shows' END || ' added, ' || format('{{:,}}', t) || ' total (Jan 01)' AS subject,
  n || CASE WHEN n = 1 THEN ' new show' ELSE ' new shows' END || ' added &middot; ' || format('{{:,}}', t) || ' total shows listed' AS subtitle FROM (
  SELECT count(*) FILTER (WHERE id NOT IN (SELECT id FROM norm WHERE {SEEN} AND date >= DATE '{AS_OF}')) AS n, count(*) AS t
  FROM norm WHERE date >= DATE '{AS_OF}')"""))
def digest_subject(spark, d):
    current = cut_lineage(filters.not_past(norm(spark, d), AS_OF).select("seq", "id", "date", "venue_name", "venue_location", "bands"))
    return views.digest_subject(views.digest(current, current.where(SEEN), AS_OF), current, AS_OF)

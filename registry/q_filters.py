"""Filters and relevance labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import text
from gigmesh.operators import filters
from gigmesh.operators.normalize import normalize_listings
from gigmesh.runtime import cut_lineage
from gigmesh.sources.dated_text import BAND_LOOK_ALIKES, BAND_STOP_WORDS, valid_bands
from gigmesh.sources.tables import AS_OF, listings
from registry.base import lcs_sql, query, sql_list, with_norm

C = F.col
NOW = f"{AS_OF} 15:30:00"
INCLUDE, EXCLUDE, PRIORITY = ["economy"], ["standard"], ["red bolts", "hot gear"]

PRIO = f""", bn AS (SELECT DISTINCT unnest(bands) AS b FROM norm), pb AS (SELECT unnest({sql_list(PRIORITY)}) AS p),
  hit AS MATERIALIZED (SELECT DISTINCT b FROM bn, pb WHERE 200 * {lcs_sql('lower(b)', 'p')} > 90 * (length(b) + length(p))),
  prio AS MATERIALIZED (SELECT DISTINCT seq FROM (SELECT seq, unnest(bands) AS b FROM norm) JOIN hit USING (b)),
  tagged AS (SELECT *, list_filter(list_transform(genre_tags, lambda t: CASE WHEN contains(t, 'economy') THEN 1 WHEN contains(t, 'standard') THEN 0 ELSE -1 END),
     lambda v: v >= 0)[1] AS verdict FROM norm)"""


def norm(spark, d):
    return normalize_listings(listings(spark, d))


@query("not_past", with_norm(f"SELECT seq, date FROM norm WHERE date >= DATE '{AS_OF}'"))
def not_past(spark, d):
    return filters.not_past(norm(spark, d), AS_OF).select("seq", "date")


def _window(mode):
    at = f"TIMESTAMP '{NOW}'"
    start = {"from_now": at, "from_today": f"date_trunc('day', {at})", "from_yesterday": f"{at} - INTERVAL 1 DAY", "open": f"date_trunc('day', {at})"}[mode]
    end = "" if mode == "open" else f" AND date <= {at} + INTERVAL {7 * fx.WEEKS_AHEAD} DAY"
    return f"SELECT '{mode}' AS mode, seq FROM norm WHERE date >= {start}{end}"


MODES = ["from_now", "from_today", "from_yesterday", "open"]


@query("lookahead", with_norm(" UNION ALL ".join(_window(m) for m in MODES)))
def lookahead(spark, d):
    rows = norm(spark, d).select("seq", "date")
    out = None
    for mode in MODES:
        part = filters.lookahead(rows, NOW, mode).select(F.lit(mode).alias("mode"), "seq")
        out = part if out is None else out.unionByName(part)
    return out


@query("week_window", with_norm(f"""SELECT seq FROM norm WHERE floor(date_diff('day', date_trunc('week', DATE '{AS_OF}'), date_trunc('week', date)) / 7) < 43"""))
def week_window(spark, d):
    return filters.week_window(norm(spark, d), AS_OF).select("seq")


@query("upcoming", with_norm(f"SELECT seq, date FROM norm WHERE date >= DATE '{AS_OF}' AND date < DATE '{AS_OF}' + 4"))
def upcoming(spark, d):
    return filters.upcoming(norm(spark, d), AS_OF).select("seq", "date")


@query("priority_bands", with_norm(PRIO + " SELECT b AS band FROM hit"))
def priority_bands(spark, d):
    return filters.priority_names(norm(spark, d), PRIORITY)


@query("genre_strict", with_norm(PRIO + " SELECT seq FROM tagged WHERE seq IN (SELECT seq FROM prio) OR verdict = 1"))
def genre_strict(spark, d):
    return filters.genre_filter(norm(spark, d), True, INCLUDE, EXCLUDE, PRIORITY).select("seq")


@query("genre_lenient", with_norm("SELECT seq FROM norm"))
def genre_lenient(spark, d):
    return filters.genre_filter(norm(spark, d), False).select("seq")




@query("genre_reason", with_norm(PRIO + f""" SELECT seq, CASE WHEN seq IN (SELECT seq FROM prio) THEN 'priority_band'
  WHEN len(list_filter(genre_tags, lambda t: contains(t, 'economy'))) > 0 THEN 'genre_tag'
  WHEN regexp_matches(lower(array_to_string(bands, ' ')), '{"|".join(dict.fromkeys(fx.BAND_KEYWORDS))}') THEN 'band_keyword'
  WHEN list_contains({sql_list(fx.GENRE_VENUES_PRIMARY + fx.GENRE_VENUES_FRIENDLY)}, lower(venue_id)) THEN 'venue'
  WHEN source = 'scrape:safe_in_a_crowd' THEN 'source' ELSE 'default' END AS reason FROM norm"""))
def genre_reason(spark, d):
    return filters.genre_reason(norm(spark, d), INCLUDE, PRIORITY).select("seq", "reason")


@query("required_fields", with_norm("SELECT seq, id FROM norm"))
def required_fields(spark, d):
    """Rows without a performer leave, the others stay."""
    return norm(spark, d).select("seq", "id")


@query("valid_bands", with_norm(f"""SELECT seq, array_to_string(list_filter(list_transform(list_concat(bands, ['with', '$' || seq, '21+', '9pm', 'at ' || venue_name, 'X', venue_location]),
    lambda b: trim(b)), lambda b: length(b) > 1 AND NOT list_contains({sql_list(BAND_STOP_WORDS)}, lower(b))
    AND NOT regexp_matches(b, '{BAND_LOOK_ALIKES}')), '|') AS bands FROM norm"""))
def valid(spark, d):
    extra = F.array(
        F.lit("with"), F.concat(F.lit("$"), "seq"), F.lit("21+"), F.lit("9pm"), F.concat(F.lit("at "), "venue_name"), F.lit("X"), C("venue_location")
    )
    return norm(spark, d).select("seq", F.array_join(valid_bands(F.concat("bands", extra)), "|").alias("bands"))


def _any(words, c):
    return f"len(list_filter({sql_list(words)}, lambda w: contains({c}, w))) > 0"


@query("music_label", f"""SELECT doc_id, CASE WHEN {_any(fx.MUSIC_WORDS, 'lower(text)')} THEN 'music'
  WHEN {_any(fx.OTHER_EVENT_WORDS, 'lower(text)')} THEN 'other' ELSE 'unknown' END AS label FROM documents""")
def music_label(spark, d):
    from gigmesh.sources.tables import table

    return table(spark, d, "documents").select("doc_id", filters.music_label(C("text")).alias("label"))


@query("stage_accounting", with_norm(PRIO + f""" SELECT 'date' AS stage, (SELECT count(*) FROM norm) AS before,
    (SELECT count(*) FROM norm WHERE date >= DATE '{AS_OF}') AS after, (SELECT count(*) FROM norm WHERE date < DATE '{AS_OF}') AS removed
  UNION ALL SELECT 'genre', (SELECT count(*) FROM norm), (SELECT count(*) FROM tagged WHERE seq IN (SELECT seq FROM prio) OR verdict = 1),
    (SELECT count(*) FROM tagged WHERE NOT (seq IN (SELECT seq FROM prio) OR coalesce(verdict, 0) = 1))"""))
def stage_accounting(spark, d):
    from gigmesh.operators.resolve import stage_counts

    rows = cut_lineage(norm(spark, d).select("seq", "date", "bands", "genre_tags"))
    date = stage_counts(rows, filters.not_past(rows, AS_OF)).select(F.lit("date").alias("stage"), "*")
    genre = stage_counts(rows, filters.genre_filter(rows, True, INCLUDE, EXCLUDE, PRIORITY)).select(F.lit("genre").alias("stage"), "*")
    return date.unionByName(genre)


@query("free_and_chain", with_norm(f"""SELECT seq, (coalesce(price_advance, -1) = 0 OR coalesce(price_door, -1) = 0) AS is_free,
  list_contains({sql_list(fx.CHAIN_VENUES)}, venue_id) AS is_chain FROM norm"""))
def free_and_chain(spark, d):
    return norm(spark, d).select(
        "seq", text.is_free(C("price_advance"), C("price_door")).alias("is_free"), C("venue_id").isin(fx.CHAIN_VENUES).alias("is_chain")
    )

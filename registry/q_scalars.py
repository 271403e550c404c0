"""Scalar column functions over the raw or normalized listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import temporal, text
from gigmesh.operators import normalize
from gigmesh.sources.tables import AS_OF, listings, table
from registry.base import (
    ID_HEAD, id_sql, line_slug, location_sql, normalize_age_sql, normalize_band_sql, normalize_time_sql,
    price_display_sql, query, resolver_key_sql, sql_case_map, time_minutes_sql, venue_rule_sql, with_raw,
)

C = F.col


def joined(c):
    return F.array_join(c, "|")


@query("stable_id", with_raw(f"""SELECT seq, id, {ID_HEAD.format(h="'The X feat. Y - Tour ' || seq || ' (live)'")} AS head,
  {id_sql(bands="['The X and Y']")} AS id_cut FROM raw"""))
def stable_id(spark, d):
    return listings(spark, d).select(
        "seq", "id",
        text.id_headliner(F.concat(F.lit("The X feat. Y - Tour "), "seq", F.lit(" (live)"))).alias("head"),
        text.stable_id(C("date"), C("venue_id"), F.array(F.lit("The X and Y")), C("time")).alias("id_cut"),
    )


@query("display_columns", with_raw(f"""SELECT seq, strftime(date, '%a') AS day_of_week, strftime(date, '%a %b %-d') AS date_display,
  {price_display_sql()} AS price_display, coalesce(bands[1], '') AS headliner,
  array_to_string(bands[2:], '|') AS support,
  (coalesce(price_advance, -1) = 0 OR coalesce(price_door, -1) = 0) AS is_free FROM raw"""))
def display_columns(spark, d):
    return listings(spark, d).select(
        "seq",
        F.date_format("date", "EEE").alias("day_of_week"),
        temporal.format_date(C("date")).alias("date_display"),
        text.price_display(C("price_advance"), C("price_door")).alias("price_display"),
        F.coalesce(F.try_element_at("bands", F.lit(1)), F.lit("")).alias("headliner"),
        joined(F.slice("bands", 2, 1 << 30)).alias("support"),
        text.is_free(C("price_advance"), C("price_door")).alias("is_free"),
    )


SPLIT_SQL = "b"
for _sep in fx.BAND_SEPARATORS:
    SPLIT_SQL = f"replace({SPLIT_SQL}, '{_sep}', ', ')"


@query("clean_split_bands", with_raw(f"""SELECT seq, array_to_string(list_filter(list_transform(string_split({SPLIT_SQL}, ','),
   lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 1), '|') AS parts,
  trim(regexp_replace(b, '\\s+', ' ', 'g')) AS cleaned
  FROM (SELECT seq, replace(array_to_string(bands, chr(1)), chr(1), CASE seq % 7 WHEN 0 THEN ' w/ ' WHEN 1 THEN ' with ' WHEN 2 THEN ' and '
     WHEN 3 THEN '  + ' WHEN 4 THEN ' / ' WHEN 5 THEN ' | ' ELSE ', ' END) AS b FROM raw)"""))
def clean_split_bands(spark, d):
    sep = F.element_at(
        F.array(*[F.lit(s) for s in (" w/ ", " with ", " and ", "  + ", " / ", " | ", ", ")]),
        (C("seq") % 7).cast("int") + 1,
    )
    billed = listings(spark, d).select("seq", F.array_join("bands", "\x01").alias("b0"), sep.alias("sep"))
    billed = billed.select("seq", F.replace("b0", F.lit("\x01"), C("sep")).alias("b"))
    return billed.select(
        "seq", joined(text.split_bands(C("b"))).alias("parts"), text.clean_text(C("b")).alias("cleaned")
    )


PRICE_TEXT_SQL = (
    "CASE seq % 6 WHEN 0 THEN '$' || price_advance || '/$' || (price_advance + 3) WHEN 1 THEN 'Tickets $' || price_advance || '.50' "
    "WHEN 2 THEN 'FREE show' WHEN 3 THEN '$' || price_advance || ' adv / $' || (price_advance + 5) || ' door' "
    "WHEN 4 THEN 'no cover' ELSE 'tba' END"
)


@query("parse_price_text", with_raw(f"""SELECT seq, p,
  CASE WHEN contains(lower(p), 'free') THEN 0 ELSE CAST(trunc(CAST(nums[1] AS DOUBLE)) AS INT) END AS adv,
  CASE WHEN contains(lower(p), 'free') THEN 0 ELSE CAST(trunc(CAST(coalesce(nums[2], nums[1]) AS DOUBLE)) AS INT) END AS door,
  TRY_CAST(regexp_extract(p, '\\$(\\d+)(?:[/-]\\$?(\\d+))?', 1) AS INT) AS line_adv,
  TRY_CAST(regexp_extract(p, '\\$(\\d+)(?:[/-]\\$?(\\d+))?', 2) AS INT) AS line_door,
  CASE WHEN regexp_matches(lower(p), 'free|no cover|donation|pwyc') THEN 0 ELSE
    coalesce(TRY_CAST(regexp_extract(p, '\\$(\\d+)(?:\\s*/\\s*\\$?(\\d+))?', 2) AS INT),
             TRY_CAST(regexp_extract(p, '\\$(\\d+)', 1) AS INT)) END AS pair_door,
  CASE WHEN contains(string_split(lower(p), '$')[1], 'free') THEN 0 ELSE
    coalesce(TRY_CAST(regexp_extract(lower(p), '\\$(\\d+)\\s*(?:at the door|door|dos)', 1) AS INT),
             TRY_CAST(regexp_extract(lower(p), '\\$(\\d+)\\s*(?:in advance|adv)', 1) AS INT),
             TRY_CAST(regexp_extract(lower(p), '\\$(\\d+)', 1) AS INT)) END AS word_door
  FROM (SELECT seq, p, regexp_extract_all(lower(p), '\\$?(\\d+(?:\\.\\d{{2}})?)', 1) AS nums
        FROM (SELECT seq, {PRICE_TEXT_SQL} AS p FROM raw))"""))
def parse_price_text(spark, d):
    a = C("price_advance")
    p = (
        F.when(C("seq") % 6 == 0, F.concat(F.lit("$"), a, F.lit("/$"), a + 3))
        .when(C("seq") % 6 == 1, F.concat(F.lit("Tickets $"), a, F.lit(".50")))
        .when(C("seq") % 6 == 2, F.lit("FREE show"))
        .when(C("seq") % 6 == 3, F.concat(F.lit("$"), a, F.lit(" adv / $"), a + 5, F.lit(" door")))
        .when(C("seq") % 6 == 4, F.lit("no cover"))
        .otherwise(F.lit("tba"))
    )
    df = listings(spark, d).select("seq", p.alias("p"))
    scraped, line = text.parse_price(C("p")), text.parse_price(C("p"), "line")
    return df.select(
        "seq", "p", scraped["advance"].alias("adv"), scraped["door"].alias("door"),
        line["advance"].alias("line_adv"), line["door"].alias("line_door"),
        text.parse_price(C("p"), "free_pair")["door"].alias("pair_door"),
        text.parse_price(C("p"), "words")["door"].alias("word_door"),
    )


CLOCK_TEXT_SQL = (
    "CASE seq % 6 WHEN 0 THEN 'Doors ' || (seq % 12 + 1) || ':30 PM' WHEN 1 THEN (seq % 24) || ':15' WHEN 2 THEN 'late' "
    "WHEN 3 THEN (seq % 12 + 1) || 'am' WHEN 4 THEN '0:45' ELSE (seq % 12 + 1) || ':00 pm' END"
)
_h = "TRY_CAST(regexp_extract(lower(t), '(\\d{1,2})(?::(\\d{2}))?\\s*(am|pm)?', 1) AS INT)"
_s = "regexp_extract(lower(t), '(\\d{1,2})(?::(\\d{2}))?\\s*(am|pm)?', 3)"
_m2 = "regexp_extract(lower(t), '(\\d{1,2})(?::(\\d{2}))?\\s*(am|pm)', %d)"


@query("parse_time_text", with_raw(f"""SELECT seq, t,
  CASE WHEN {_h} IS NULL THEN '8pm' WHEN {_h} > 12 THEN ({_h} - 12) || 'pm' WHEN {_h} = 0 THEN '12am'
       ELSE {_h} || CASE WHEN {_s} = '' THEN 'pm' ELSE {_s} END END AS scraped,
  CASE WHEN {_m2 % 3} = '' THEN '8pm' ELSE {_m2 % 1} || CASE WHEN {_m2 % 2} NOT IN ('', '00') THEN ':' || {_m2 % 2} ELSE '' END
       || {_m2 % 3} END AS with_minutes,
  {normalize_time_sql('t')} AS normalized
  FROM (SELECT seq, {CLOCK_TEXT_SQL} AS t FROM raw)"""))
def parse_time_text(spark, d):
    s = C("seq")
    t = (
        F.when(s % 6 == 0, F.concat(F.lit("Doors "), s % 12 + 1, F.lit(":30 PM")))
        .when(s % 6 == 1, F.concat(s % 24, F.lit(":15")))
        .when(s % 6 == 2, F.lit("late"))
        .when(s % 6 == 3, F.concat(s % 12 + 1, F.lit("am")))
        .when(s % 6 == 4, F.lit("0:45"))
        .otherwise(F.concat(s % 12 + 1, F.lit(":00 pm")))
    )
    df = listings(spark, d).select("seq", t.alias("t"))
    return df.select(
        "seq", "t", temporal.parse_time(C("t")).alias("scraped"),
        temporal.parse_time_minutes(C("t")).alias("with_minutes"),
        temporal.normalize_time(C("t")).alias("normalized"),
    )


@query("time_minutes", with_raw(f"""SELECT seq, {time_minutes_sql('"time"')} AS minutes,
  {time_minutes_sql('"time"', 1200, '\\d{1,2}')} AS sort_key FROM raw"""))
def time_minutes(spark, d):
    return listings(spark, d).select(
        "seq", temporal.time_to_minutes(C("time")).alias("minutes"), temporal.time_sort_key(C("time")).alias("sort_key")
    )


@query("normalize_age", with_raw(f"""SELECT seq, {normalize_age_sql('age_requirement')} AS age,
  CASE WHEN contains(lower(age_requirement), 'all age') OR contains(lower(age_requirement), 'a/a') OR lower(age_requirement) = 'aa'
    THEN 'a/a' WHEN contains(age_requirement, '21') THEN '21+' WHEN contains(age_requirement, '18') THEN '18+' ELSE 'a/a' END AS scraped,
  CASE WHEN contains(age_requirement, '21+') THEN '21+' WHEN contains(age_requirement, '18+') THEN '18+'
    WHEN contains(age_requirement, '16+') THEN '16+' ELSE 'a/a' END AS grammar FROM raw"""))
def normalize_age(spark, d):
    a = C("age_requirement")
    return listings(spark, d).select(
        "seq", text.normalize_age(a).alias("age"), text.parse_age(a).alias("scraped"),
        text.parse_age(a, "grammar").alias("grammar"),
    )


BAND_VARIANT_SQL = (
    "list_transform(bands, lambda b: CASE seq % 5 WHEN 0 THEN 'The ' || b WHEN 1 THEN upper(b) WHEN 2 THEN ' ' || b || ' Band' "
    "WHEN 3 THEN 'the the ' || b ELSE b END)"
)


@query("normalize_bands", with_raw(f"""SELECT seq, array_to_string(list_transform({BAND_VARIANT_SQL},
    lambda b: CASE WHEN seq % 5 = 1 THEN array_to_string(list_transform(string_split(lower(b), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
      WHEN seq % 5 = 3 THEN 'The ' || b[9:] ELSE {normalize_band_sql('trim(b)')} END), '|') AS bands FROM raw"""))
def normalize_bands(spark, d):
    s = C("seq") % 5
    dirty = F.transform(
        "bands",
        lambda b: F.when(s == 0, F.concat(F.lit("The "), b))
        .when(s == 1, F.upper(b))
        .when(s == 2, F.concat(F.lit(" "), b, F.lit(" Band")))
        .when(s == 3, F.concat(F.lit("the the "), b))
        .otherwise(b),
    )
    return listings(spark, d).select("seq", joined(text.normalize_bands(dirty)).alias("bands"))


@query("normalize_venue", with_raw(f"""SELECT seq,
  coalesce({venue_rule_sql('venue_id', 'venue_name')}, replace(lower(trim(venue_id)), ' ', '_')) AS venue_id,
  {sql_case_map('lower(trim(venue_name))', fx.VENUE_NAMES, 'venue_name')} AS venue_name,
  {resolver_key_sql('venue_name')} AS match_key FROM raw"""))
def normalize_venue(spark, d):
    by_rule = normalize.venue_id_by_rule(C("venue_id"), C("venue_name"))
    return listings(spark, d).select(
        "seq",
        F.coalesce(by_rule, normalize.venue_id_fallback(C("venue_id"))).alias("venue_id"),
        normalize.venue_name(C("venue_name")).alias("venue_name"),
        text.resolver_key(C("venue_name")).alias("match_key"),
    )


CITY_SQL = "CASE seq % 6 WHEN 0 THEN ' Providence' WHEN 1 THEN 'JP' WHEN 2 THEN 'Orlando' WHEN 3 THEN 'derry, nh' WHEN 4 THEN '' ELSE venue_location END"


@query("normalize_location", with_raw(f"SELECT seq, {location_sql('city')} AS location FROM (SELECT seq, {CITY_SQL} AS city FROM raw)"))
def normalize_location(spark, d):
    s = C("seq") % 6
    city = (
        F.when(s == 0, F.lit(" Providence")).when(s == 1, F.lit("JP")).when(s == 2, F.lit("Orlando"))
        .when(s == 3, F.lit("derry, nh")).when(s == 4, F.lit("")).otherwise(C("venue_location"))
    )
    return listings(spark, d).select("seq", normalize.location(city).alias("location"))


_n = "(venue_name || ' & ' || coalesce(bands[1], 'Co., Inc'))"


@query("slugs", with_raw(f"""SELECT seq,
  left(regexp_replace(trim(translate(lower({_n}), '''.,', '')), '\\s+', '_', 'g'), 30) AS api,
  regexp_replace(regexp_replace(lower({_n}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS runs,
  left(regexp_replace(lower({_n}), '[^a-z0-9]', '', 'g'), 20) AS solid,
  {line_slug(_n)} AS line,
  regexp_replace(trim(replace(translate(lower({_n}), '''.,', ''), ' - ', '-')), '\\s+', '-', 'g') AS hyphen,
  regexp_replace({_n}, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS snapshot FROM raw"""))
def slugs(spark, d):
    n = F.concat("venue_name", F.lit(" & "), F.coalesce(F.try_element_at("bands", F.lit(1)), F.lit("Co., Inc")))
    modes = [text.slug(n, m).alias(m) for m in ("api", "runs", "solid", "line", "hyphen")]
    return listings(spark, d).select("seq", *modes, text.snapshot_key(n).alias("snapshot"))


CONTAINS = {"sinclair": "sinclair", "royale": "royale", "middle east": "middleeast", "east": "east", "o'brien": "obriens"}


@query("contains_map", with_raw("SELECT seq, CASE "
    + " ".join(f"WHEN contains(lower(venue_name), '{k.replace(chr(39), chr(39) * 2)}') THEN '{v}'" for k, v in CONTAINS.items())
    + " END AS venue FROM raw"))
def contains_map(spark, d):
    return listings(spark, d).select("seq", text.contains_map(C("venue_name"), CONTAINS).alias("venue"))


def _infer_sql(rule):
    this = f"TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', {AS_OF[:4]}, m, d) AS DATE)"
    nxt = f"TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', {AS_OF[:4]} + 1, m, d) AS DATE)"
    if rule == "none":
        return this
    if rule == "earlier_month":
        return f"CASE WHEN m < 6 THEN {nxt} ELSE {this} END"
    return f"CASE WHEN DATE '1998-06-15' - {this} > {temporal.YEAR_RULES[rule]} THEN {nxt} ELSE {this} END"


RULES = ["two_weeks", "one_week", "one_month", "any_past", "earlier_month", "none"]


@query("infer_year", with_raw("SELECT seq, " + ", ".join(f"{_infer_sql(r)} AS {r}" for r in RULES)
    + ", CAST(date AS DATE) AS parsed FROM (SELECT seq, date, CAST(month(date) AS INT) AS m, CAST(seq % 31 + 1 AS INT) AS d FROM raw)"))
def infer_year(spark, d):
    m, dd = F.month("date"), (C("seq") % 31 + 1).cast("int")
    written = F.when(C("seq") % 2 == 0, F.date_format("date", "EEEE, MMMM d, yyyy")).otherwise(
        F.date_format("date", "M/d/yyyy")
    )
    return listings(spark, d).select(
        "seq", *[temporal.infer_year(m, dd, "1998-06-15", r).alias(r) for r in RULES],
        F.to_date(temporal.parse_date(written)).alias("parsed"),
    )


@query("week_columns", with_raw(f"""SELECT seq, CAST(date_trunc('week', date) AS DATE) AS week_start,
  CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week_end,
  CAST(greatest(0, floor(date_diff('day', date_trunc('week', DATE '{AS_OF}'), date_trunc('week', date)) / 7)) AS INT) AS week_num,
  strftime(CASE WHEN date_trunc('week', date) = date_trunc('week', DATE '{AS_OF}') THEN DATE '{AS_OF}' ELSE date_trunc('week', date) END, '%b %-d')
    || ' - ' || strftime(date_trunc('week', date) + INTERVAL 6 DAY, '%b %-d') AS label,
  strftime(date, '%A, %B %-d, %Y') AS long_date, strftime(date, '%Y-%m-%d') AS iso_date FROM raw"""))
def week_columns(spark, d):
    return listings(spark, d).select(
        "seq", temporal.week_start(C("date")).alias("week_start"), temporal.week_end(C("date")).alias("week_end"),
        temporal.week_number(C("date"), AS_OF).alias("week_num"),
        temporal.adjusted_week_label(C("date"), AS_OF).alias("label"),
        temporal.format_date(C("date"), "long").alias("long_date"),
        temporal.format_date(C("date"), "iso").alias("iso_date"),
    )


@query("timezone_columns", with_raw("""SELECT seq, CAST(date AS TIMESTAMP) AS wall,
  timezone('America/New_York', timezone('UTC', date + INTERVAL (seq % 24) HOUR)) AS eastern FROM raw"""))
def timezone_columns(spark, d):
    iso = F.concat(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    shifted = C("date") + F.make_dt_interval(F.lit(0), (C("seq") % 24).cast("int"))
    return listings(spark, d).select(
        "seq", temporal.strip_tz(iso).alias("wall"), temporal.utc_to_eastern(shifted).alias("eastern")
    )


@query("band_keys_anchors", with_raw("""SELECT seq, band,
  translate(trim(lower(band)), '''.,', '') AS band_key,
  left(regexp_replace(replace(replace(translate(replace(lower(band), ' ', '_'), '''.,', ''), '&', 'and'), '$', 's'), '[^\\p{L}\\p{N}_]', '', 'g'), 40) AS band_anchor,
  left(translate(replace(lower(venue_id), ' ', '_'), '''.,', ''), 30) AS venue_anchor
  FROM (SELECT seq, venue_id, unnest(list_transform(bands, lambda b: b || ' & Mr. $' || venue_name)) AS band FROM raw)"""))
def band_keys_anchors(spark, d):
    names = F.transform("bands", lambda b: F.concat(b, F.lit(" & Mr. $"), C("venue_name")))
    df = listings(spark, d).select("seq", "venue_id", F.explode(names).alias("band"))
    return df.select(
        "seq", "band", text.band_key(C("band")).alias("band_key"), text.band_anchor(C("band")).alias("band_anchor"),
        text.venue_anchor(C("venue_id")).alias("venue_anchor"),
    )


@query("html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_escape(C("html")).alias("escaped"))


@query("unescape_text", """SELECT page_id, html || 'é–’‘€A&amp;lt; ñ &nosuch; ©2' AS text FROM pages""")
def unescape_text(spark, d):
    """Page text encoded here by plain replacement, with references of every kind appended."""
    coded = C("html")
    for raw, reference in (("&", "&#38;"), ("<", "&lt;"), (">", "&#x3E;"), ('"', "&quot;"), ("'", "&apos;"), ("é", "&eacute;"), ("ü", "&#252;"), ("ñ", "&#xF1;")):
        coded = F.replace(coded, F.lit(raw), F.lit(reference))
    tail = F.lit("&eacute;&ndash;&#8217;&#x2018;&#128;&#65;&amp;amp;lt; &ntilde; &nosuch; &copy2")
    return table(spark, d, "pages").select("page_id", text.html_unescape(F.concat(coded, tail)).alias("text"))

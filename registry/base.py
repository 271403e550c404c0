"""Registration helper and the shared pieces of checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the checking statement for the same tables."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_case_map(expr: str, table: dict, default: str) -> str:
    """CASE over a fixed table."""
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def sql_strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^\\s+', ''), '\\s+$', '')"


VENUE_LIST = (
    "['Paradise Rock Club','The Paradise Rock Club - Boston','PARADISE','The Sinclair','Sinclair','Royale',"
    "'Royale Boston','Middle East Upstairs','Middle East - Upstairs','Lizard Lounge','Deep Cuts','O''Brien''s Pub']"
)


def line_slug(expr: str) -> str:
    return f"regexp_replace(regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', '_', 'g')"


# Raw listings, one per order.
RAW = f"""
billing AS (
  SELECT l_orderkey AS k,
         list(p_name ORDER BY l_linenumber, l_partkey, l_suppkey) AS bands,
         list_sort(list_distinct(list(lower(p_type)))) AS genre_tags,
         min(l_suppkey) AS supp
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
raw0 AS (
  SELECT o_orderkey AS seq, CAST(o_orderdate AS TIMESTAMP) AS date,
         {VENUE_LIST}[CAST(coalesce(supp, 0) % 12 AS INT) + 1] AS venue_name,
         n_name AS venue_location,
         coalesce(bands, CAST([] AS VARCHAR[])) AS bands,
         CASE left(o_orderpriority, 1) WHEN '1' THEN '21+' WHEN '2' THEN '18 and over' WHEN '3' THEN 'All Ages'
              WHEN '5' THEN '16+' ELSE '' END AS age_requirement,
         CAST(floor(o_totalprice / 20000) AS INT) AS price_advance,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 20000) AS INT) + 5 END AS price_door,
         ['7pm','8pm','8:30pm','10 PM',''][CAST(o_orderkey % 5 AS INT) + 1] AS "time",
         CASE WHEN o_orderkey % 7 = 0 THEN ['$','@','$'] ELSE CAST([] AS VARCHAR[]) END AS flags,
         CASE o_orderstatus WHEN 'P' THEN 'ticketmaster' WHEN 'F' THEN 'seatgeek'
              WHEN 'O' THEN 'scrape:safe_in_a_crowd' END AS source,
         coalesce(genre_tags, CAST([] AS VARCHAR[])) AS genre_tags
  FROM orders LEFT JOIN billing ON k = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
raw1 AS (SELECT *, {line_slug('venue_name')} AS venue_id FROM raw0)
"""

ID_HEAD = (
    "trim(left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    "lower({h}), '\\s+(ft\\.?|feat\\.?|featuring|w/|with|and|&)\\s+.*$', ''),"
    " '(?i)\\s*[-:]\\s+.*?(tour|live|concert|show|presents|anniversary).*$', ''),"
    " '\\s*[-:]\\s+\\d{{4}}.*$', ''), '\\s*\\([^)]*\\)\\s*', ' ', 'g'),"
    " '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')), 30))"
)


def id_sql(date="date", venue="venue_id", bands="bands", time='"time"') -> str:
    head = ID_HEAD.format(h=f"(CASE WHEN len({bands}) > 0 THEN {bands}[1] ELSE 'unknown' END)")
    return (
        f"left(md5(strftime({date}, '%Y-%m-%d') || '|' || {venue} || '|' || {head} || '|' || "
        f"CASE WHEN coalesce({time}, '') = '' THEN 'tba' ELSE {time} END), 12)"
    )


RAW = RAW + f", raw AS (SELECT *, {id_sql()} AS id FROM raw1)"

from gigmesh import fixed_values as fx  # noqa: E402



def normalize_band_sql(b: str) -> str:
    """Article and suffix removal; the driver tables hold no shouted names."""
    core = f"regexp_replace({b}, '(?i)^(?:the\\s+)?(.+?)(?:\\s+band)?$', '\\1')"
    return "trim(" + sql_case_map(f"lower({core})", fx.BAND_CORRECTIONS, core) + ")"


def normalize_time_sql(t: str) -> str:
    s = f"replace(lower(trim({t})), ' ', '')"
    hour = f"TRY_CAST(regexp_extract({s}, '^(\\d+)', 1) AS INT)"
    body = (
        f"CASE WHEN contains({s}, 'am') OR contains({s}, 'pm') OR {hour} IS NULL THEN {s} "
        f"ELSE CAST(CASE WHEN {hour} < 12 THEN {hour} ELSE {hour} - 12 END AS VARCHAR) || 'pm' END"
    )
    return f"CASE WHEN coalesce({t}, '') = '' THEN '8pm' ELSE replace({body}, ':00', '') END"


def normalize_age_sql(a: str) -> str:
    s = f"lower(trim(coalesce({a}, '')))"
    return (
        f"CASE WHEN contains({s}, 'all') OR {s} = 'aa' THEN 'a/a' WHEN contains({s}, '21') THEN '21+' "
        f"WHEN contains({s}, '18') THEN '18+' ELSE 'a/a' END"
    )


def venue_rule_sql(vid: str, name: str) -> str:
    v, n = f"lower(trim({vid}))", f"lower(trim({name}))"
    return (
        f"CASE WHEN {vid} = '' THEN 'unknown' WHEN contains({v}, 'brien') AND NOT contains({v}, 'sally') THEN 'obriens' "
        f"WHEN contains({v}, 'sallyobrien') OR contains({v}, 'sally_obrien') THEN 'sallyobriens' "
        f"WHEN regexp_matches({v}, 'middle[-_]?east') THEN CASE WHEN contains({n}, 'upstairs') THEN 'middleeast_up' "
        f"WHEN contains({n}, 'downstairs') THEN 'middleeast_down' "
        f"WHEN contains({n}, 'corner') OR contains({n}, 'bakery') THEN 'middleeast_corner' "
        f"WHEN contains({n}, 'zuzu') THEN 'middleeast_zuzu' ELSE 'middleeast' END END"
    )


def location_sql(c: str) -> str:
    home = {**fx.HOME_LOCATIONS, **fx.AWAY_LOCATIONS}
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'Boston' ELSE " + sql_case_map(
        f"lower(trim({c}))", home, f"trim({c})"
    ) + " END"


# Normalized listings without a venue registry.
NORM = RAW + f""", norm0 AS (
  SELECT * REPLACE (list_filter(list_transform(bands, lambda b: {normalize_band_sql('b')}), lambda b: b <> '') AS bands)
  FROM raw),
norm AS (
  SELECT * REPLACE (
    coalesce({venue_rule_sql('venue_id', 'venue_name')}, replace(lower(trim(venue_id)), ' ', '_')) AS venue_id,
    {sql_case_map('lower(trim(venue_name))', fx.VENUE_NAMES, 'venue_name')} AS venue_name,
    {location_sql('venue_location')} AS venue_location,
    {normalize_time_sql('"time"')} AS "time",
    {normalize_age_sql('age_requirement')} AS age_requirement,
    list_sort(list_distinct(flags)) AS flags)
  FROM norm0 WHERE len(bands) > 0)
"""


def with_raw(body: str) -> str:
    return f"WITH {RAW} {body}"


def with_norm(body: str) -> str:
    return f"WITH {NORM} {body}"


def resolver_key_sql(c: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        f"trim(lower({c})), '^the\\s+', ''), ',\\s*the$', ''),"
        " '(?i)\\s*[-–]\\s*(boston|cambridge|somerville|brookline|allston|brighton).*$', ''),"
        " '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    )


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence length, one bit per character of ``a`` (under 100 characters)."""
    ones = f"((1::HUGEINT << length({a})) - 1)"
    masks = (
        f"list_transform(range(length({b})), lambda j: coalesce(list_sum(list_transform(range(length({a})), "
        f"lambda i: CASE WHEN {a}[i + 1] = {b}[j + 1] THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT, "
        f"0::HUGEINT))"
    )
    step = f"lambda s, m: ((s + (s & m)) | (s - (s & m))) & {ones}"
    last = f"list_reduce({masks}, {step}, {ones})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({last}) END)"


def time_minutes_sql(t: str, default: int = -1, digits: str = "\\d+") -> str:
    low = f"lower(trim(coalesce({t}, '')))"
    p = f"'^({digits})(?::(\\d+))?\\s*(am|pm)?'"
    h = f"TRY_CAST(regexp_extract({low}, {p}, 1) AS INT)"
    m = f"coalesce(TRY_CAST(regexp_extract({low}, {p}, 2) AS INT), 0)"
    s = f"regexp_extract({low}, {p}, 3)"
    return (
        f"coalesce(CASE WHEN {s} = 'pm' AND {h} <> 12 THEN {h} + 12 WHEN {s} = 'am' AND {h} = 12 THEN 0 "
        f"ELSE {h} END * 60 + {m}, {default})"
    )


def times_similar_sql(a: str, b: str) -> str:
    ma, mb = time_minutes_sql(a), time_minutes_sql(b)
    return f"(CASE WHEN {ma} < 0 OR {mb} < 0 THEN lower({a}) = lower({b}) ELSE abs({ma} - {mb}) <= 60 END)"


def price_display_sql(a: str = "price_advance", d: str = "price_door") -> str:
    return (
        f"CASE WHEN coalesce({a},0) <> 0 AND coalesce({d},0) <> 0 THEN '$' || {a} || '/$' || {d} "
        f"WHEN coalesce({a},0) <> 0 THEN '$' || {a} WHEN coalesce({d},0) <> 0 THEN '$' || {d} ELSE '' END"
    )

"""Structured payloads to listings: two JSON APIs, JSON-LD, embedded JSON, iCal, RSS.

Every job takes one row per payload with ``seq`` and a text column, and works with
JVM-side JSON, regular-expression and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import temporal, text
from gigmesh.functions.text import blank, strip
from gigmesh.runtime import computed_once
from gigmesh.schema import as_listings, no_strings, place

C = F.col

# Payload shapes, tables and patterns.
API_A = """name STRING, url STRING, info STRING, pleaseNote STRING,
  dates STRUCT<status: STRUCT<code: STRING>, start: STRUCT<localDate: STRING, localTime: STRING>>,
  _embedded STRUCT<venues: ARRAY<STRUCT<id: STRING, name: STRING, city: STRUCT<name: STRING>>>, attractions: ARRAY<STRUCT<name: STRING>>>,
  priceRanges ARRAY<STRUCT<min: DOUBLE, max: DOUBLE>>,
  classifications ARRAY<STRUCT<genre: STRUCT<name: STRING>, subGenre: STRUCT<name: STRING>>>"""
API_B = """datetime_local STRING, datetime_utc STRING, title STRING, short_title STRING, url STRING, score DOUBLE,
  venue STRUCT<id: STRING, name: STRING, city: STRING>,
  performers ARRAY<STRUCT<name: STRING, genres: ARRAY<STRUCT<name: STRING>>>>,
  stats STRUCT<lowest_price: DOUBLE, highest_price: DOUBLE>"""
JSONLD = "ARRAY<STRUCT<`@type`: STRING, name: STRING, startDate: STRING, url: STRING, location: STRING, offers: STRING, performer: STRING>>"
EMBEDDED = """MAP<STRING, STRUCT<title: STRING, date_and_time: STRING, show_string: STRING, cost: STRING, cost_member: STRING,
  permalink: STRING, sold_out: STRING>>"""
DROPPED_STATUS = ["cancelled", "postponed", "rescheduled"]
JSONLD_TYPES = ["Event", "MusicEvent", "Festival"]
API_B_HIGH_DEMAND = 0.7
API_B_VENUES = {
    "house-of-blues-boston": "hob_boston",
    "citizens-house-of-blues-boston": "hob_boston",
    "paradise-rock-club": "paradise",
    "royale-boston": "royale",
    "royale---boston": "royale",
    "the-sinclair": "sinclair",
    "the-sinclair---cambridge": "sinclair",
    "brighton-music-hall": "brighton",
    "middle-east-cambridge": "middleeast",
    "middle-east---upstairs": "middleeast_up",
    "middle-east-downstairs": "middleeast_down",
    "middle-east---downstairs": "middleeast_down",
    "orpheum-theatre-boston": "orpheum",
    "orpheum-theatre---boston": "orpheum",
    "roadrunner-boston": "roadrunner",
    "roadrunner---boston": "roadrunner",
    "td-garden": "tdgarden",
    "fenway-park": "fenway",
    "blue-hills-bank-pavilion": "pavilion",
    "leader-bank-pavilion": "pavilion",
    "xfinity-center-mansfield": "xfinity",
    "wang-theatre": "wang",
    "boch-center-wang-theatre": "wang",
    "mgm-music-hall-at-fenway": "mgm_music_hall",
    "big-night-live": "big_night_live",
    "somerville-theatre": "somerville_theatre",
    "city-winery---boston": "city_winery",
    "city-winery-boston": "city_winery",
    "blue-ocean-music-hall": "blue_ocean",
    "the-cabot": "the_cabot",
    "groton-hill-music-center": "groton_hill",
    "the-grand---boston": "the_grand",
    "the-grand-boston": "the_grand",
    "chevalier-theatre": "chevalier",
    "the-palladium": "palladium",
    "boston-symphony-hall": "symphony_hall",
    "berklee-performance-center": "berklee",
    "cafe-939-at-berklee": "cafe_939",
    "regattabar": "regattabar",
    "scullers-jazz-club": "scullers",
    "agganis-arena": "agganis",
    "the-wilbur": "wilbur",
    "wilbur-theatre": "wilbur",
    "gillette-stadium": "gillette",
    "club-passim": "clubpassim",
    "sonia": "sonia",
    "sonia-cambridge": "sonia",
    "crystal-ballroom-somerville": "crystal_ballroom",
    "crystal-ballroom---somerville": "crystal_ballroom",
    "hampton-beach-casino-ballroom": "hampton_beach",
    "indian-ranch-amphitheatre": "indian_ranch",
    "indian-ranch": "indian_ranch",
    "boch-center-shubert-theatre": "shubert",
    "shubert-theatre": "shubert",
    "emerson-colonial-theatre": "colonial",
    "colonial-theatre": "colonial",
    "tsongas-center": "tsongas",
    "tsongas-center-at-umass-lowell": "tsongas",
}
# pattern, id, name, city
PROMOTER_VENUES = [
    ("roadrunner", "roadrunner", "Roadrunner", "Boston"),
    ("royale", "royale", "Royale", "Boston"),
    ("sinclair", "sinclair", "The Sinclair", "Cambridge"),
    ("fête music hall - ballroom", "fete_ballroom", "Fête Music Hall - Ballroom", "Boston"),
    ("fete music hall - ballroom", "fete_ballroom", "Fête Music Hall - Ballroom", "Boston"),
    ("fete ballroom", "fete_ballroom", "Fête Music Hall - Ballroom", "Boston"),
    ("fête music hall - lounge", "fete_lounge", "Fête Music Hall - Lounge", "Boston"),
    ("fete music hall - lounge", "fete_lounge", "Fête Music Hall - Lounge", "Boston"),
    ("fete lounge", "fete_lounge", "Fête Music Hall - Lounge", "Boston"),
    ("arts at the armory", "armory", "Arts at the Armory", "Somerville"),
    ("armory", "armory", "Arts at the Armory", "Somerville"),
    ("suffolk downs", "suffolk_downs", "The Stage at Suffolk Downs", "Boston"),
    ("stage at suffolk", "suffolk_downs", "The Stage at Suffolk Downs", "Boston"),
]
TITLE_SHOW_SUFFIX = r"\s*[-:]\s*(tour|live|concert|show|presents|tickets).*$"
TITLE_SHOW_NOTE = r"\s*\(.*?(tour|live|vip|meet|sold out).*?\)$"
# id, name, city, link, age, patterns of titles to leave out
ICAL_VENUES = [
    ("lizardlounge", "Lizard Lounge", "Cambridge", "https://lizardloungeclub.com/events/?ical=1", "21+", []),
    ("rockwell", "The Rockwell", "Somerville", "https://therockwell.org/calendar/?ical=1", "a/a", []),
    ("firehouse", "Firehouse Center for the Arts", "Newburyport", "https://firehouse.org/events/?ical=1", "a/a", [
        r"film series", r"murder mystery", r"junie b", r"kids? show", r"children'?s", r"story ?time", r"book club",
        r"art exhibit", r"gallery", r"workshop", r"class\b", r"lecture", r"talk\b", r"dance company", r"ballet",
    ]),
]
ICAL_SKIP = ["no event", "private event", "closed", "no show", "cancelled", "canceled"]
CLUB_CALENDAR_SKIP = ["closed", "private event", "no music", "canceled", "cancelled"]
EMBEDDED_SKIP = ["club closed", "closed", "cancelled", "canceled", "private event"]
SET_SUFFIX = r"\s*-\s*(Early Jazz Set|Late Set|Organ Groove|New Jazz|Jazz Brunch|Brunch Jazz).*$"
SEATING = (r"\s*-\s*Seated Show.*$", r"\s*-\s*Standing Show.*$", r"^An Evening with\s*", r"^Live:\s*")
SERIES = (
    r"^Saturday Revival\s+(?:with\s+)?", r"^Sunday Brunch\s+(?:with\s+)?", r"^Live:\s*", r"^An Evening with\s+",
)


def _ntz(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def _names(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: x["name"]), lambda n: ~blank(n))


# -- APIs ----------------------------------------------------------------------


def api_a_listings(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Events of the first API. Payloads are parsed once; of cancelled ones nothing else is read."""
    e = computed_once(df.select("seq", F.from_json(payload, API_A).alias("e")), "e")
    status = F.lower(_or(C("e.dates.status.code"), ""))
    e = e.where(~status.isin(DROPPED_STATUS) & (F.size(F.coalesce("e._embedded.venues", F.array())) > 0))
    clock = _ntz(F.concat(F.lit("1970-01-01 "), _or(C("e.dates.start.localTime"), "20:00:00")), "yyyy-MM-dd HH:mm:ss")
    venue = F.get("e._embedded.venues", F.lit(0))
    name = _or(venue["name"], "Unknown Venue")
    attractions = F.coalesce(_names(C("e._embedded.attractions")), no_strings())
    first = F.try_element_at("e.priceRanges", F.lit(1))
    kinds = F.flatten(F.transform("e.classifications", lambda c: F.array(c["genre"]["name"], c["subGenre"]["name"])))
    note = F.concat(_or(C("e.info"), ""), F.lit(" "), _or(C("e.pleaseNote"), ""))
    rows = as_listings(
        e,
        date=_ntz(C("e.dates.start.localDate"), "yyyy-MM-dd"),
        venue_id=F.coalesce(F.try_element_at(text.literal_map(fx.API_A_VENUE_IDS), _or(venue["id"], "")), text.slug(name, "api")),
        venue_name=name,
        venue_location=_or(venue["city"]["name"], fx.DEFAULT_LOCATION),
        bands=F.when(F.size(attractions) > 0, attractions).otherwise(F.array(_or(C("e.name"), "Unknown Artist"))),
        age_requirement=text.parse_age(note, "words_or_18"),
        price_advance=F.nullif(first["min"].cast("int"), F.lit(0)),
        price_door=F.nullif(first["max"].cast("int"), F.lit(0)),
        time=_or(temporal.clock_label(clock, minutes=False), fx.DEFAULT_TIME),
        flags=F.when(F.lower(_or(C("e.dates.status.code"), "")) == "limited", F.array(F.lit("$"))).otherwise(no_strings()),
        source=F.lit("ticketmaster"),
        source_url=C("e.url"),
        genre_tags=F.coalesce(F.transform(F.filter(kinds, lambda g: ~blank(g)), F.lower), no_strings()),
    )
    return rows.where(C("date").isNotNull())


def api_b_listings(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Events of the second API, dated by local time. Payloads are parsed once."""
    e = computed_once(df.select("seq", F.from_json(payload, API_B).alias("e")), "e").where(C("e.venue").isNotNull())
    at = F.when(blank(C("e.datetime_local")), C("e.datetime_utc")).otherwise(C("e.datetime_local"))
    name = _or(C("e.venue.name"), "Unknown Venue")
    bands = F.coalesce(F.array_distinct(_names(C("e.performers"))), no_strings())
    title = F.when(blank(C("e.title")), C("e.short_title")).otherwise(C("e.title"))
    genres = F.flatten(F.transform("e.performers", lambda p: F.coalesce(_names(p["genres"]), no_strings())))
    clock = _ntz(F.substring(F.element_at(F.split(at, "T"), 2), 1, 5), "HH:mm")
    known = F.try_element_at(text.literal_map(API_B_VENUES), text.slug(name, "hyphen"))
    rows = as_listings(
        e,
        date=F.coalesce(_ntz(F.substring(at, 1, 19), "yyyy-MM-dd'T'HH:mm:ss"), _ntz(F.substring(at, 1, 10), "yyyy-MM-dd")),
        venue_id=F.when(name == "", F.lit("unknown")).otherwise(F.coalesce(known, text.slug(name, "api"))),
        venue_name=name,
        venue_location=_or(C("e.venue.city"), fx.DEFAULT_LOCATION),
        bands=F.when(F.size(bands) > 0, bands).otherwise(F.when(~blank(title), F.array(title)).otherwise(no_strings())),
        age_requirement=F.lit("18+"),
        price_advance=F.nullif(C("e.stats.lowest_price").cast("int"), F.lit(0)),
        price_door=F.nullif(C("e.stats.highest_price").cast("int"), F.lit(0)),
        time=F.when(at.contains("T"), _or(temporal.clock_label(clock, minutes=False), fx.DEFAULT_TIME)).otherwise(F.lit(fx.DEFAULT_TIME)),
        flags=F.when(C("e.score") > API_B_HIGH_DEMAND, F.array(F.lit("$"))).otherwise(no_strings()),
        source=F.lit("seatgeek"),
        source_url=C("e.url"),
        genre_tags=F.coalesce(F.array_distinct(F.transform(genres, F.lower)), no_strings()),
    )
    return rows.where(C("date").isNotNull() & (F.size("bands") > 0))


# -- JSON inside pages -------------------------------------------------------------


def _script_events(df: DataFrame, html: str) -> DataFrame:
    """JSON-LD events of a page with their place in it; one object counts as a list of one."""
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )
    listed = df.select("seq", F.posexplode(blocks).alias("b", "block"))
    events = listed.select("seq", "b", F.posexplode(F.from_json("block", JSONLD)).alias("i", "e"))
    ok = C("e.@type").isin(JSONLD_TYPES) & ~blank(C("e.name")) & ~blank(C("e.startDate"))
    return events.where(ok)


def _title_bands(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, "(?i)" + TITLE_SHOW_SUFFIX, ""), "(?i)" + TITLE_SHOW_NOTE, "")
    bands = text.split_bands(t)
    return F.when(F.size(bands) > 0, bands).otherwise(F.array(strip(t)))


def _offer_price(offers: Column) -> Column:
    first = F.try_element_at(F.from_json(offers, "ARRAY<STRUCT<price: STRING, lowPrice: STRING>>"), F.lit(1))
    price = F.when(blank(first["price"]) | (first["price"] == "0"), first["lowPrice"]).otherwise(first["price"])
    return text.whole(F.nullif(price, F.lit("")))


def jsonld_listings(df: DataFrame, html: str = "html", as_of="1970-01-01", local: bool = False, venue=None, source="scrape:bowery_boston") -> DataFrame:
    """Listings from a page's JSON-LD.

    Default: start times are UTC and become Eastern time, venues come from the event.
    ``local``: start times are already local, the venue is the given ``(id, name,
    city, url)``, and the first event per day and headliner stays.
    """
    e = _script_events(df, html)
    start = C("e.startDate")
    timed = start.contains("T")
    wall = _ntz(F.substring(F.replace(start, F.lit("Z"), F.lit("")), 1, 19), "yyyy-MM-dd'T'HH:mm:ss")
    wall = F.coalesce(wall, _ntz(F.substring(start, 1, 16), "yyyy-MM-dd'T'HH:mm"))
    shown = F.when(timed, wall if local else temporal.utc_to_eastern(wall)).otherwise(temporal.parse_date(start))
    e = e.withColumn("at", shown).where(F.to_date("at") >= temporal.as_date(as_of))
    seq = place(C("seq"), C("b"), C("i"))
    common = dict(
        seq=seq, date=C("at"), age_requirement=F.lit("18+"), price_advance=_offer_price(C("e.offers")),
        source=F.lit(source),
    )
    if local:
        hour = F.hour("at")
        label = (
            F.when(hour > 12, F.concat((hour - 12).cast("string"), F.lit("pm"))).when(hour == 12, F.lit("12pm"))
            .when(hour == 0, F.lit("12am")).when(hour >= 6, F.concat(hour.cast("string"), F.lit("pm")))
            .otherwise(F.concat(hour.cast("string"), F.lit("am")))
        )
        from gigmesh.operators.grouping import first_seen

        rows = as_listings(
            e, bands=_title_bands(C("e.name")), time=F.when(timed, label).otherwise(F.lit(fx.DEFAULT_TIME)),
            venue_id=F.lit(venue[0]), venue_name=F.lit(venue[1]), venue_location=F.lit(venue[2]),
            source_url=_or(C("e.url"), venue[3]), **common,
        )
        return first_seen(rows, [F.to_date("date"), F.lower(F.element_at("bands", 1))])
    given = _or(F.get_json_object("e.location", "$.name"), "")
    low = F.lower(given)
    match = lambda k: F.coalesce(*[F.when(low.contains(row[0]), F.lit(row[k])) for row in PROMOTER_VENUES])
    none = given == ""
    acts = _names(F.from_json("e.performer", "ARRAY<STRUCT<name: STRING>>"))
    midnight = (F.hour("at") == 0) & (F.minute("at") == 0)
    return as_listings(
        e,
        bands=_append_new(_title_bands(C("e.name")), acts),
        time=F.when(midnight, F.lit(fx.DEFAULT_TIME)).otherwise(temporal.clock_label(C("at"))),
        venue_id=F.when(none, F.lit("unknown")).otherwise(F.coalesce(match(1), text.slug(given, "runs"))),
        venue_name=F.when(none, F.lit("Unknown Venue")).otherwise(F.coalesce(match(2), given)),
        venue_location=F.when(none, F.lit(fx.DEFAULT_LOCATION)).otherwise(F.coalesce(match(3), F.lit(fx.DEFAULT_LOCATION))),
        source_url=C("e.url"),
        **common,
    )


def _append_new(bands: Column, more: Column) -> Column:
    """Append names that are not listed yet."""
    return F.concat(bands, F.array_except(F.coalesce(more, no_strings()), bands))


def embedded_listings(df: DataFrame, html: str = "html", now="1970-01-01", name: str = "remEvents") -> DataFrame:
    """Listings from ``var NAME = {...};`` inside a page script, one per map value."""
    found = F.regexp_extract(html, r"(?s)var\s+" + name + r"\s*=\s*(\{.*?\});", 1)
    values = F.map_values(F.from_json(F.nullif(found, F.lit("")), EMBEDDED))
    e = df.select("seq", F.posexplode(values).alias("i", "e"))
    title = strip(_or(C("e.title"), ""))
    e = e.where((title != "") & ~F.exists(text.literal_array(EMBEDDED_SKIP), lambda w: F.lower(title).contains(w)))
    at = F.coalesce(
        _ntz(F.upper("e.date_and_time"), "MM/dd/yyyy h:mm a"), _ntz(C("e.date_and_time"), "MM/dd/yyyy H:mm")
    )
    price = text.parse_price(C("e.cost"), "cost")
    rows = as_listings(
        e,
        seq=place(C("seq"), C("i")),
        date=at,
        venue_id=F.lit("passim"), venue_name=F.lit("Club Passim"), venue_location=F.lit("Cambridge"),
        bands=text.split_bands_slash(title, cut=SEATING, words=("w/", "with", "&", "and", r"ft\.?", "featuring"), max_commas=3),
        price_advance=price["advance"], price_door=price["door"],
        time=temporal.parse_time_minutes(_or(C("e.show_string"), fx.DEFAULT_TIME)),
        flags=F.when(_or(C("e.sold_out"), "false").isin("false", "", "0"), no_strings()).otherwise(F.array(F.lit("SOLD OUT"))),
        source=F.lit("scrape:club_passim"),
        source_url=C("e.permalink"),
        genre_tags=F.array(F.lit("folk"), F.lit("acoustic")),
    )
    from gigmesh.operators.filters import lookahead

    return lookahead(rows.where(C("date").isNotNull()), now, "from_today")


# -- calendar feeds -------------------------------------------------------------------


def ical_events(df: DataFrame, ics: str = "ics", carry: tuple[str, ...] = ()) -> DataFrame:
    """Event properties of a feed: ``seq``, ``i``, map ``p`` and the feed's columns ``carry``.

    Continuation lines are unfolded; a property's parameters are dropped and its
    last occurrence wins.
    """
    crlf = C(ics).contains("\r\n")
    unfolded = F.when(crlf, F.regexp_replace(ics, "\r\n[ \t]", "")).otherwise(F.regexp_replace(ics, "\n[ \t]", ""))
    events = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\s*?\n(.*?)END:VEVENT"), F.lit(1))
    rows = df.select("seq", *carry, F.posexplode(events).alias("i", "event"))
    props = F.filter(F.transform(F.split("event", "\r?\n"), strip), lambda s: s.contains(":"))
    pairs = F.transform(
        props,
        lambda s, i: F.struct(
            F.regexp_extract(s, "^([^:;]*)", 1).alias("k"), F.regexp_extract(s, "^[^:]*:(.*)$", 1).alias("v"), i.alias("i")
        ),
    )
    rows = computed_once(rows.select("seq", *carry, "i", pairs.alias("pairs")), "pairs")
    last = F.filter(
        "pairs", lambda x: ~F.exists(F.slice(F.col("pairs"), x["i"] + 2, F.size("pairs")), lambda y: y["k"] == x["k"])
    )
    rows = computed_once(rows.select("seq", *carry, "i", last.alias("last")), "last")
    entries = F.map_from_arrays(F.transform("last", lambda x: x["k"]), F.transform("last", lambda x: x["v"]))
    return computed_once(rows.select("seq", *carry, "i", entries.alias("p")), "p")


def _prop(name: str, default: str = "") -> Column:
    return _or(F.try_element_at("p", F.lit(name)), default)


def ical_start(c: Column) -> Column:
    """Start of an event as wall time: date and time, or date alone."""
    day = F.substring_index(c, "T", 1)
    stamp = F.concat(F.substring(day, -8, 8), F.substring(F.element_at(F.split(c, "T"), 2), 1, 6))
    return F.when(c.contains("T"), _ntz(stamp, "yyyyMMddHHmmss")).otherwise(_ntz(F.substring(c, -8, 8), "yyyyMMdd"))


def ical_listings(df: DataFrame, ics: str = "ics", now="1970-01-01", venue_key: str = "venue") -> DataFrame:
    """Listings of venue calendars; ``venue`` names a row of the fixed calendar table.

    The first event per venue, start and title stays: monthly feeds repeat events.
    """
    from gigmesh.operators.filters import lookahead
    from gigmesh.operators.grouping import first_seen

    spark = df.sparkSession
    venues = spark.createDataFrame(
        ICAL_VENUES, "venue string, name string, city string, link string, age string, skips array<string>"
    )
    # A feed's venue stays in its rows: a join would read and parse all feeds twice.
    named = df.select("seq", ics, C(venue_key).alias("venue"))
    events = ical_events(named, ics, carry=("venue",)).join(F.broadcast(venues), "venue").withColumn("seq", place(C("seq"), C("i")))
    skip = lambda low: text.has_any(low, ICAL_SKIP) | F.exists("skips", lambda p: F.regexp_like(low, p))
    skipped = text.bound(F.lower(_prop("SUMMARY")), skip)
    kept = events.where(~skipped & (_prop("SUMMARY") != ""))
    kept = first_seen(
        kept.withColumn("start", _prop("DTSTART")).withColumn("summary", _prop("SUMMARY")), ["venue", "start", "summary"]
    )
    at = ical_start(C("start"))
    price = text.parse_price(text.unescape_ical(_prop("DESCRIPTION")), "pair")
    rows = as_listings(
        kept,
        date=at, venue_id=C("venue"), venue_name=C("name"), venue_location=C("city"),
        bands=text.split_bands_slash(text.unescape_ical(C("summary"))),
        age_requirement=C("age"), price_advance=price["advance"], price_door=price["door"],
        time=F.when(C("start").contains("T"), temporal.clock_label(at)).otherwise(F.lit(fx.DEFAULT_TIME)),
        source=F.lit("scrape:ical_venues"),
        source_url=F.coalesce(F.try_element_at("p", F.lit("URL")), "link"),
    )
    return lookahead(rows.where(C("date").isNotNull()), now, "from_now")


def club_calendar_listings(df: DataFrame, ics: str = "ics", now="1970-01-01") -> DataFrame:
    """Listings of the one club calendar in UTC, moved by a fixed five hours."""
    from gigmesh.operators.filters import lookahead

    events = ical_events(df, ics).withColumn("seq", place(C("seq"), C("i")))
    summary, start = strip(_prop("SUMMARY")), _prop("DTSTART")
    kept = events.where(
        (summary != "") & ~F.exists(text.literal_array(CLUB_CALENDAR_SKIP), lambda w: F.lower(summary).contains(w))
    )
    raw = ical_start(start)
    at = F.when(start.endswith("Z"), raw - F.expr("INTERVAL '5' HOUR")).otherwise(raw)
    price = text.parse_price(text.unescape_ical(_prop("DESCRIPTION")), "free_pair")
    rows = as_listings(
        kept,
        date=F.to_date(at).cast("timestamp_ntz"),
        venue_id=F.lit("beehive"), venue_name=F.lit("The Beehive"), venue_location=F.lit("Boston"),
        bands=text.split_bands_slash(
            summary, cut=(SET_SUFFIX,), words=("w/", "with", "&", "and", r"ft\.?", "featuring"), comma=False,
            slash_without_spaces=True,
        ),
        age_requirement=F.lit("21+"), price_advance=price["advance"], price_door=price["door"],
        time=F.when(start.contains("T"), temporal.clock_label(at)).otherwise(F.lit(fx.DEFAULT_TIME)),
        source=F.lit("scrape:beehive"),
        source_url=_prop("URL", "https://www.beehiveboston.com/calendar"),
        genre_tags=F.array(F.lit("jazz")),
    )
    return lookahead(rows.where(C("date").isNotNull()), now, "from_today")


def _xml_text(item: Column, tag: str) -> Column:
    raw = F.regexp_extract(item, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    plain = lambda t: F.regexp_extract(t, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    return text.bound(raw, lambda t: F.when(t.contains("<![CDATA["), plain(t)).otherwise(text.html_unescape(t)))


def rss_listings(df: DataFrame, xml: str = "xml", now="1970-01-01") -> DataFrame:
    """Listings of an RSS feed: the room is the title's prefix, the rest is in the description."""
    from gigmesh.operators.filters import lookahead

    items = F.regexp_extract_all(xml, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    rows = df.select("seq", F.posexplode(items).alias("i", "item")).select(
        place(C("seq"), C("i")).alias("seq"),
        strip(_xml_text(C("item"), "title")).alias("title"),
        text.html_unescape(_xml_text(C("item"), "description")).alias("about"),
        _xml_text(C("item"), "link").alias("link"),
    )
    rows = computed_once(rows, "title", "about", "link")
    low = F.lower("title")
    toad, pub, up = low.startswith("toad:"), low.startswith("mccarthy's:"), low.contains("upstairs")
    colon = C("title").contains(":")
    event = (
        F.when(toad, strip(F.substring("title", 6, 1 << 30)))
        .when(pub, strip(F.substring("title", 12, 1 << 30)))
        .when(up & colon, strip(F.regexp_extract("title", "^[^:]*:(.*)$", 1)))
        .otherwise(C("title"))
    )
    price = text.parse_price(C("about"), "words")
    full = r"(\w+)\s+(\d{1,2}),?\s+(\d{4})"
    named = F.regexp_extract_all("about", F.lit(r"(\w+\s+\d{1,2},?\s+\d{4})"), F.lit(1))
    tries = F.transform(
        named, lambda s: F.try_to_timestamp(F.regexp_replace(s, full, "$1 $2, $3"), F.lit("MMMM d, yyyy"))
    )
    date = F.try_element_at(F.filter(tries, lambda d: d.isNotNull()), F.lit(1)).cast("timestamp_ntz")
    out = as_listings(
        rows.where("title <> ''"),
        date=date,
        venue_id=F.when(toad, F.lit("toad")).when(pub | up, F.lit("mccarthys")).otherwise(F.lit("toad")),
        venue_name=F.when(toad, F.lit("Toad")).when(pub, F.lit("McCarthy's")).when(up, F.lit("Upstairs at McCarthy's")).otherwise(F.lit("Toad")),
        venue_location=F.lit("Somerville"),
        bands=text.split_bands_slash(event, cut=SERIES, words=("w/", "with", "&", "and", r"\+"), comma=False, unquote=True),
        age_requirement=text.parse_age(C("about"), "words"),
        price_advance=price["advance"], price_door=price["door"],
        time=temporal.parse_time_minutes(C("about")),
        source=F.lit("scrape:mccarthys_toad"),
        source_url=C("link"),
    )
    return lookahead(out.where(C("date").isNotNull()), now, "from_today")


# -- work lists ---------------------------------------------------------------------------


def month_worklist(sources: DataFrame, as_of, by: str = "month", weeks: int = fx.WEEKS_AHEAD) -> DataFrame:
    """Months to request per source: ``step``, ``year``, ``month``.

    ``month`` counts calendar months; ``days`` advances thirty days per step, which
    can skip or repeat one.
    """
    steps = weeks // 4 + 1
    today = temporal.as_date(as_of)
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")
    rows = sources.select("*", step)
    day = F.add_months(F.date_trunc("month", today).cast("date"), C("step")) if by == "month" else F.date_add(today, C("step") * 30)
    return rows.withColumn("year", F.year(day)).withColumn("month", F.month(day))

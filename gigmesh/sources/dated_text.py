"""Listings from the text of pages, where position carries meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import temporal, text
from gigmesh.functions.text import strip
from gigmesh.operators import filters, grouping, lines
from gigmesh.schema import as_listings, no_strings, place
from gigmesh.sources import dates, pages
from gigmesh.sources.pages import MONTHS_FULL, page_text

C = F.col

# Words, patterns and venue tables.
DAYS_FULL = "(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
# pattern, id, name, city
BOLD_VENUES = [
    ("middle east down", "middleeast_down", "Middle East Downstairs", "Cambridge"),
    ("middle east up", "middleeast_up", "Middle East Upstairs", "Cambridge"),
    ("middle east corner", "middleeast_corner", "Middle East Corner", "Cambridge"),
    ("the middle east", "middleeast", "Middle East", "Cambridge"),
    ("middle east", "middleeast", "Middle East", "Cambridge"),
    ("o'brien's", "obriens", "O'Brien's Pub", "Allston"),
    ("obriens", "obriens", "O'Brien's Pub", "Allston"),
    ("o'briens", "obriens", "O'Brien's Pub", "Allston"),
    ("sonia", "sonia", "Sonia", "Cambridge"),
    ("deep cuts", "deepcuts", "Deep Cuts", "Medford"),
    ("midway cafe", "midway", "Midway Cafe", "Jamaica Plain"),
    ("midway", "midway", "Midway Cafe", "Jamaica Plain"),
    ("once", "once", "ONCE Ballroom", "Somerville"),
    ("crystal ballroom", "crystal", "Crystal Ballroom", "Somerville"),
    ("paradise rock", "paradise", "Paradise Rock Club", "Boston"),
    ("paradise", "paradise", "Paradise Rock Club", "Boston"),
    ("brighton music", "brighton", "Brighton Music Hall", "Allston"),
    ("sinclair", "sinclair", "The Sinclair", "Cambridge"),
    ("house of blues", "hob", "House of Blues", "Boston"),
    ("royale", "royale", "Royale", "Boston"),
    ("roadrunner", "roadrunner", "Roadrunner", "Boston"),
    ("big night live", "bignightlive", "Big Night Live", "Boston"),
    ("crystal ballroom somerville", "crystal", "Crystal Ballroom", "Somerville"),
    ("elks lodge", "elks", "Elks Lodge", "Cambridge"),
    ("lizard lounge", "lizard", "Lizard Lounge", "Cambridge"),
    ("ralph's diner", "ralphs", "Ralph's Diner", "Worcester"),
    ("ralphs", "ralphs", "Ralph's Diner", "Worcester"),
]
SKA_VENUES = [
    ("middle east", "middleeast", "Middle East", "Cambridge"),
    ("sonia", "sonia", "Sonia", "Cambridge"),
    ("o'brien's", "obriens", "O'Brien's Pub", "Allston"),
    ("midway cafe", "midway", "Midway Cafe", "Jamaica Plain"),
    ("paradise", "paradise", "Paradise Rock Club", "Boston"),
    ("sinclair", "sinclair", "The Sinclair", "Cambridge"),
    ("brighton music", "brighton", "Brighton Music Hall", "Allston"),
    ("house of blues", "hob", "House of Blues", "Boston"),
    ("royale", "royale", "Royale", "Boston"),
    ("roadrunner", "roadrunner", "Roadrunner", "Boston"),
    ("once", "once", "ONCE Ballroom", "Somerville"),
    ("crystal ballroom", "crystal", "Crystal Ballroom", "Somerville"),
    ("vault", "vault", "The Vault", "New Bedford"),
    ("thunder road", "thunderroad", "Thunder Road", "Somerville"),
]
SKA_ADDRESS = (
    r"([A-Z][A-Za-z'\s]+),?\s+\d+\s+[A-Za-z\s]+,?\s+"
    r"(Boston|Cambridge|Somerville|Allston|Brookline|Jamaica Plain|Medford|New Bedford)"
)
SKA_NOT_BANDS = r"(tickets|eventbrite|facebook\.com|http|www\.|\$\d+|doors|all ages|21\+|18\+)"
BAND_STOP_WORDS = [
    "and", "with", "feat", "featuring", "plus", "at", "the", "all ages", "doors", "show", "pm", "am", "tix", "tickets",
    "fb", "event", "page", "link", "more", "info",
]
BAND_LOOK_ALIKES = r"(?i)^\d+[ap]m$|^\$\d+|^(18|21)\+$|^at\s+"
BEBOP_SKIP_EXACT = ["the bebop", "google maps", "view map", "add to calendar"]
BEBOP_SKIP_PART = ["boylston", "boston, ma", "united states"]
CONTEXT_SKIP = [
    "menu", "contact", "about", "home", "tickets", "buy", "more", "info", "subscribe", "email", "phone", "address",
    "hours", "parking", "directions", "facebook", "instagram", "twitter", "copyright", "privacy", "terms", "sitemap",
    "powered by",
]
DATE_ONLY = (
    r"(?i)^(mon|tue|wed|thu|fri|sat|sun)\s*$|^" + DAYS_FULL + r"\s*$|"
    r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{1,2}\s*$|^\d{1,2}/\d{1,2}\s*$|^\d{1,2}\s*$"
)
PUB_SKIP = ["free show", "no-cover", "residency", "followed by", "here for you", "live music", "follow us"]


def _venue(c: Column, table: list) -> tuple[Column, Column, Column]:
    low = F.lower(c)
    pick = lambda k: F.coalesce(*[F.when(low.contains(row[0]), F.lit(row[k])) for row in table])
    return pick(1), pick(2), pick(3)


def _seq(pos: str = "pos") -> Column:
    return place(C("seq"), C(pos))


def valid_bands(bands: Column) -> Column:
    """Drop stop words and entries that look like prices, ages or times."""
    stops = text.literal_array(BAND_STOP_WORDS)
    return F.filter(
        F.transform(bands, strip),
        lambda b: (F.length(b) > 1) & ~F.array_contains(stops, F.lower(b)) & ~b.rlike(BAND_LOOK_ALIKES),
    )


def bold_listings(df: DataFrame, as_of, html: str = "html") -> DataFrame:
    """Bold dates, then bold billings whose venue, price and time follow as plain text.

    Each bold element with the text up to the next boundary is one line, so the
    last date carries forward over lines.
    """
    marked = F.regexp_extract_all(
        html, F.lit(r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>((?:(?!<(?:b|strong|br|p|div)\b).)*)"), F.lit(0)
    )
    is_date = lambda s: pages.plain(pages.inner(s, tag="b|strong")).rlike(rf"(?i)^{MONTHS_FULL}\s+\d{{1,2}}")
    cut = lines.carry_forward(df.select("seq", marked.alias("bold")), "bold", is_date)
    rows = cut.select(
        "seq", "pos", dates.month_day(pages.plain(C("heading")), as_of).alias("day"),
        pages.plain(pages.inner(C("line"), tag="b|strong")).alias("billed"), pages.plain(C("line"), " ").alias("context"),
    )
    vid, name, city = _venue(C("context"), BOLD_VENUES)
    end = r"(?:\s*[-–•]|\s+\d|\s+doors|\s+all\s+ages|\s+18\+|\s+21\+|\s*$)"
    at = strip(F.regexp_extract("context", r"(?i)\bat\s+(?:the\s+)?([A-Z][A-Za-z'\-\s]+?)" + end, 1))
    dash = strip(F.regexp_extract("context", r"[-–]\s*([A-Z][A-Za-z'\-\s]+?)(?:\s*[-–]|\s+\d|\s+doors|\s+all\s+ages|\s+18\+|\s+21\+|\s*$)", 1))
    found = F.when(at != "", F.when(F.length(at) >= 3, at)).otherwise(F.when(F.length(dash) >= 3, dash))
    rows = rows.withColumn("vid", F.coalesce(vid, text.slug(found, "runs"))).withColumn("vname", F.coalesce(name, found)).withColumn("city", city)
    low = F.lower("context")
    age = F.when(low.rlike(r"21 ?\+|21 and over"), F.lit("21+")).when(low.rlike(r"18 ?\+|18 and over"), F.lit("18+")).otherwise(F.lit("a/a"))
    price = F.when(text.is_free_text(C("context")), F.lit(0)).otherwise(text.whole(F.regexp_extract("context", r"\$(\d+)", 1)))
    out = as_listings(
        rows.where(C("vid").isNotNull() & (C("day") >= temporal.as_date(as_of))),
        seq=_seq(), date=C("day").cast("timestamp_ntz"),
        venue_id=C("vid"), venue_name=C("vname"), venue_location=F.coalesce("city", F.lit(fx.DEFAULT_LOCATION)),
        bands=valid_bands(text.split_bands(F.regexp_replace("billed", r"(?i)^with\s+", ""))),
        age_requirement=age, price_advance=price, time=temporal.parse_time_minutes(C("context")),
        source=F.lit("scrape:boston_groupie_news"), genre_tags=text.literal_array(["punk", "rock"]),
    )
    return out.where(F.size("bands") > 0)


def line_listings(df: DataFrame, as_of, html: str = "html") -> DataFrame:
    """A date line covers the show lines after it (those with a price or "pm")."""
    arr = df.select("seq", lines.lines_of(page_text(C(html))).alias("lines"))
    head = r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}"
    rows = lines.carry_forward(arr, "lines", lambda s: s.rlike(head), lambda s: dates.month_day(s, as_of))
    rows = rows.where(C("line").contains("$") | F.lower("line").contains("pm"))
    clock = F.regexp_extract("line", r"(?i)(\d{1,2}(?::\d{2})?\s*(?:am|pm))", 1)
    price = text.parse_price(F.regexp_extract("line", r"(\$\d+(?:\s*/\s*\$?\d+)?)", 1))
    rows = rows.withColumn("price", price)
    bare = F.regexp_replace("line", r"\$\d+(?:\s*/\s*\$?\d+)?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\d{1,2}(?::\d{2})?\s*(?:am|pm)", ""), r"(?i)(?:all ages|21\+|18\+|a/a)", "")
    out = as_listings(
        rows, seq=_seq(), date=C("heading").cast("timestamp_ntz"),
        venue_id=F.lit("middleeast"), venue_name=F.lit("Middle East"), venue_location=F.lit("Cambridge"),
        bands=text.split_bands(bare), age_requirement=F.lit("18+"), price_advance=C("price.advance"), price_door=C("price.door"),
        time=temporal.parse_time(clock), flags=F.array(F.lit("@")), source=F.lit("scrape:middle_east"),
    )
    return out.where(C("date").isNotNull() & (F.size("bands") > 0))


def session_listings(df: DataFrame, as_of, html: str = "html") -> DataFrame:
    """A weekday date line opens an entry; venue and billing lines follow until a blank line.

    The first line naming a venue sets it. Repeats of day, headliner and venue are
    dropped, except for entries that the next date line closed.
    """
    arr = df.select("seq", lines.lines_of(page_text(C(html)) if html != "text" else C(html), keep_blank=True).alias("lines"))
    head = rf"(?i)^{DAYS_FULL},?\s+{MONTHS_FULL}\s+\d{{1,2}}"
    runs = lines.sessions(arr, "lines", lambda s: s.rlike(head))
    is_venue = lambda s: _venue(s, SKA_VENUES)[0].isNotNull() | s.rlike(SKA_ADDRESS)
    venue_line = F.try_element_at(F.filter("body", is_venue), F.lit(1))
    at = F.array_position(F.transform("body", is_venue), F.lit(True))
    named = F.filter(
        F.transform("body", lambda s, i: F.struct(s.alias("s"), (i + 1).alias("i"))),
        lambda x: (x["i"] != at) & ~F.lower(x["s"]).rlike(SKA_NOT_BANDS) & (F.length(x["s"]) > 3) & (F.length(x["s"]) < 200),
    )
    vid, name, city = _venue(C("vline"), SKA_VENUES)
    rows = runs.select("seq", "pos", "heading", "closed_by", venue_line.alias("vline"), F.flatten(F.transform(named, lambda x: text.split_bands(x["s"]))).alias("billed"))
    other, town = strip(F.regexp_extract("vline", SKA_ADDRESS, 1)), F.regexp_extract("vline", SKA_ADDRESS, 2)
    clock = F.regexp_extract("heading", r"(?i)(\d{1,2}:\d{2}\s*[ap]m)", 1)
    rows = rows.withColumn("page", C("seq")).withColumn("unchecked", C("closed_by") == "heading")
    tagged = as_listings(
        rows, carry=("page", "unchecked"), seq=_seq(), date=dates.month_day(C("heading"), as_of).cast("timestamp_ntz"),
        venue_id=F.coalesce(vid, F.nullif(text.slug(other, "runs"), F.lit("")), F.lit("unknown")),
        venue_name=F.coalesce(name, F.nullif(other, F.lit("")), F.lit("Unknown Venue")),
        venue_location=F.coalesce(city, F.nullif(town, F.lit("")), F.lit(fx.DEFAULT_LOCATION)),
        bands=F.filter("billed", lambda b: F.length(b) > 1),
        time=F.when(clock == "", F.lit(fx.DEFAULT_TIME)).otherwise(F.replace(F.lower(clock), F.lit(" "), F.lit(""))),
        source=F.lit("scrape:boston_ska"), genre_tags=text.literal_array(["ska", "punk", "reggae"]),
    ).where(C("date").isNotNull() & (F.size("bands") > 0) & (F.to_date("date") >= temporal.as_date(as_of)))
    key = [C("page"), F.to_date("date"), F.lower(F.element_at("bands", 1)), C("venue_id")]
    checked = grouping.first_seen(tagged.where(~C("unchecked")), key)
    return checked.unionByName(tagged.where("unchecked")).drop("page", "unchecked")


def pub_listings(df: DataFrame, as_of, html: str = "html") -> DataFrame:
    """Weekday, date, time, billing and price on consecutive lines."""
    arr = df.select("seq", lines.lines_of(page_text(C(html))).alias("lines"))
    f = lines.around(arr, "lines", lambda s: s.rlike(rf"(?i)^{DAYS_FULL}"), after=4)
    nth = lambda k: F.get("following", F.lit(k))
    spilled = strip(F.regexp_replace(F.lower("line"), rf"^{DAYS_FULL}", ""))
    day_text = F.concat(spilled, nth(0))
    clock = F.lower(nth(1))
    digits, suffix = F.regexp_extract(clock, r"^(\d{1,4})\s*(am|pm)$", 1), F.regexp_extract(clock, r"^(\d{1,4})\s*(am|pm)$", 2)
    hours = F.when(F.length(digits) > 2, F.substring(digits, F.lit(1), F.length(digits) - 2).cast("int").cast("string")).otherwise(digits)
    shown = F.when(F.length(digits) > 2, F.concat(hours, F.lit(":"), F.right(digits, F.lit(2)), suffix)).otherwise(F.concat(digits, suffix))
    billed = F.when(digits != "", strip(F.regexp_replace(nth(2), r"\s*\$\d+\s*", "")))
    own = text.whole(F.regexp_extract(nth(2), r"\$(\d+)", 1))
    after = text.whole(F.regexp_extract(F.coalesce(nth(3), F.lit("")), r"\$(\d+)", 1))
    free = F.lower(F.coalesce(nth(3), F.lit(""))).rlike("free|no-cover")
    price = F.coalesce(after, F.when(free, F.lit(0)), own)
    bad = F.exists(text.literal_array(PUB_SKIP), lambda w: F.lower(billed).contains(w))
    out = as_listings(
        f, seq=_seq(), date=dates.month_day(day_text, as_of, "one_week").cast("timestamp_ntz"),
        venue_id=F.lit("sallyobriens"), venue_name=F.lit("Sally O'Brien's"), venue_location=F.lit("Somerville"),
        bands=F.when((F.length(billed) > 2) & ~bad, text.split_bands(billed)).otherwise(no_strings()),
        age_requirement=F.lit("21+"), price_advance=price, price_door=price,
        time=F.when(digits != "", shown).otherwise(F.lit(fx.DEFAULT_TIME)),
        source=F.lit("scrape:sally_obriens"), genre_tags=text.literal_array(["rock", "indie", "folk", "americana"]),
    )
    return out.where(C("date").isNotNull() & (F.size("bands") > 0))


def title_before_date_listings(df: DataFrame, as_of, html: str = "html") -> DataFrame:
    """The billing is the nearest acceptable of the four lines before a date line."""
    arr = df.select("seq", lines.lines_of(page_text(C(html))).alias("lines"))
    head = rf"^(?i:{DAYS_FULL}),\s+{MONTHS_FULL}\s+\d{{1,2}},\s+\d{{4}}".replace("(?:january", "(?i:january")
    f = lines.around(arr, "lines", lambda s: s.rlike(head), before=4)
    accept = lambda s: (
        ~F.array_contains(text.literal_array(BEBOP_SKIP_EXACT), F.lower(s))
        & ~F.exists(text.literal_array(BEBOP_SKIP_PART), lambda w: F.lower(s).contains(w))
        & ~s.rlike(r"^\d+$") & (F.length(s) > 2)
    )
    title = lines.first_acceptable(C("previous"), accept, lambda s: s.rlike(rf"(?i)^{DAYS_FULL},"))
    for pattern in (r"(?i)\s*-\s*Tickets?\s*$", r"(?i)\s*\|\s*The Bebop\s*$", r"(?i)\s+at The Bebop!?\s*$"):
        title = F.regexp_replace(title, pattern, "")
    clock = F.regexp_extract("line", r"(?i)(\d{1,2}:\d{2})\s*(AM|PM)", 1)
    suffix = F.lower(F.regexp_extract("line", r"(?i)(\d{1,2}:\d{2})\s*(AM|PM)", 2))
    bands = text.split_bands(title)
    out = as_listings(
        f.withColumn("title", title).where(C("title").isNotNull()),
        seq=_seq(), date=dates.month_day(C("line"), as_of).cast("timestamp_ntz"),
        venue_id=F.lit("bebop"), venue_name=F.lit("The Bebop"), venue_location=F.lit("Boston"),
        bands=F.when(F.size(bands) > 0, bands).otherwise(F.array(title)), age_requirement=F.lit("21+"),
        time=F.when(clock == "", F.lit("10pm")).otherwise(F.concat(clock, suffix)),
        source=F.lit("the_bebop"), genre_tags=text.literal_array(["jazz", "soul", "funk"]),
    )
    return grouping.first_seen(out.where(C("date").isNotNull()), [F.to_date("date"), F.array_join("bands", "|")])


def context_fields(previous: Column, line: Column, following: Column) -> Column:
    """Billing, time and price from the lines around a date: first billing, last time and price."""
    frame = F.filter(
        F.concat(F.reverse(previous), following),
        lambda s: (s != line) & ~F.exists(text.literal_array(CONTEXT_SKIP), lambda w: F.lower(s).contains(w))
        & (F.length(s) >= 4) & (F.length(s) <= 150) & ~s.rlike(DATE_ONLY),
    )
    last = lambda p: F.regexp_extract(F.try_element_at(F.filter(frame, lambda s: s.rlike(p)), F.lit(-1)), p, 1)
    billing = F.try_element_at(
        F.filter(
            frame,
            lambda s: s.rlike(r"(?U)^\p{Lu}") & ~F.lower(s).startswith("doors"),
        ),
        F.lit(1),
    )
    clock = last(r"(?i)(\d{1,2}(?::\d{2})?\s*(?:am|pm))")
    return F.struct(
        billing.alias("band"),
        F.when(clock.isNull() | (clock == ""), F.lit("7pm")).otherwise(temporal.parse_time(clock)).alias("time"),
        text.whole(last(r"\$(\d+)")).alias("price"),
    )


def context_listings(df: DataFrame, as_of, html: str = "html") -> DataFrame:
    """Date lines with what two lines before and five after say about the show."""
    arr = df.select("seq", lines.lines_of(page_text(C(html))).alias("lines"))
    dated = lambda s: s.rlike(dates.MONTH_DAY) | s.rlike(r"\b\d{1,2}/\d{1,2}\b")
    f = lines.around(arr, "lines", dated, before=2, after=5)
    f = f.withColumn("found", context_fields(C("previous"), C("line"), C("following")))
    out = as_listings(
        f.where(C("found.band").isNotNull()).withColumn("page", C("seq")), carry=("page",),
        seq=_seq(), date=F.coalesce(dates.month_day(C("line"), as_of), dates.slashed(C("line"), as_of)).cast("timestamp_ntz"),
        venue_id=F.lit("falloutshelter"), venue_name=F.lit("The Fallout Shelter"), venue_location=F.lit("Norwood"),
        bands=F.array("found.band"), price_advance=C("found.price"), time=C("found.time"),
        source=F.lit("fallout_shelter"),
    )
    key = [C("page"), F.to_date("date"), F.element_at("bands", 1)]
    return grouping.first_seen(out.where(C("date").isNotNull()), key).drop("page")


def next_line_listings(df: DataFrame, as_of, html: str = "html") -> DataFrame:
    """The line after a date line is the billing, unless it is navigation."""
    source = pages.PageSource("next_line", "narrows_center", [pages.next_lines], [pages.next_line_fields], window=None)
    return pages.extract(df, source, as_of, html)


def current(df: DataFrame, as_of) -> DataFrame:
    return filters.not_past(df, as_of)

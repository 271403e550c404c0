"""Published views as tables. All take normalized listings; none collects a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import temporal, text
from gigmesh.operators import filters, grouping, numbering
from gigmesh.runtime import cut_lineage

C = F.col


def _line(links: bool = True):
    return text.listing_line(
        C("venue_id"), C("venue_name"), C("venue_location"), C("bands"), C("age_requirement"),
        C("price_advance"), C("price_door"), C("time"), C("flags"), C("source_url"), links,
    )


def details():
    """Age, price and time as shown next to a listing."""
    age = F.when(text.blank(C("age_requirement")), F.lit(fx.DEFAULT_AGE)).otherwise(C("age_requirement"))
    price = text.price_display(C("price_advance"), C("price_door"))
    shown = F.concat_ws(
        " ",
        text.html_escape(age),
        F.when(price != "", price),
        F.when(~text.blank(C("time")), text.html_escape(C("time"))),
    )
    return shown


def flag_text():
    return F.array_join(F.transform("flags", text.html_escape), " ")


def by_date(df: DataFrame, as_of, weeks: int = fx.WEEKS_AHEAD, links: bool = True) -> DataFrame:
    """Week and day table with the line of each listing and its sort keys.

    Rows of a day read in the order ``(lower venue name, time_key, date, seq)``.
    """
    day = C("date")
    out = filters.week_window(df, as_of, weeks)
    # Earlier days clamp to week 0 but lie outside its days.
    out = out.where(F.to_date(day) >= temporal.week_start(temporal.as_date(as_of)))
    return out.select(
        "seq",
        temporal.week_number(day, as_of).alias("week_num"),
        temporal.adjusted_week_label(
            F.date_add(temporal.week_start(temporal.as_date(as_of)), temporal.week_number(day, as_of) * 7), as_of
        ).alias("week_label"),
        F.to_date(day).alias("day"),
        temporal.format_date(day).alias("day_label"),
        F.lower("venue_name").alias("venue_key"),
        temporal.time_sort_key(C("time")).alias("time_key"),
        _line(links).alias("line"),
        C("venue_id").isin(fx.CHAIN_VENUES).alias("is_chain"),
        text.is_free(C("price_advance"), C("price_door")).alias("is_free"),
    )


def by_date_sorted(df: DataFrame, as_of, **kw) -> DataFrame:
    return by_date(df, as_of, **kw).orderBy("week_num", "day", "venue_key", "time_key", "seq")


def by_date_numbered(df: DataFrame, as_of, **kw) -> DataFrame:
    """:func:`by_date` with each line's 1-based ``position`` in the whole list and ``day_position`` in its day.

    Lines are numbered over range partitions, and a day begins at its least position: no task holds a whole day.
    """
    rows = numbering.numbered(by_date(df, as_of, **kw), "week_num", "day", "venue_key", "time_key", "seq", name="position")
    starts = rows.groupBy("day").agg(F.min("position").alias("__start"))
    # One row per day of the view's weeks.
    placed = rows.join(F.broadcast(starts), "day")
    return placed.withColumn("day_position", C("position") - C("__start") + 1).withColumn("position", C("position") + 1).drop("__start")


def by_band(df: DataFrame) -> DataFrame:
    """One row per performer and listing, under the performer's display name."""
    names = grouping.band_names(df)
    rows = grouping.band_rows(df).join(names, "band_key")
    return rows.select(
        "band_key",
        "display_name",
        text.band_anchor(C("display_name")).alias("anchor"),
        F.lower("display_name").alias("sort_key"),
        "seq",
        "date",
        F.date_format("date", "MMM d").alias("day_label"),
        F.concat(text.html_escape(C("venue_name")), F.lit(", "), text.html_escape(C("venue_location"))).alias("venue"),
        text.venue_anchor(C("venue_id")).alias("venue_anchor"),
        details().alias("details"),
        flag_text().alias("flag_text"),
        "source_url",
    )


def by_venue(df: DataFrame) -> DataFrame:
    """One row per listing under its venue, venues sorted without their article."""
    # Listings are formed once and stored, then names, so that their size is known: a few venues are sent to the listings.
    df = cut_lineage(df.select(
        "seq", "date", "venue_id", "venue_name", "venue_location", "bands", "age_requirement", "price_advance", "price_door", "time", "flags", "source_url"
    ))
    names = cut_lineage(
        grouping.venue_names(df).select("venue_id", C("venue_name").alias("display_name"), C("venue_location").alias("display_location"))
    )
    links = F.transform(
        "bands",
        lambda b: F.concat(F.lit('<a href="by-band.html#'), text.band_anchor(b), F.lit('">'), text.html_escape(b), F.lit("</a>")),
    )
    return df.join(names, "venue_id").select(
        "venue_id",
        F.concat(text.html_escape(C("display_name")), F.lit(", "), text.html_escape(C("display_location"))).alias("heading"),
        text.venue_anchor(C("venue_id")).alias("anchor"),
        grouping.article_free(C("display_name")).alias("sort_key"),
        "seq",
        "date",
        F.date_format("date", "MMM d").alias("day_label"),
        F.array_join(links, ", ").alias("band_links"),
        details().alias("details"),
        flag_text().alias("flag_text"),
        "source_url",
    )


def weeks(df: DataFrame, as_of, n: int = fx.WEEKS_AHEAD) -> DataFrame:
    """The weeks to link to, with label and listing count."""
    start = temporal.week_start(temporal.as_date(as_of))
    return grouping.by_week(df, as_of, n).select(
        "week_num",
        temporal.adjusted_week_label(F.date_add(start, C("week_num") * 7), as_of).alias("label"),
        F.format_string("by-date.%d.html", C("week_num")).alias("page"),
        "listings",
    )


def index(df: DataFrame, as_of) -> DataFrame:
    """Index entries ``(section, sort_key, label, target)``: weeks, bands and venues.

    Sorting by ``(section, sort_key)`` gives reading order.
    """
    week = weeks(df, as_of).select(
        F.lit("week").alias("section"),
        F.format_string("%03d", C("week_num")).alias("sort_key"),
        "label",
        C("page").alias("target"),
    )
    band = grouping.band_names(df).select(
        F.lit("band").alias("section"),
        F.lower("display_name").alias("sort_key"),
        text.html_escape(C("display_name")).alias("label"),
        F.concat(F.lit("by-band.html#"), text.band_anchor(C("display_name"))).alias("target"),
    )
    full = F.concat(C("venue_name"), F.lit(", "), C("venue_location"))
    venue = grouping.venue_names(df).select(
        F.lit("venue").alias("section"),
        grouping.article_free(full).alias("sort_key"),
        text.html_escape(full).alias("label"),
        F.concat(F.lit("by-club.html#"), text.venue_anchor(C("venue_id"))).alias("target"),
    )
    return week.unionByName(band).unionByName(venue)


def structured_events(df: DataFrame, as_of, limit: int = fx.MAX_STRUCTURED_ITEMS, as_json: bool = False) -> DataFrame:
    """The first ``limit`` listings of each week as structured items."""
    ranked = grouping.top_per_group(
        filters.week_window(df, as_of).withColumn("week_num", temporal.week_number(C("date"), as_of)),
        "week_num", ["date", "seq"], limit,
    )
    title = F.when(
        F.size("bands") > 0, F.concat(F.array_join(F.slice("bands", 1, 3), ", "), F.lit(" at "), C("venue_name"))
    ).otherwise(C("venue_name"))
    items = ranked.select(
        "week_num", "position", "seq", title.alias("name"), F.date_format("date", "yyyy-MM-dd").alias("start_date"),
        "venue_name", "venue_location", C("bands").alias("performers"),
    )
    if not as_json:
        return items
    address = F.struct(
        F.lit("PostalAddress").alias("@type"), C("venue_location").alias("addressLocality"), F.lit("MA").alias("addressRegion")
    )
    venue = F.struct(F.lit("MusicVenue").alias("@type"), C("venue_name").alias("name"), address.alias("address"))
    acts = F.transform("performers", lambda b: F.struct(F.lit("MusicGroup").alias("@type"), b.alias("name")))
    event = F.struct(
        F.lit("MusicEvent").alias("@type"), "name", C("start_date").alias("startDate"), venue.alias("location"), acts.alias("performer")
    )
    entry = F.struct(F.lit("ListItem").alias("@type"), "position", event.alias("item"))
    return items.select("week_num", "position", F.to_json(entry).alias("item"))


def directory(venues: DataFrame) -> DataFrame:
    """Venue directory: display name, place and contact lines in name order."""
    closed = F.coalesce(C("status"), F.lit("")) == "closed"
    shown = F.when(
        closed & C("closed_year").isNotNull(), F.concat(C("name"), F.lit(" (Closed "), C("closed_year"), F.lit(")"))
    ).when(closed, F.concat(C("name"), F.lit(" (Closed)"))).otherwise(C("name"))
    state = F.coalesce(C("state"), F.lit("MA"))
    city = F.coalesce(C("location"), F.lit(""))
    place = F.when((state != "MA") & (state != "") & (city != ""), F.concat_ws(", ", city, state)).otherwise(city)
    phone = F.when(~text.blank(C("phone")), C("phone"))
    capacity = F.when(
        (F.coalesce(C("capacity"), F.lit(0)) != 0) & ~closed, F.concat(F.lit("Capacity: "), C("capacity"))
    )
    return grouping.numbered(venues, F.lower(F.coalesce("name", F.lit("")))).select(
        "position", "id", shown.alias("display_name"), place.alias("place"), C("address"),
        F.concat_ws(" | ", phone, capacity).alias("details"),
        F.when(~closed, C("website")).alias("website"), C("notes"), closed.alias("closed"),
    )


def structured_venues(venues: DataFrame) -> DataFrame:
    """Every venue as a structured item by name; ``url`` only where there is a website."""
    address = F.struct(
        F.lit("PostalAddress").alias("@type"),
        F.coalesce("address", F.lit("")).alias("streetAddress"),
        F.coalesce("location", F.lit("")).alias("addressLocality"),
    )
    item = F.struct(
        F.lit("MusicVenue").alias("@type"), F.coalesce("name", F.lit("")).alias("name"), address.alias("address"),
        F.when(~text.blank(C("website")), C("website")).alias("url"),
    )
    rows = grouping.numbered(venues, F.lower(F.coalesce("name", F.lit(""))))
    return rows.select(
        "position", F.to_json(F.struct(F.lit("ListItem").alias("@type"), "position", item.alias("item"))).alias("item")
    )


def venue_totals(venues: DataFrame) -> DataFrame:
    closed = F.coalesce(C("status"), F.lit("")) == "closed"
    return venues.agg(
        F.count("*").alias("venues"), F.count(F.when(~closed, 1)).alias("active"), F.count(F.when(closed, 1)).alias("closed")
    )


def sitemap(df: DataFrame, as_of, site: str = "https://example.com", n: int = fx.WEEKS_AHEAD) -> DataFrame:
    """Sitemap rows: the fixed pages and one page per week, with the week's listing count."""
    spark = df.sparkSession
    fixed = spark.createDataFrame(fx.STATIC_PAGES, "page string, priority string, changefreq string")
    week = C("week_num")
    dated = grouping.by_week(df, as_of, n).select(
        F.format_string("by-date.%d.html", week).alias("page"),
        F.when(week < 4, F.lit("0.9")).when(week < 12, F.lit("0.7")).otherwise(F.lit("0.5")).alias("priority"),
        F.when(week < 4, F.lit("daily")).otherwise(F.lit("weekly")).alias("changefreq"),
        "listings",
    )
    rows = fixed.withColumn("listings", F.lit(None).cast("bigint")).unionByName(dated)
    return rows.select(
        F.concat(F.lit(site + "/"), "page").alias("loc"), F.date_format(temporal.as_date(as_of), "yyyy-MM-dd").alias("lastmod"),
        "changefreq", "priority", "listings",
    )


def digest(df: DataFrame, notified: DataFrame, as_of) -> DataFrame:
    """Notification rows: listings not notified before, else those of the next days.

    Both candidate sets are built lazily; joining the one row that names the mode
    picks between them, so the plan needs no action.
    """
    fresh = df.join(notified.select("id"), "id", "left_anti")
    soon = filters.upcoming(df, as_of)
    mode = F.when(F.count("*") > 0, F.lit("new")).otherwise(F.lit("upcoming"))
    chosen_mode = fresh.agg(mode.alias("mode"))
    tagged = fresh.withColumn("mode", F.lit("new")).unionByName(soon.withColumn("mode", F.lit("upcoming")))
    chosen = tagged.join(F.broadcast(chosen_mode), "mode")
    return chosen.select(
        "mode", "seq", "id", "date", F.date_format("date", "EEE MMM dd").alias("day_label"), "venue_name", "venue_location",
        F.when(F.size("bands") > 0, F.array_join("bands", ", ")).otherwise(F.lit("TBA")).alias("artists"),
    )


def digest_subject(rows: DataFrame, total: DataFrame, as_of, site: str = "listings") -> DataFrame:
    """Subject and subtitle of a notification, one row.

    ``total`` is the whole listing set; an empty ``rows`` means nothing is coming up.
    """
    today = temporal.as_date(as_of)
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("mode"), F.lit("upcoming")).alias("mode"), F.lit(0).cast("bigint").alias("total"))
    t = total.agg(F.lit(0).cast("bigint").alias("n"), F.lit("").alias("mode"), F.count("*").alias("total"))
    one = n.unionByName(t).agg(F.max("n").alias("n"), F.max("mode").alias("mode"), F.max("total").alias("total"))
    day = F.date_format(today, "MMM dd")
    span = F.concat(day, F.lit(" - "), F.date_format(F.date_add(today, 3), "MMM dd"))
    noun = F.when(C("n") == 1, F.lit(" new show added")).otherwise(F.lit(" new shows added"))
    total_text = F.format_number("total", 0)
    subject = F.when(
        C("mode") == "new",
        F.concat(F.lit(f"{site}: "), C("n"), noun, F.lit(", "), total_text, F.lit(" total ("), day, F.lit(")")),
    ).otherwise(F.concat(F.lit(f"{site}: Upcoming shows ("), day, F.lit(")")))
    subtitle = F.when(
        C("mode") == "new", F.concat(C("n"), noun, F.lit(" &middot; "), total_text, F.lit(" total shows listed"))
    ).otherwise(F.concat(F.lit("No new shows today &middot; Here's what's coming up ("), span, F.lit(")")))
    return one.select("mode", C("n").alias("shown"), "total", subject.alias("subject"), subtitle.alias("subtitle"))

"""Small literal payloads through the extraction jobs."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from gigmesh.schema import LISTING
from gigmesh.sources import dated_text, feeds, free_text, listings, pages, snapshots, venues

NOW = "2026-01-31 12:00:00"
DAY = "2026-01-31"


def one(spark, column, body, **more):
    names = ["seq", column, *more]
    return spark.createDataFrame([(1, body, *more.values())], ", ".join(f"{n} {'bigint' if n == 'seq' else 'string'}" for n in names))


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("seq").collect()]


def test_api_a_defaults(spark):
    event = {
        "name": "Solo", "url": "u", "dates": {"start": {"localDate": "2026-02-03", "localTime": "bad"}, "status": {"code": "onsale"}},
        "_embedded": {"venues": [{"id": "KovZpZAEekIA", "name": "Paradise"}]},
        "priceRanges": [{"min": 0, "max": 25.5}], "classifications": [{"genre": {"name": "Rock"}, "subGenre": {"name": "Rock"}}],
    }
    got = feeds.api_a_listings(one(spark, "payload", json.dumps(event)))
    assert rows(got, "venue_id", "venue_location", "bands", "price_advance", "price_door", "time", "age_requirement", "genre_tags") == [
        ("paradise", "Boston", ["Solo"], None, 25, "8pm", "18+", ["rock", "rock"])
    ]
    for code in ("cancelled", "Postponed"):
        event["dates"]["status"]["code"] = code
        assert feeds.api_a_listings(one(spark, "payload", json.dumps(event))).count() == 0


def test_api_b(spark):
    event = {
        "datetime_local": "2026-02-03T21:45:00", "title": "T", "score": 0.71, "venue": {"name": "Royale - Boston", "city": "Boston"},
        "performers": [{"name": "Pile", "genres": [{"name": "Rock"}]}, {"name": "Pile"}, {"name": "Krill", "genres": [{"name": "rock"}]}],
        "stats": {"lowest_price": 0, "highest_price": 40},
    }
    got = feeds.api_b_listings(one(spark, "payload", json.dumps(event)))
    assert rows(got, "date", "venue_id", "bands", "price_advance", "price_door", "flags", "genre_tags", "time") == [
        (dt.datetime(2026, 2, 3, 21, 45), "royale", ["Pile", "Krill"], None, 40, ["$"], ["rock"], "9pm")
    ]


def test_jsonld_local_keeps_first_per_day(spark):
    event = {"@type": "Event", "name": "Pile (live set)", "startDate": "2026-03-01T19:00:00", "offers": [{"lowPrice": "12.50"}]}
    html = "<script type='application/ld+json'>" + json.dumps([event, event, {**event, "@type": "Place"}]) + "</script>"
    got = feeds.jsonld_listings(one(spark, "html", html), as_of=DAY, local=True, venue=("v", "V", "Boston", "link"), source="s")
    assert rows(got, "bands", "time", "price_advance", "source_url") == [(["Pile"], "7pm", 12, "link")]


def test_jsonld_utc_and_venue_map(spark):
    event = {"@type": "MusicEvent", "name": "Krill", "startDate": "2026-07-01T00:00:00Z", "location": {"name": "The Sinclair"}, "performer": {"name": "Pile"}}
    got = feeds.jsonld_listings(one(spark, "html", f'<script type="application/ld+json">{json.dumps(event)}</script>'), as_of=DAY)
    assert rows(got, "date", "time", "venue_id", "venue_location", "bands") == [
        (dt.datetime(2026, 6, 30, 20), "8pm", "sinclair", "Cambridge", ["Krill", "Pile"])
    ]


def test_ical_unfolds_and_skips(spark):
    ics = (
        "BEGIN:VCALENDAR\nBEGIN:VEVENT\nDTSTART;VALUE=DATE:20260301\nSUMMARY:Pile with\n  Krill\\, and Bane\nDESCRIPTION:$10 / $12\nEND:VEVENT\n"
        "BEGIN:VEVENT\nDTSTART:20260302T193000\nSUMMARY:Workshop\nSUMMARY:Ballet gala\nEND:VEVENT\n"
        "BEGIN:VEVENT\nDTSTART:20260303T193000\nSUMMARY:Private Event\nEND:VEVENT\nEND:VCALENDAR\n"
    )
    got = feeds.ical_listings(one(spark, "ics", ics, venue="firehouse"), now=NOW)
    assert rows(got, "date", "bands", "price_advance", "price_door", "time") == [
        (dt.datetime(2026, 3, 1), ["Pile", "Krill,", "Bane"], 10, 12, "8pm")
    ]


def test_club_calendar_moves_five_hours(spark):
    ics = "BEGIN:VEVENT\r\nDTSTART:20260702T030000Z\r\nSUMMARY:A1/B2 - Late Set\r\nDESCRIPTION:free\r\nEND:VEVENT\r\n"
    got = feeds.club_calendar_listings(one(spark, "ics", ics), now=NOW)
    assert rows(got, "date", "time", "bands", "price_advance") == [(dt.datetime(2026, 7, 1), "10pm", ["A1", "B2"], 0)]


def test_embedded_json(spark):
    data = {"1": {"title": "Live: Pile & Krill", "date_and_time": "02/08/2026 8:00 pm", "show_string": "8PM", "cost": "", "sold_out": True},
            "2": {"title": "Club Closed", "date_and_time": "02/09/2026 8:00 pm"}}
    got = feeds.embedded_listings(one(spark, "html", f"<script>var remEvents = {json.dumps(data)};</script>"), now=NOW)
    assert rows(got, "date", "bands", "price_advance", "flags") == [(dt.datetime(2026, 2, 8, 20), ["Pile", "Krill"], 0, ["SOLD OUT"])]


def test_rss(spark):
    xml = "<item><title><![CDATA[Toad: Saturday Revival with 'Niall']]></title><description>Sat &amp;amp; Friday, January 30, 2026 Feb 6, 2026 February 7, 2026 9:30 pm free</description></item>"
    got = feeds.rss_listings(one(spark, "xml", xml), now="2026-01-01 00:00:00")
    assert rows(got, "venue_id", "bands", "date", "time", "price_advance", "age_requirement") == [
        ("toad", ["Niall"], dt.datetime(2026, 1, 30), "9:30pm", 0, "21+")
    ]


@pytest.mark.parametrize(
    "line, want",
    [
        ("Ratboys at Wanna Hear It Records, Watertown 1/29 8pm", (["Ratboys"], "wanna_hear_it", "Watertown", dt.date(2026, 1, 29), "8pm", None, "a/a")),
        ("Pile, Krill @ Deep Cuts 2/15 $15 21+", (["Pile", "Krill"], "deepcuts", "Boston", dt.date(2026, 2, 15), "8pm", 15, "21+")),
        ("Converge w/ Cave In - Roadrunner 4/1 $30", (["Converge", "Cave In"], "roadrunner", "Boston", dt.date(2026, 4, 1), "8pm", 30, "a/a")),
        ("A & B at Odd Spot, Lowell MA January 2 20:30 all ages", (["A", "B"], "odd_spot", "Lowell", dt.date(2027, 1, 2), "8:30pm", None, "a/a")),
        ("Just a place", ([], "just_a_place", "Boston", dt.date(2026, 1, 31), "8pm", None, "a/a")),
        ("X at Y 13/45", (["X"], "y_1345", "Boston", dt.date(2026, 1, 31), "8pm", None, "a/a")),
    ],
)
def test_free_text_lines(spark, line, want):
    r = free_text.line_listings(one(spark, "line", line), as_of=DAY).first()
    assert (r.bands, r.venue_id, r.venue_location, r.date.date(), r.time, r.price_advance, r.age_requirement) == want


PAGES = {
    "safe_in_a_crowd": (
        "<p><strong>Friday, February 6th:</strong> Who Remembers, Goin' Ape at Pyxis in Providence, RI 7:00pm/$10/16+ SOLD OUT</p><p><strong>Note</strong> x at y in z</p>",
        [(dt.datetime(2026, 2, 6), ["Who Remembers", "Goin' Ape"], "pyxis", "7pm", 10)],
    ),
    "axs_venues": (
        '<div class="view-events"><div class="views-row"><div class="title">Jam Night - Live!</div><time datetime="2026-02-03T19:30:00-05:00">x</time>'
        '<div class="field--name-field-event-venue-title">Venue Title Cafe 939</div><a href="/events/x">more</a></div></div>',
        [(dt.datetime(2026, 2, 3, 19, 30), ["Jam Night"], "cafe939", "7:30pm", None)],
    ),
    "soundcheck_studios": (
        '<div class="ec-col-item"><h3 class="title">Queens (A Tribute to Queen and Friends)</h3><p class="start-date">April 3, 2026</p><a class="webflow-link" href="/e">x</a></div>',
        [(dt.datetime(2026, 4, 3), ["Queens (A Tribute to Queen and Friends)"], "soundcheck_studios", "8pm", None)],
    ),
    "jazzboston": (
        '<div class="eli_row"><h4 class="eli_title"><a href="/e1">JB presents: Trio One and Duo</a><div class="hidden">02-22-2026</div></h4>'
        '<span class="eli_address">Presented by X at Lilypad, Cambridge</span> Upcoming @ 7:30 pm</div>' * 2,
        [(dt.datetime(2026, 2, 22), ["Trio One", "Duo"], "lilypad", "7pm", None)],
    ),
    "narrows_center": (
        '<td><span class="display-perfname">Big Act</span><span class="display-date">Feb 20, 2026</span><span class="display-perftime">8:00 PM</span><b class="display-perfprice">$35</b></td>'
        '<td><span class="display-perfname">Next</span><span class="date">Feb 21, 2026</span></td>'
        '<td><span class="date">March 5, 2026</span><span class="display-perfname">No More Heroes</span></td>'
        '<td><span class="date">March 6, 2026</span><span class="display-perfname">More Details</span></td>'
        '<td><span class="date">March 7, 2026</span><span class="display-perfname">Details</span></td>',
        [(dt.datetime(2026, 2, 20), ["Big Act"], "narrowscenter", "8pm", 35), (dt.datetime(2026, 3, 5), ["No More Heroes"], "narrowscenter", "7:30pm", None),
         (dt.datetime(2026, 3, 6), ["More Details"], "narrowscenter", "7:30pm", None)],
    ),
    "club_delf": (
        '<table><tr class="gigpress-row"><td class="gigpress-date">02/12/26</td><td class="gigpress-venue"><a>Lizard Lounge</a></td><td class="gigpress-city">Cambridge</td></tr>'
        '<tr class="gigpress-info"><td>Time: 9:30pm</td></tr></table>',
        [(dt.datetime(2026, 2, 12), ["Club d'Elf"], "lizardlounge", "9:30pm", None)],
    ),
    "city_winery": (
        '<div class="event-card"><h3 class="event-title">Singer</h3> Feb 14th 7:30 PM <a href="https://tickets.citywinery.com/event/singer-abc123">buy</a></div>',
        [(dt.datetime(2026, 2, 14), ["Singer"], "city_winery", "7:30pm", None)],
    ),
    "sofar_sounds": (
        '<a href="/events/63920"><span>Sat Feb 7</span><b>Fenway</b><i>Rooftop</i><i>BYOB</i><i>Special!</i></a>',
        [(dt.datetime(2026, 2, 7), ["TBA"], "sofar_sounds", "8pm", 29)],
    ),
    "sanctuary_maynard": (
        '<div class="event"><h3 class="event-name">Duo with Trio</h3><div class="event-details">Sat, Feb 28, 2026 7:00 PM start $24–$34 online $26 in-person</div><a class="btn" href="/b">t</a></div>',
        [(dt.datetime(2026, 2, 28), ["Duo", "Trio"], "sanctuary", "7pm", 24)],
    ),
    "hobgoblin": (
        '<a href="/event/1">2/5 Mikayla duo with Kazuki</a><a href="/event/2">2/6 CANCELLED x</a>',
        [(dt.datetime(2026, 2, 5), ["Mikayla duo", "Kazuki"], "hobgoblin", "8pm", None)],
    ),
    "do617": (
        '<article class="event"><h2>Pile w/ Krill</h2><p class="date">Feb 9, 2026</p><p class="venue">Great Scott Cambridge</p><p class="time">9pm</p><p class="price">Free</p></article>',
        [(dt.datetime(2026, 2, 9), ["Pile", "Krill"], "greatscott", "9pm", 0)],
    ),
    "middle_east": (
        '<div class="show-listing"><h3>Pile + Krill</h3><p>Feb. 10 upstairs 9pm $12/$15</p></div>',
        [(dt.datetime(2026, 2, 10), ["Pile", "Krill"], "middleeast", "9pm", 12)],
    ),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page_sources(spark, name):
    html, want = PAGES[name]
    got = pages.extract(one(spark, "html", f"<html><body><nav>x</nav>{html}</body></html>"), pages.page_sources()[name], NOW)
    assert rows(got, "date", "bands", "venue_id", "time", "price_advance") == want


def test_tour_site_skips_past_section(spark):
    li = '<li title="Saturday 28 February 2026"><p class="artists"><span><strong>Pile</strong> Hey, I\'m Outside, and Krill</span></p></li>'
    html = f"<h2>Upcoming</h2><ul class='event-listings'>{li}{li}</ul><h2>Past concerts</h2><ul class='event-listings'>{li.replace('28', '27')}</ul>"
    got = pages.tour_site_listings(one(spark, "html", html, venue="lilypad"), NOW)
    assert rows(got, "venue_name", "bands", "age_requirement") == [("The Lilypad", ["Pile", "Hey", "I'm Outside", "Krill"], "a/a")]


def test_orchestra_explodes_performances(spark):
    perf = lambda d: f'<div class="event-tease__performance"><span class="event-tease__performance-date">{d}</span><span class="event-tease__performance-year">2026</span><span class="event-tease__performance-time">Mon, 4:00pm</span></div>'
    html = f'<article class="event-tease tanglewood"><h3 class="event-tease__headline">A and B</h3><a class="event-tease__link" href="/e">x</a>{perf("Feb 19")}{perf("Feb 20")}</article>'
    got = pages.orchestra(one(spark, "html", html), NOW)
    assert rows(got, "date", "bands", "venue_location", "time") == [
        (dt.datetime(2026, 2, 19), ["A and B"], "Lenox", "4pm"), (dt.datetime(2026, 2, 20), ["A and B"], "Lenox", "4pm"),
    ]


def test_month_calendar(spark):
    row = lambda t, e: f'<div class="row"><div class="flex_item_left">{t}</div><div class="event"><a>{e}</a></div> $5</div>'
    html = f'<div class="day" id="20260205"><div class="entries">{row("4-6pm", "A1 w/ B2")}{row("10pm", "Trivia Night")}{row("10pm", "Solo")}</div></div><div class="day" id="x"></div>'
    got = pages.month_calendar(one(spark, "html", html), NOW)
    # A range keeps its start, which has no am/pm and falls back.
    assert rows(got, "bands", "time", "price_door") == [(["A1", "B2"], "8pm", 5), (["Solo"], "10pm", 5)]


TEXTS = [
    ("bold_listings", "<b>February 6, 2026 (Friday)</b> <b>Pile, Krill</b> at The Jungle 9pm $10 21+<br><b>more</b> at x", [(dt.datetime(2026, 2, 6), ["Pile", "Krill"], "jungle", "9pm", 10)]),
    ("line_listings", "<p>Fri, Feb 6</p><p>Pile, Krill 9pm $10/$12</p><p>no show</p>", [(dt.datetime(2026, 2, 6), ["Pile", "Krill"], "middleeast", "9pm", 10)]),
    ("pub_listings", "<p>Sunday Febr</p><p>uary 8</p><p>730pm</p><p>The Duo $5</p><p>No-Cover</p>", [(dt.datetime(2026, 2, 8), ["The Duo"], "sallyobriens", "7:30pm", 0)]),
    ("title_before_date_listings", "<p>Big Night - Tickets</p><p>The Bebop</p><p>12</p><p>Saturday, February 7, 2026, 10:30 PM</p>", [(dt.datetime(2026, 2, 7), ["Big Night"], "bebop", "10:30pm", None)]),
    ("context_listings", "<p>Menu</p><p>Loud Act</p><p>Feb 7</p><p>Doors 6pm</p><p>7:30 PM $20</p>", [(dt.datetime(2026, 2, 7), ["Loud Act"], "falloutshelter", "7pm", 20)]),
    ("next_line_listings", "<p>February 7, 2026</p><p>Big Act and Friends</p><p>Feb 8</p><p>Next</p>", [(dt.datetime(2026, 2, 7), ["Big Act", "Friends"], "narrowscenter", "7:30pm", None)]),
]


@pytest.mark.parametrize("name, html, want", TEXTS, ids=[t[0] for t in TEXTS])
def test_dated_text(spark, name, html, want):
    got = getattr(dated_text, name)(one(spark, "html", html), DAY)
    assert rows(got, "date", "bands", "venue_id", "time", "price_advance") == want


def test_long_pages_stay_apart(spark):
    """Positions from 100000 on: the next page's numbers, but not its rows."""
    entry = "\nMonday, March 2\nThe Middle East\nLoud Act\n\n"
    texts = [(1, "\n" * 100_000 + entry), (2, entry)]
    df = spark.createDataFrame(texts, "seq bigint, text string")
    assert dated_text.session_listings(df, DAY, html="text").count() == 2


def test_strategies_are_chosen_by_page(spark, monkeypatch):
    every, f = pages.F.posexplode, pages.F
    # The first page gets 100000 blocks before its own.
    before = f.array_repeat(f.lit(""), f.when(f.col("seq") == 1, 100_000).otherwise(0))
    monkeypatch.setattr(f, "posexplode", lambda c: every(f.concat(before, c)))
    fields = lambda block, now: {"date": f.regexp_extract(block, r"(\d{4}-\d\d-\d\d)", 1).try_cast("timestamp_ntz"), "bands": f.array(f.lit("Act"))}
    shared = {"venue_id": f.lit("v"), "venue_name": f.lit("V"), "venue_location": f.lit("C")}
    source = pages.PageSource("x", "scrape:x", [r"<li\b[^>]*>", r"<p\b[^>]*>"], [fields, fields], [], None, shared)
    df = spark.createDataFrame([(1, "<li>2026-03-01</li>"), (2, "<p>2026-03-02</p>")], "seq bigint, html string")
    out = pages.extract(df, source, NOW)
    assert sorted(r.date.day for r in out.collect()) == [1, 2] and "page" not in out.columns


def test_each_fallback_level_wins_on_its_page(spark):
    """One page for each strategy of the arts center; a page also holds what all later strategies would read."""
    forms = [
        '<td><b class="display-perfname">One</b><i class="date">May 1, 2026</i></td>', '<p class="event-item"><b class="title">Two</b><i class="date">May 2, 2026</i></p>',
        '<li>May 3, 2026 <a href="/ordertickets?1">Three</a></li>', "<p>May 4, 2026</p><p>Four &amp;amp; Co</p><p>May 5, 2026</p><p>Sold out</p>",
    ]
    made = [(k, "<p>menu</p>" + "".join(forms[k:])) for k in range(4)] + [(4, "<p>May 6, 2026</p>"), (5, ""), (6, None)]
    df = spark.createDataFrame(made, "seq bigint, html string")
    out = pages.extract(df, pages.page_sources()["narrows_center"], NOW)
    assert sorted((r.seq.document, r.bands[0], r.date.day) for r in out.collect()) == [(0, "One", 1), (1, "Two", 2), (2, "Three", 3), (3, "Four &amp; Co", 4)]
    plan = pages._page_rows(df, pages.page_sources()["narrows_center"], NOW, "html")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(?m)^\W*(?:\*\(\d+\) )?(?:Window|Union|Exchange|\w*Join)\b", plan) and plan.count("Scan ") <= 1


def test_sessions_skip_the_check_when_a_date_closes_them(spark):
    entry = "Sunday, February 8 2026, 5:00 pm\nMidway Cafe\nPile, Krill\ntickets $5\n"
    got = dated_text.session_listings(one(spark, "text", entry + entry + "\n" + entry + "\nstray line\n" + entry), DAY, html="text")
    # The first entry is closed by a date line and never checked; later repeats collapse to one.
    assert rows(got, "bands", "venue_id", "time") == [(["Pile", "Krill"], "midway", "5:00pm")] * 2


def test_manual_and_json_round_trip(spark, folder):
    first = free_text.line_listings(one(spark, "line", "Pile @ Deep Cuts 2/15 $15 21+"), as_of=DAY)
    listings.append_manual(first, f"{folder}/manual")
    listings.append_manual(first, f"{folder}/manual")
    stored = spark.read.parquet(f"{folder}/manual")
    assert stored.count() == 2
    listings.write_json(stored, f"{folder}/json")
    back = listings.read_json(spark, f"{folder}/json")
    assert {r.id for r in back.collect()} == {r.id for r in first.collect()}
    doc = json.loads(spark.read.text(f"{folder}/json").first()[0])
    assert doc["day_of_week"] == "Sun" and doc["price"] == {"advance": 15, "door": None, "display": "$15"}


def test_nested_defaults(spark, folder):
    with open(f"{folder}/a.json", "w") as f:
        json.dump({"date": "2026-02-03T20:00:00", "id": "keep", "bands": ["X"]}, f)
    r = listings.read_json(spark, f"{folder}/a.json", multiline=True).first()
    assert (r.id, r.age_requirement, r.time, r.flags, r.price_advance, r.venue_id) == ("keep", "a/a", "8pm", [], None, "")


def test_write_snapshot(spark, folder):
    rows_ = free_text.line_listings(one(spark, "line", "Pile @ Deep Cuts"), as_of=DAY)
    listings.write_snapshot(rows_, folder, DAY)
    assert spark.read.parquet(f"{folder}/meta").first().total == 1


def test_source_union_survives_a_failing_source(spark):
    good = lambda s: free_text.line_listings(one(s, "line", "Pile @ Deep Cuts"), as_of=DAY)

    def bad(s):
        raise OSError("down")

    reg = listings.SourceRegistry()
    reg.register("late", good, rank=5)
    reg.register("bad", bad, rank=1)
    reg.register("early", good, rank=0)
    got, errors = reg.union(spark)
    assert sorted(r.seq for r in got.collect()) == [0, 1]
    assert [r.source for r in errors.collect()] == ["bad"]


def test_source_that_fails_while_it_runs_costs_only_itself(spark, folder):
    def corrupt(s):
        import os

        os.makedirs(f"{folder}/bad", exist_ok=True)
        with open(f"{folder}/bad/part.parquet", "wb") as out:
            out.write(b"no parquet at all, but long enough to be opened")
        return s.read.schema(LISTING).parquet(f"{folder}/bad")

    def cast(s):
        rows = free_text.line_listings(one(s, "line", "Pile @ Deep Cuts"), as_of=DAY)
        return rows.withColumn("price_door", F.expr("cast(concat(venue_name, 'x') as int)"))

    good = lambda s: free_text.line_listings(one(s, "line", "Pile @ Deep Cuts"), as_of=DAY)
    reg = listings.SourceRegistry()
    for name, read in (("first", good), ("corrupt", corrupt), ("cast", cast), ("last", good)):
        reg.register(name, read)
    got, errors = reg.union(spark)
    assert sorted(r.seq for r in got.collect()) == [0, 1]
    assert [r.source for r in errors.collect()] == ["corrupt", "cast"]


def test_many_events_in_a_block_and_many_partitions_keep_their_places(spark):
    event = '{"@type":"MusicEvent","name":"Act %d","startDate":"2026-02-01T20:00:00","location":{"name":"Hall"}}'
    body = "[" + ",".join(event % i for i in range(1001)) + "]"
    html = f'<script type="application/ld+json">{body}</script><script type="application/ld+json">{event % 5000}</script>'
    out = feeds.jsonld_listings(one(spark, "html", html), as_of="2026-01-01")
    assert out.count() == 1002 == out.select("seq").distinct().count()
    reg = listings.SourceRegistry()
    reg.register("a", lambda s: out)
    reg.register("b", lambda s: out)
    rows = reg.union(spark)[0].select("seq", "bands").collect()
    assert sorted(r.seq for r in rows) == list(range(2004))
    acts = [r.bands[0] for r in sorted(rows, key=lambda r: r.seq)]
    assert acts[:1002] == [f"Act {i}" for i in (*range(1001), 5000)] == acts[1002:]


def test_numbers_follow_the_order_over_partitions(spark):
    from gigmesh.operators.numbering import numbered

    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("k"))
    rows = numbered(df.repartition(40), "k", name="n").collect()
    assert all(r.n == r.k for r in rows) and len(rows) == 20_000
    # One very frequent key, and an empty table.
    same = numbered(spark.range(5000).select(F.lit(1).alias("k")), "k", name="n")
    assert sorted(r.n for r in same.collect()) == list(range(5000))
    assert numbered(df.where("k < 0"), "k").count() == 0


def test_fixed_recurring_schedule(spark):
    got = listings.recurring(listings.fixed_schedule(spark), "2026-01-31").collect()
    # Four weeks: 4 early sets, 5 late sets and one jam per week.
    assert len(got) == 4 * (4 + 5 + 1)
    assert {r.date.hour for r in got} == {19, 20, 22} and {r.age_requirement for r in got} == {"21+"}


def test_venues(spark, folder):
    with open(f"{folder}/v.json", "w") as f:
        json.dump({"venues": [{"id": "a", "name": "Old"}, {"name": "no id"}, {"id": "a", "name": "New", "id_variants": ["A One"]}]}, f)
    got = venues.read_venues(spark, f"{folder}/v.json").collect()
    assert [(r.id, r.name) for r in got] == [("a", "New")]
    assert venues.default_venues(spark).count() == 11


def test_snapshots(spark, folder):
    rows_ = free_text.line_listings(one(spark, "line", "Pile @ Deep Cuts"), as_of=DAY)
    snapshots.save(rows_, folder, "scrape:x", "2026-01-31 00:00:00")
    snapshots.save(rows_.limit(0), folder, "scrape:x", "2026-01-31 06:00:00", keep_empty=False)
    assert snapshots.load(spark, folder, "scrape:x", "2026-01-31 11:00:00").count() == 1
    assert snapshots.load(spark, folder, "scrape:x", "2026-01-31 13:00:00") is None
    snapshots.save(rows_.limit(0), folder, "scrape:x", "2026-01-31 12:30:00")
    assert snapshots.load(spark, folder, "scrape:x", "2026-01-31 13:00:00", ttl_hours=0).count() == 0
    snapshots.clear(spark, folder)
    assert snapshots.load(spark, folder, "scrape:x", "2026-01-31 13:00:00") is None

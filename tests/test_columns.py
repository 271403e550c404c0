"""Hand-computed cases for column functions, quirks included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gigmesh.functions import temporal, text
from gigmesh.operators import filters, normalize

NBSP = " "


def cases(evaluate, fn, table, schema="string"):
    assert evaluate(fn, list(table), schema=schema) == list(table.values())


def test_clean_text(evaluate):
    cases(evaluate, text.clean_text, {f"  a {NBSP} b\n\tc ": "a b c", None: "", "": ""})


def test_normalize_bands(evaluate):
    given = [
        ["The Band", "CONVERGE", "X-RAY 2A", "the the Pile", " Jerry's Kids ", "bosstones", "DYS", "", None],
        ["JERRY'S KIDS", "Dinosaur Jr", "Steve Miller Band", "The The"],
        ["Fête", "ÉCLAIR"],
    ]
    # "The Band" loses its suffix first, shouted names are title-cased after any non-letter.
    want = [
        ["Band", "Converge", "X-Ray 2A", "The Pile", "Jerry's Kids", "The Mighty Mighty Bosstones", "DYS"],
        ["Jerry'S Kids", "Dinosaur Jr.", "Steve Miller", "The"],
        ["Fête", "Éclair"],
    ]
    assert evaluate(text.normalize_bands, given, schema="array<string>") == want


def test_id_headliner(evaluate):
    cases(
        evaluate,
        text.id_headliner,
        {
            "Club d'Elf ft. Duke Levine & Kevin Barry": "club delf",
            "Kenny - The Tour 2026": "kenny",
            "Pile - 2026 edition": "pile",
            "Krill (late show)": "krill",
            "Bane: Live at Last": "bane",
            "Fête!": "fête",
            "Big D and the Kids Table": "big d",
            "A" * 40: "a" * 30,
        },
    )


def test_stable_id(evaluate):
    import hashlib

    got = evaluate(
        lambda d, v, b, t: text.stable_id(d, v, b, t),
        [dt.datetime(2026, 1, 24), dt.datetime(2026, 1, 24)], ["paradise", "x"], [["Pile"], []], ["8pm", ""],
        schema=["timestamp_ntz", "string", "array<string>", "string"],
    )
    want = [hashlib.md5(s.encode()).hexdigest()[:12] for s in ("2026-01-24|paradise|pile|8pm", "2026-01-24|x|unknown|tba")]
    assert got == want


def test_resolver_key(evaluate):
    cases(
        evaluate, text.resolver_key,
        {"The Sinclair - Cambridge, MA": "sinclair", "Jam, The": "jam", "  Royale–Boston ": "royale", "O'Brien's  Pub": "obriens pub", "!!!": "", "Fête": "fête"},
    )


def test_split_bands(evaluate):
    cases(
        evaluate, text.split_bands,
        {
            "A1 w/ B2 and C3 + D4 / E5 | F6, G7": ["A1", "B2", "C3", "D4", "E5", "F6", "G7"],
            "Pile AND Krill": ["Pile AND Krill"],
            "X, Yo": ["Yo"],
            "": [],
            None: [],
        },
    )
    cases(evaluate, text.split_bands_any_case, {"Pile AND Krill & X": ["Pile", "Krill", "X"], "": []})


def test_split_bands_slash(evaluate):
    cases(evaluate, text.split_bands_slash, {"A1 WITH B2": ["A1", "B2"], "A1, B2": ["A1", "B2"], "A1 / B2, C3": ["A1", "B2, C3"], "A": ["A"]})
    limited = lambda c: text.split_bands_slash(c, max_commas=3)
    cases(evaluate, limited, {"A1, B2": ["A1", "B2"], "a, b, c, d, ee": ["a, b, c, d, ee"], "1,000 Cranes": ["1,000 Cranes"]})


@pytest.mark.parametrize(
    "mode, table",
    [
        ("scraper", {"Free!": (0, 0), "$15-$20": (15, 20), "$19.99": (19, 19), "tba": (None, None), "": (None, None), "$15 adv / $20 door": (15, 20)}),
        ("line", {"x $15/$20": (15, 20), "$15-20": (15, 20), "$15": (15, None), "15": (None, None)}),
        ("pair", {"$10 / $15": (10, 15), "$10": (10, 10), "free": (None, None)}),
        ("free_pair", {"No Cover": (0, 0), "suggested donation $5": (0, 0), "$7": (7, 7)}),
        ("words", {"$15 in advance. $20 at the door": (15, 20), "$18 DOS": (18, 18), "free, $5 drinks": (0, 0), "$5 free": (5, 5), "x": (None, None)}),
        ("cost", {"": (0, 0), "0": (0, 0), "33": (33, 33), "33.9": (33, 33), "abc": (None, None)}),
    ],
)
def test_prices(evaluate, mode, table):
    got = evaluate(lambda c: text.parse_price(c, mode), list(table))
    assert [(r["advance"], r["door"]) for r in got] == list(table.values())


def test_price_display_hides_zero(evaluate):
    got = evaluate(text.price_display, [10, 10, None, 0, 0], [15, None, 15, 0, 20], schema="int")
    assert got == ["$10/$15", "$10", "$15", "", "$20"]
    assert evaluate(text.is_free, [0, None, 5], [None, 0, None], schema="int") == [True, True, False]


def test_times(evaluate):
    cases(evaluate, temporal.normalize_time, {"8:30": "8pm", "12:00": "0pm", "8:00 PM": "8pm", "": "8pm", None: "8pm", "Late": "late", "20:30": "8pm", "7:30pm": "7:30pm"})
    cases(evaluate, temporal.parse_time, {"Doors 7:30 PM": "7pm", "20:00": "8pm", "0:30": "12am", "12": "12pm", "late": "8pm", "11am": "11am", None: "8pm"})
    cases(evaluate, temporal.parse_time_minutes, {"7:30 PM": "7:30pm", "8:00pm": "8pm", "20:00": "8pm"})
    cases(evaluate, temporal.time_to_minutes, {"8": 480, "8pm": 1200, "12am": 0, "12pm": 720, "late": -1, None: -1, " 7:15pm": 1155})
    cases(evaluate, temporal.time_sort_key, {"": 1200, "late": 1200, "7pm": 1140})
    assert evaluate(temporal.times_similar, ["11:30pm", "7pm", "late", "8pm"], ["12:15am", "8pm", "LATE", "9:01pm"]) == [False, True, True, False]


def test_ages(evaluate):
    cases(evaluate, text.normalize_age, {"All Ages": "a/a", "21+": "21+", "18 and over": "18+", "16+": "a/a", "AA": "a/a", None: "a/a"})
    cases(evaluate, lambda c: text.parse_age(c, "words"), {"all ages": "a/a", "21 and over": "21+", "": "21+", "18+": "18+"})
    cases(evaluate, lambda c: text.parse_age(c, "words_or_18"), {"": "18+", "a/a": "a/a"})
    cases(evaluate, lambda c: text.parse_age(c, "grammar"), {"/16+": "16+", "": "a/a"})


def test_slugs_and_keys(evaluate):
    cases(evaluate, lambda c: text.slug(c, "api"), {"O'Brien's Pub, Inc.": "obriens_pub_inc", "a" * 40: "a" * 30})
    cases(evaluate, lambda c: text.slug(c, "runs"), {"Fête & Co!": "f_te_co"})
    cases(evaluate, lambda c: text.slug(c, "line"), {"Café  Amore!": "café_amore"})
    cases(evaluate, lambda c: text.slug(c, "hyphen"), {"Royale - Boston": "royale-boston"})
    cases(evaluate, text.band_key, {" Vein.fm, ": "veinfm", "Jerry's": "jerrys"})
    cases(evaluate, text.band_anchor, {"Ke$ha & Fête.": "kesha_and_fête"})
    cases(evaluate, text.snapshot_key, {"scrape:é/x-1_": "scrape_é_x-1_"})
    cases(evaluate, text.html_escape, {"<a & 'b\">": "&lt;a &amp; &#x27;b&quot;&gt;"})
    cases(evaluate, text.unescape_ical, {r"a\, b\; c\: d\\e\nf": "a, b; c: d\\e\nf"})


def test_venue_rules(evaluate):
    def vid(v, n):
        return F.coalesce(normalize.venue_id_by_rule(v, n), normalize.venue_id_fallback(v))

    ids = ["", "O’Brien", "sally_obriens", "Middle-East", "middle_east", "middleeast", "Deep Cuts", "middleeast"]
    names = ["", "", "", "ME Upstairs", "The Corner", "ZuZu", "", None]
    assert evaluate(vid, ids, names) == [
        "unknown", "obriens", "sallyobriens", "middleeast_up", "middleeast_corner", "middleeast_zuzu", "deep_cuts", "middleeast",
    ]
    cases(evaluate, normalize.venue_name, {"PARADISE": "Paradise Rock Club", " odd ": " odd ", "": "Unknown Venue", None: "Unknown Venue"})
    cases(evaluate, normalize.location, {"": "Boston", "Orlando": "Boston", "derry, NH": "Derry, NH", " Lowell ": "Lowell", None: "Boston"})


def test_year_rules(evaluate):
    rule = lambda r, as_of: (lambda m, d: temporal.infer_year(m, d, as_of, r))
    assert evaluate(rule("two_weeks", "2026-01-20"), [1, 1, 2], [6, 5, 30], schema="int") == [dt.date(2026, 1, 6), dt.date(2027, 1, 5), None]
    assert evaluate(rule("any_past", "2026-01-20"), [1, 1], [20, 19], schema="int") == [dt.date(2026, 1, 20), dt.date(2027, 1, 19)]
    assert evaluate(rule("earlier_month", "2026-03-20"), [3, 2], [1, 28], schema="int") == [dt.date(2026, 3, 1), dt.date(2027, 2, 28)]
    assert evaluate(rule("none", "2026-03-20"), [1], [1], schema="int") == [dt.date(2026, 1, 1)]


def test_parse_date(evaluate):
    def day(c):
        return F.to_date(temporal.parse_date(c, now_year=2026))

    cases(
        evaluate, day,
        {"Jan 24, 2026": dt.date(2026, 1, 24), "1/24/2026": dt.date(2026, 1, 24), "2026-01-24": dt.date(2026, 1, 24),
         "Friday, January 24": dt.date(2026, 1, 24), "Fri Jan 24": dt.date(2026, 1, 24), "soon": None},
    )


def test_weeks(evaluate):
    days = [dt.datetime(2026, 1, 26), dt.datetime(2026, 2, 1, 23), dt.datetime(2026, 2, 2), dt.datetime(2025, 12, 1)]
    assert evaluate(lambda c: temporal.week_number(c, "2026-01-31"), days, schema="timestamp_ntz") == [0, 0, 1, 0]
    labels = evaluate(lambda c: temporal.adjusted_week_label(c, "2026-01-31"), days[:3], schema="timestamp_ntz")
    assert labels == ["Jan 31 - Feb 1", "Jan 31 - Feb 1", "Feb 2 - Feb 8"]


def test_wall_time(evaluate):
    assert evaluate(temporal.strip_tz, ["2026-07-01T19:30:00-04:00"]) == [dt.datetime(2026, 7, 1, 19, 30)]
    got = evaluate(temporal.utc_to_eastern, [dt.datetime(2026, 7, 1, 0), dt.datetime(2026, 1, 1, 0)], schema="timestamp_ntz")
    assert got == [dt.datetime(2026, 6, 30, 20), dt.datetime(2025, 12, 31, 19)]


def test_tag_verdict(evaluate):
    tags = [["pop punk"], ["jazz", "punk"], ["noise"], ["folk"], [], ["K-Pop"]]
    # Substrings decide: "noise" holds "oi".
    assert evaluate(filters.tag_verdict, tags, schema="array<string>") == [True, False, True, None, None, False]


def test_music_label(evaluate):
    cases(evaluate, filters.music_label, {"Trivia Night": "other", "Trivia and Live Music": "music", "Quiet evening": "unknown"})


def test_lookahead_modes(spark):
    df = spark.createDataFrame([(1, dt.datetime(2026, 1, 31)), (2, dt.datetime(2026, 1, 30)), (3, dt.datetime(2026, 1, 30, 20)), (4, dt.datetime(2027, 1, 1))], "i int, date timestamp_ntz")
    now = "2026-01-31 15:00:00"
    got = {m: sorted(r.i for r in filters.lookahead(df, now, m).collect()) for m in ("from_now", "from_today", "from_yesterday", "open")}
    assert got == {"from_now": [], "from_today": [1], "from_yesterday": [1, 3], "open": [1, 4]}


def test_upcoming_spans_four_days(spark):
    df = spark.createDataFrame([(i, dt.datetime(2026, 1, 1 + i, 22)) for i in range(6)], "i int, date timestamp_ntz")
    assert sorted(r.i for r in filters.upcoming(df, "2026-01-02").collect()) == [1, 2, 3, 4]


def test_html_unescape_follows_the_standard(evaluate):
    import html
    import random

    r = random.Random(4)
    names = ["amp", "eacute", "NotEqualTilde", "ngE", "copy", "nosuch", "fjlig", "notit", "notin"]
    given = [None, "", "plain", "&", "&;", "a&&b", "Caf&eacute; Tacvba &#8217;n&#8217; Friends &ndash; &rsquo;77", "&#0; &#55296; &#1114112; &#x110000; &#99999999999;"]
    for _ in range(200):
        kind = [f"&{r.choice(names)}{r.choice([';', ''])}", f"&#{r.choice([38, 39, 128, 146, 233, 8217, 128512])}{r.choice([';', ''])}", f"&#x{r.choice(['e9', '1F600', '2019'])};", "x", " ", "&amp;lt;"]
        given.append("".join(r.choices(kind, k=5)))
    assert evaluate(text.html_unescape, given) == [None if g is None else html.unescape(g) for g in given]

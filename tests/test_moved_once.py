"""Listings are moved, parsed and lower-cased once per query."""

from pyspark.sql import functions as F

from gigmesh.operators import filters, lines
from gigmesh.operators.normalize import normalize_listings
from gigmesh.plans import views
from gigmesh.sources import feeds


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_priority_names_are_tested_in_their_row(spark):
    """F16, F17, F20: the flag came from a join of all listings with their exploded names."""
    df = spark.createDataFrame([(1, ["x", "Red Bolt"]), (2, ["green nuts"]), (3, []), (4, None), (5, [None, "HOT GEAR"])], "seq bigint, bands array<string>")
    out = filters.with_priority_flag(df, ["red bolts", "hot gear"])
    assert {r["seq"]: r["has_priority_band"] for r in out.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert "Join" not in _plan(out) and "Aggregate" not in _plan(out)
    names = {r["band"] for r in filters.priority_names(df.where("bands IS NOT NULL"), ["red bolts", "hot gear"]).collect()}
    assert names == {"Red Bolt", "HOT GEAR"}


def test_titles_are_lowered_once(spark):
    """a text was lower-cased for every word of the lists."""
    df = spark.createDataFrame([("A CONCERT",), ("nothing",), (None,)], "t string")
    out = df.select(filters.music_label(F.col("t")).alias("label"))
    assert [r["label"] for r in out.collect()] == ["music", "unknown", "unknown"]
    assert _plan(out).count("lower(") == 1


def test_calendars_are_read_once(spark):
    """events met their feed's venue in a join that read every feed again."""
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART:20260105T193000\r\nSUMMARY:Act One\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    df = spark.createDataFrame([(1, ics, "rockwell"), (2, ics, "nowhere")], "seq bigint, ics string, venue string")
    out = feeds.ical_listings(df, now="2026-01-01 00:00:00")
    assert [(r["venue_id"], r["bands"]) for r in out.collect()] == [("rockwell", ["Act One"])]
    assert _plan(out).count("Join") == 1


def _listing_rows(spark):
    rows = [(i, "the_hall" if i % 2 else "royale", "The Hall" if i % 2 else "Royale", "Boston", ["Pile"] if i else []) for i in range(6)]
    df = spark.createDataFrame(rows, "seq bigint, venue_id string, venue_name string, venue_location string, bands array<string>")
    more = {"date": "timestamp_ntz'2026-01-05 00:00:00'", "time": "'8pm'", "age_requirement": "'a/a'", "flags": "array('$')",
            "price_advance": "1", "price_door": "2", "source_url": "string(null)"}
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in more.items()])


def _scans_of_rows(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_registry_lookups_do_not_form_listings_again(spark):
    """pairs of ids and names were read from the normalized rows, twice beside the rows themselves."""
    reg = spark.createDataFrame(
        [(0, "hall", "The Hall", "Salem", "NH", ["the_hall"])], "pos int, id string, name string, location string, state string, id_variants array<string>"
    )
    out = normalize_listings(_listing_rows(spark), reg)
    assert {(r["seq"], r["venue_id"], r["venue_location"]) for r in out.collect()} == {
        (1, "hall", "Salem, NH"), (3, "hall", "Salem, NH"), (5, "hall", "Salem, NH"), (2, "royale", "Boston"), (4, "royale", "Boston")}
    assert _scans_of_rows(out) == 1


def test_venue_names_meet_listings_where_they_are(spark):
    """listings were formed and moved twice to meet the names of their venues."""
    out = views.by_venue(_listing_rows(spark).where("size(bands) > 0"))
    assert {(r["seq"], r["heading"]) for r in out.collect()} == {
        (1, "The Hall, Boston"), (3, "The Hall, Boston"), (5, "The Hall, Boston"), (2, "Royale, Boston"), (4, "Royale, Boston")}
    assert _scans_of_rows(out) == 0 and "Aggregate" not in _plan(out)


def test_a_heading_is_read_once_for_all_its_lines(spark):
    """the date of a heading was read again for every line under it, and every line carried its whole section."""
    df = spark.createDataFrame([(1, ["x", "Jan 5", "a", "b", "Jan 6", "c"])], "seq int, lines array<string>")
    out = lines.carry_forward(df, "lines", lambda s: s.startswith("Jan"), lambda s: F.right(s, F.lit(1)).cast("int"))
    assert [tuple(r) for r in out.orderBy("pos").collect()] == [(1, 5, 3, "a"), (1, 5, 4, "b"), (1, 6, 6, "c")]
    assert "Generate posexplode(__body" in _plan(out)

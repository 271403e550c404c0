"""Run-to-run state, streams and positional operators over split groups."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from gigmesh.operators import lines
from gigmesh.operators.normalize import normalize_listings
from gigmesh.plans import views
from gigmesh.schema import with_id
from gigmesh.streaming import new_listings

DAY = "2026-01-31"
RAW = """seq bigint, date timestamp_ntz, venue_id string, venue_name string, venue_location string, bands array<string>,
  age_requirement string, price_advance int, price_door int, time string, flags array<string>, source string,
  source_url string, genre_tags array<string>, last_updated timestamp_ntz"""


def raw(spark, *names, day=dt.datetime(2026, 2, 1)):
    rows = [
        (i, day, "deep cuts", "deep cuts", "Medford", [n], "21+", 10, None, "9pm", [], "s", None, [], dt.datetime(2026, 1, 1))
        for i, n in enumerate(names)
    ]
    return spark.createDataFrame(rows, RAW)


def ready(df):
    return with_id(normalize_listings(df))


def names_of(df):
    return sorted(r.artists for r in df.collect())


def test_commit_only_after_success(spark, folder):
    state = new_listings.NotifiedIds(spark, folder)
    first = ready(raw(spark, "Pile", "Krill"))
    sent = []

    def send(ok):
        def go(rows):
            sent.append(names_of(rows))
            return ok

        return go

    assert new_listings.notify(first, state, DAY, "r1", send(True), dry_run=True)
    assert not new_listings.notify(first, state, DAY, "r1", send(False))
    assert state.read().count() == 0
    assert new_listings.notify(first, state, DAY, "r1", send(True))
    second = ready(raw(spark, "Pile", "Bane"))
    assert new_listings.notify(second, state, DAY, "r2", send(True))
    assert sent[-2:] == [["Krill", "Pile"], ["Bane"]]
    # Only current ids are kept, so a listing that returns is new again.
    assert names_of(views.digest(first, state.read(), DAY)) == ["Krill"]
    # Repeating a run changes nothing.
    state.commit(second, "r2")
    assert state.read().count() == 2


def test_digest_falls_back_to_coming_days(spark):
    df = ready(raw(spark, "Pile")).unionByName(ready(raw(spark, "Later", day=dt.datetime(2026, 3, 1))))
    got = views.digest(df, df, DAY)
    assert [(r.mode, r.artists) for r in got.collect()] == [("upcoming", "Pile")]
    subject = views.digest_subject(got, df, DAY).first()
    assert subject.subject == "listings: Upcoming shows (Jan 31)" and subject.subtitle.endswith("(Jan 31 - Feb 03)")
    one = views.digest_subject(views.digest(df, ready(raw(spark, "Pile")), DAY), df, DAY).first()
    assert one.subject == "listings: 1 new show added, 2 total (Jan 31)"


def test_stream_equals_batch(spark, folder):
    df = raw(spark, "Pile", "PILED", "Piled", "Krill", "The Krill")
    for i in range(3):
        df.write.mode("append").parquet(f"{folder}/in")
    want = {r.id for r in ready(df).select("id").distinct().collect()}
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    for kind, horizon in (("kept", None), ("bounded", "2 days")):
        rows = new_listings.stream_new(
            source() if horizon is None else source().withColumn("last_updated", F.col("last_updated").cast("timestamp")), horizon
        )
        new_listings.write_stream(rows, f"{folder}/{kind}/out", f"{folder}/{kind}/cp").awaitTermination()
        got = [r.id for r in spark.read.parquet(f"{folder}/{kind}/out").collect()]
        assert sorted(got) == sorted(want)


def test_stream_digest_emits_once_across_batches(spark, folder):
    raw(spark, "Pile", "Krill").write.parquet(f"{folder}/in")
    source = lambda: spark.readStream.schema(raw(spark, "x").schema).parquet(f"{folder}/in")
    new_listings.stream_digest(source(), f"{folder}/out", f"{folder}/cp", DAY).awaitTermination()
    raw(spark, "Pile", "Bane").write.mode("append").parquet(f"{folder}/in")
    new_listings.stream_digest(source(), f"{folder}/out", f"{folder}/cp", DAY).awaitTermination()
    got = spark.read.parquet(f"{folder}/out/rows")
    assert sorted((r.batch, r.bands[0]) for r in got.collect()) == [(0, "Krill"), (0, "Pile"), (1, "Bane")]


def test_stream_digest_keeps_ids_as_state_and_forgets_old_ones(spark, folder):
    source = lambda: spark.readStream.schema(raw(spark, "x").schema).parquet(f"{folder}/in")
    sizes = []
    for batch in (["Pile", "Krill"], ["Pile", "Bane"], ["Late"], ["Last"]):
        raw(spark, *batch).write.mode("append").parquet(f"{folder}/in")
        query = new_listings.stream_digest(source(), f"{folder}/out", f"{folder}/cp", DAY, horizon="1 second")
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(3)
    assert sizes[0] <= 2 and sizes[-1] <= 1, sizes
    past = raw(spark, "Past", day=dt.datetime(2020, 1, 1))
    past.write.mode("append").parquet(f"{folder}/in")
    new_listings.stream_digest(source(), f"{folder}/out", f"{folder}/cp", DAY, horizon="1 second").awaitTermination()
    assert "Past" not in {r.bands[0] for r in spark.read.parquet(f"{folder}/out/rows").collect()}


@pytest.mark.parametrize("width", [2, 4096])
def test_neighbours_over_gaps(spark, width):
    places = [("a", p) for p in (None, 1, 2, 5000, 5001)] + [("b", -7), ("b", 1 << 40), (None, 3), (None, 9)]
    df = spark.createDataFrame([(g, p, f"{g}{p}") for g, p in places], "g string, p bigint, v string")
    got = {(r.g, r.p): (r.back, r.on) for r in lines.neighbours(df, ["g"], "p", {"back": ("v", -1), "on": ("v", 2)}, width).collect()}
    assert got == {
        ("a", None): (None, "a2"), ("a", 1): ("aNone", "a5000"), ("a", 2): ("a1", "a5001"), ("a", 5000): ("a2", None), ("a", 5001): ("a5000", None),
        ("b", -7): (None, None), ("b", 1 << 40): ("b-7", None), (None, 3): (None, None), (None, 9): ("None3", None),
    }


@pytest.mark.parametrize("gapless", [False, True])
@pytest.mark.parametrize("width", [3, 5, 4096])
def test_neighbours_do_not_depend_on_the_block_width(spark, width, gapless):
    df = spark.createDataFrame([(g, p, f"{g}{p}") for g in "ab" for p in range(23)], "g string, p int, v string")
    got = lines.neighbours(df, ["g"], "p", {"back": ("v", -3), "on": ("v", 2)}, width, gapless)
    for r in got.collect():
        assert r.back == (f"{r.g}{r.p - 3}" if r.p >= 3 else None)
        assert r.on == (f"{r.g}{r.p + 2}" if r.p <= 20 else None)
    assert got.count() == 46


def test_frames(spark):
    text = "x\nJan\na\n\nb\nFeb\nc"
    df = spark.createDataFrame([(1, text)], "id int, t string").select("id", lines.lines_of(F.col("t")).alias("lines"))
    month = lambda s: s.isin("Jan", "Feb")
    got = [(r.heading, r.pos, r.line) for r in lines.carry_forward(df, "lines", month).collect()]
    assert got == [("Jan", 3, "a"), ("Jan", 4, "b"), ("Feb", 6, "c")]
    around = lines.around(df, "lines", month, before=2, after=5).collect()
    assert [(r.previous, r.following) for r in around] == [(["x"], ["a", "b", "Feb", "c"]), (["b", "a"], ["c"])]
    kept = spark.createDataFrame([(1, text)], "id int, t string").select("id", lines.lines_of(F.col("t"), True).alias("lines"))
    runs = [(r.heading, r.body, r.closed_by) for r in lines.sessions(kept, "lines", month).collect()]
    assert runs == [("Jan", ["a"], "blank"), ("Feb", ["c"], "end")]


def test_first_acceptable_stops(spark):
    df = spark.createDataFrame([(["-", "ok", "stop"],), (["-", "stop", "ok"],), ([],)], "c array<string>")
    got = df.select(lines.first_acceptable(F.col("c"), lambda s: s == "ok", lambda s: s == "stop").alias("r"))
    assert [r.r for r in got.collect()] == ["ok", None, None]

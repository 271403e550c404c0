"""Values that several rules read are computed once, and dates are made without parsing text."""

import datetime

from pyspark.sql import functions as F

from gigmesh.functions import temporal, text
from gigmesh.sources import dates, pages


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dates_are_made_without_parsing(spark):
    rows = [("1998", m, d) for m in (0, 1, 2, 4, 12, 13) for d in (0, 1, 28, 29, 30, 31, 32)] + [("2000", 2, 29), ("1900", 2, 29)]
    df = spark.createDataFrame([(int(y), m, d) for y, m, d in rows] + [(None, 1, 1), (1998, None, 1), (1998, 1, None)], "y int, m int, d int")

    def expected(y, m, d):
        try:
            return datetime.date(y, m, d)
        except (TypeError, ValueError):
            return None

    for r in df.select("*", temporal.date_or_null(F.col("y"), F.col("m"), F.col("d")).alias("got")).collect():
        assert r["got"] == expected(r["y"], r["m"], r["d"])


def test_texts_are_searched_once(spark):
    """a date's month, day and year came from three searches of a text that was formed anew for each."""
    df = spark.createDataFrame([("x Jan 24, 1999 y",), ("none",), ("Feb 30",), (None,)], "t string")
    out = df.select(dates.month_day(pages.plain(F.col("t")), "1998-01-01").alias("d"))
    assert [r["d"] for r in out.collect()] == [datetime.date(1999, 1, 24), None, None, None]
    assert _plan(out).count("script|style") == 1 and "format_string" not in _plan(out)


def test_bound_and_has_any(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), (None,)], "t string")
    out = df.select(text.bound(F.lower("t"), lambda low: text.has_any(low, ["a.b", "zz"])).alias("v"))
    assert [r["v"] for r in out.collect()] == [True, False, None]

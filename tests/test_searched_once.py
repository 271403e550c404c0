"""Texts are searched once per pattern, however many parts are read from a match, and missing parts are not parsed."""

from pyspark.sql import functions as F

from gigmesh.functions import text
from gigmesh.sources import feeds, free_text


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_parser_searches_each_text_once(spark):
    df = spark.range(1).select(F.concat(F.lit("Pile @ Deep Cuts 2/15 $"), "id").alias("line"))
    plan = plan_of(free_text.line_listings(df, as_of="2026-02-01"))
    assert plan.count("regexp_extract(__d#") == 2  # a slashed date, else a named one
    assert plan.count("regexp_extract(__t#") == 2  # a clock with am or pm, else one of 24 hours
    assert plan.count("RLIKE(__a#") == 4


def test_empty_parts_are_null_and_not_parsed(spark):
    df = spark.createDataFrame([("$12",), ("$12/15",), ("free",), (None,)], "t string")
    price = text.parse_price(F.col("t"), "line")
    assert [tuple(r) for r in df.select(price["advance"], price["door"]).collect()] == [(12, None), (12, 15), (None, None), (None, None)]
    for read in (text.whole, text.number):
        plan = plan_of(df.select(read(F.regexp_extract("t", r"/(\d+)", 1)).alias("x")))
        assert "CASE WHEN NOT (" in plan and "try_cast(regexp_extract" not in plan


def test_api_payloads_are_parsed_once(spark):
    """the filter on an event's status or venue formed and parsed its payload again."""
    day = "struct(struct(if(id = 2, 'cancelled', 'onsale') as code) as status, struct('2026-02-03' as localDate) as start)"
    a = f"to_json(struct({day} as dates, struct(array(struct('Royale' as name)) as venues, array(struct('Pile' as name)) as attractions) as _embedded))"
    b = "to_json(struct('2026-02-03T20:00:00' as datetime_local, if(id = 2, null, struct('Royale' as name)) as venue, array(struct('Pile' as name)) as performers))"
    for read, made in ((feeds.api_a_listings, a), (feeds.api_b_listings, b)):
        df = read(spark.range(4).selectExpr("id AS seq", f"{made} AS payload"))
        plan = plan_of(df)
        assert plan.count("from_json(") == 1 and plan.count("StructsToJsonEvaluator(") == 1
        assert sorted((r["seq"], r["bands"], r["venue_name"]) for r in df.collect()) == [(k, ["Pile"], "Royale") for k in (0, 1, 3)]

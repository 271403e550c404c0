"""Physical plans: what reaches the scan, what shuffles, what must never appear."""


import pytest
from pyspark.sql import functions as F

from gigmesh.operators import filters, grouping
from gigmesh.operators.normalize import normalize_listings
from gigmesh.plans import views
from gigmesh.sources.tables import table

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """Listings as a parquet table, the way a cluster would keep them."""
    import tempfile

    from gigmesh.sources.tables import listings

    path = tempfile.mkdtemp(prefix="spark-") + "/listings"
    listings(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def test_date_filter_reaches_the_scan_through_normalization(stored):
    text = plan(filters.not_past(normalize_listings(stored), "1998-01-01"))
    assert "GreaterThanOrEqual(date,1998-01-01T00:00)" in text.replace(" ", "")
    assert "Exchange" not in text


def test_only_needed_columns_are_read(stored):
    text = plan(grouping.source_counts(stored))
    schema = text[text.index("ReadSchema") :].split("\n")[0]
    assert "source:string" in schema and "bands" not in schema and "venue" not in schema


def test_top_k_is_cut_before_the_shuffle(stored):
    text = plan(views.structured_events(stored, "1998-01-01"))
    assert text.count("WindowGroupLimit") >= 2


def test_first_seen_combines_before_the_shuffle(stored):
    text = plan(grouping.first_seen(stored, ["venue_id"]))
    assert "partial_min_by" in text


def test_lines_stay_in_their_row(spark):
    from registry.q_windows import ffill_dates

    assert "Exchange" not in plan(ffill_dates(spark, SF_DIR))


def test_checkpoint_folder_is_taken_from_the_session(spark):
    from gigmesh.runtime import cut_lineage

    cut = cut_lineage(spark.range(3))
    assert spark.conf.get("spark.checkpoint.dir") in cut.inputFiles()[0]
    assert table(spark, SF_DIR, "region").count() == 5


def test_names_that_begin_alike_are_numbered_in_order(spark):
    """Half of the names share their beginning, some are missing, all ties are broken by id."""
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("the "), F.lpad((F.col("id") % 700).cast("string"), 4, "0"))).when(F.col("id") % 3 == 0, F.lit("a"))
    df = spark.range(3000).select("id", name.alias("name"))
    got = [(r.position, r.name, r.id) for r in grouping.numbered(df, F.col("name")).collect()]
    want = sorted(((r.name, r.id) for r in df.collect()), key=lambda x: (x[0] or "", x[1]))
    assert [(p, n, i) for p, n, i in sorted(got)] == [(k, n, i) for k, (n, i) in enumerate(want, 1)]
    assert grouping.numbered(df.where("id < 0"), F.col("name")).count() == 0


def test_customers_join_before_billings(spark):
    """Orders meet customers while they are narrow: the last join is the one with the billings, and collected lines don't move."""
    from gigmesh.sources.tables import listings

    df = listings(spark, SF_DIR)
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
    assert "l_orderkey" in joins[0] and "c_custkey" not in joins[0]
    text = plan(df)
    partial = text.index("partial_collect_list")
    assert "Exchange" not in text[text.index("collect_list") : partial]


def test_keys_of_similar_names_never_pass_through_the_driver(spark):
    from gigmesh.operators.similar import candidates

    names = spark.createDataFrame([("abcdefgh",), ("abcdefgi",), ("zzzz",)], "s string")
    found = candidates(names, 80)
    assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
    assert [tuple(r) for r in found.collect()] == [("abcdefgh", "abcdefgi")]

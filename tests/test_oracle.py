"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import registry

registry.load()
SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def con():
    import check

    return check.database(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    import check

    ok, message = check.compare(spark, con, name, SF_DIR, no_table_product)
    assert ok, message


def no_table_product(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def against_sql(spark, folder, name, table, rows, schema):
    import __spark_entry__ as entry
    import duckdb

    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    wanted = con.sql(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    return got


def test_skip_rules_reads_words_lines_and_ends_as_its_sql_does(spark, folder):
    texts = [
        (1, "ion\u00e9 going", "en"), (2, "tion\rgoing", "en"), (3, "tion\ngoing", "en"), (4, "richtung\n", "de"), (5, "richtung", "de"),
        (6, None, "en"), (7, None, None), (8, "l\u0130cense", "en"), (9, "ion\u2028ing", "en"), (10, "", None), (11, "ions going", "en"),
    ]
    got = against_sql(spark, folder, "skip_rules", "documents", texts, "doc_id bigint, text string, lang string")
    assert sorted(r[0] for r in got) == [3, 4, 10, 11]


def test_page_blocks_keeps_references_as_its_sql_does(spark, folder):
    htmls = [
        "<title>a &quot;b&quot; &amp</title><h1>&amp;lt;&nbsp; x</h1><li>1</li>", "<titles>t</title><h1 class=x>&eacute;</h1>", None, "",
        '<li\u00e9>x</li><a\u00e9 href="/p?a&amp;b">', '<title>\u00a0a\u000b b</title><a data-href="/1" href="/2"><A HREF="/3">', "<h1><script>x</script>y</h1>",
    ]
    against_sql(spark, folder, "page_blocks", "pages", list(enumerate(htmls)), "page_id bigint, html string")

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "America/Los_Angeles")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a column function to Python values and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, *columns, schema="string"):
        kinds = schema if isinstance(schema, list) else [schema] * len(columns)
        rows = [(i, *vals) for i, vals in enumerate(zip(*columns))]
        ddl = "i int, " + ", ".join(f"c{k} {t}" for k, t in enumerate(kinds))
        df = spark.createDataFrame(rows, ddl)
        out = df.select("i", fn(*[F.col(f"c{k}") for k in range(len(columns))]).alias("r")).orderBy("i")
        return [r["r"] for r in out.collect()]

    return run

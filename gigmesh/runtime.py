"""Session helpers: lineage cuts and bounded looks at data size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark removes the shuffle files of a write when it is done, not when its plan is collected as garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read on from there.

    Computed once, columnar, and its real size is known to later joins. Lost
    executors cost nothing but a re-read. What was shuffled for the table goes when it is written, so
    a chain of tables needs the disk of its largest step, not of all.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def largest_group(df: DataFrame, *keys: str) -> int:
    """Row count of the biggest group; 0 for an empty frame. One number reaches the driver."""
    top = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return top["n"] or 0


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """Keep the optimizer from evaluating derived columns again in later filters and projections.

    The columns pass through a one-element ``explode``. Filters on other columns are
    still pushed down to the scan.
    """
    rest = [c for c in df.columns if c not in names]
    packed = df.select(*rest, F.struct(*names).alias("__once"))
    return packed.select(*rest, F.explode(F.array("__once")).alias("__once")).select(*rest, "__once.*").select(*df.columns)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that workers find it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_gigmesh_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), "gigmesh_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._gigmesh_shipped = True

"""What is new since the last run, as a batch state table and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from gigmesh.operators import filters
from gigmesh.operators.normalize import normalize_listings
from gigmesh.schema import with_id

C = F.col


def _is_missing(error: AnalysisException) -> bool:
    """Nothing was written yet; every other fault must surface, or all listings would count as new."""
    return error.getCondition() == "PATH_NOT_FOUND"


def new_since(df: DataFrame, notified: DataFrame) -> DataFrame:
    """Listings whose id was not notified before."""
    return df.join(notified.select("id"), "id", "left_anti")


class NotifiedIds:
    """Ids of the last successful notification.

    Each run writes its ids to a folder of its own; a log row added afterwards makes
    them current. A failed or repeated run therefore never leaves half a state, and
    the newest set replaces the older one as a whole.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            last = self.spark.read.parquet(f"{self.path}/log").agg(F.max("run").alias("run")).first()["run"]
        except AnalysisException as error:
            if not _is_missing(error):
                raise
            last = None
        if last is None:
            return self.spark.createDataFrame([], "id string")
        return self.spark.read.parquet(f"{self.path}/ids/{last}")

    def commit(self, current: DataFrame, run: str) -> None:
        """Make the ids of ``current`` the notified set. ``run`` must sort after earlier runs."""
        current.select("id").distinct().write.mode("overwrite").parquet(f"{self.path}/ids/{run}")
        self.spark.range(1).select(F.lit(run).alias("run")).write.mode("append").parquet(f"{self.path}/log")


def notify(df: DataFrame, state: NotifiedIds, as_of, run: str, send, dry_run: bool = False) -> bool:
    """Send the digest through ``send(rows)`` and commit the ids only when that succeeds."""
    from gigmesh.plans.views import digest

    rows = digest(df, state.read(), as_of)
    if dry_run:
        send(rows)
        return True
    if not send(rows):
        return False
    state.commit(df, run)
    return True


def stream_new(raw: DataFrame, watermark: str | None = None, at: str | None = "last_updated") -> DataFrame:
    """Normalized listings of a stream, each id once.

    Without a watermark the ids seen are kept for good; with one, an id counts as seen
    for that long after it arrived, which bounds the state. ``at`` is the column that tells
    when; with None it is the time of arrival, by which no row is ever late.
    """
    return _once(with_id(normalize_listings(raw)), watermark, at)


def _once(rows: DataFrame, watermark: str | None, at: str | None) -> DataFrame:
    if watermark is None:
        return rows.dropDuplicates(["id"])
    if at is not None:
        return rows.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["id"])
    arrived = rows.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", watermark)
    return arrived.dropDuplicatesWithinWatermark(["id"]).drop("__arrived")


def write_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing a stream to parquet files, exactly once."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def stream_digest(raw: DataFrame, path: str, checkpoint: str, as_of, horizon: str | None = None) -> StreamingQuery:
    """Per micro-batch: listings from ``as_of`` on whose id is new, written with their batch under ``path/rows``.

    Ids seen are keyed state of the stream, so a batch costs its own rows and never reads earlier ones. With a
    ``horizon`` the state is bounded: an id stays at least that long after its first arrival, leaves when a batch
    finds twice that time gone, and then counts as new. Without one, ids stay for good.
    Each batch owns one folder and overwrites it: a replayed batch starts from the same state and leaves nothing twice.
    For state beyond the memory of the executors, choose RocksDB in ``spark.sql.streaming.stateStore.providerClass``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    rows = _once(filters.not_past(with_id(normalize_listings(raw)), as_of), horizon, None)
    return (
        rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

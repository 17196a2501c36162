"""Streams: raw rows once each, and rebuilding of the markets that new rows touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from ..functions import calendar
from ..sources.store import Store


def read_landing(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_each(rows: DataFrame, key: list[str], time_col: str, lag: str = "120 days") -> DataFrame:
    """The first row of each key; keys are kept for ``lag``, which is to cover the longest delay of a publication."""
    return rows.withWatermark(time_col, lag).dropDuplicatesWithinWatermark(key)


def drained(query: StreamingQuery, path: str) -> DataFrame:
    """What a stream wrote to ``path`` once it has read all that was there."""
    query.awaitTermination()
    return SparkSession.active().read.parquet(path)


def append_once(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def rebuild_touched(rows: DataFrame, stored: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], store: Store, table: str, checkpoint: str, by: str = "market") -> StreamingQuery:
    """For each batch, the derived table of the markets in it is built again from their stored rows.

    Only their partitions are written.  Each carries the number of its batch, written with
    the rows themselves: a batch that runs again leaves out the markets that have it already,
    so a whole replay writes nothing and one after a crash writes what was missing.
    """

    def batch(new: DataFrame, number: int) -> None:
        touched = new.select(by).distinct()
        if store.exists(table):
            done = store.spark.read.parquet(store.path(table)).where(F.col("batch") >= number).select(by).distinct()
            touched = touched.join(done, by, "left_anti")
        if not touched.isEmpty():
            store.replace_touched(table, build(stored().join(touched, by, "left_semi")).withColumn("batch", F.lit(number).cast("long")), (by,))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LateRows(StreamingQueryListener):
    """Counts, by query, the rows that stateful steps dropped because they came after the watermark."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[str(p.id)] = self.dropped.get(str(p.id), 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        """Nothing was read, so nothing was dropped."""

    def onQueryTerminated(self, event) -> None:
        """The count stays."""


def priced_reports(reports: DataFrame, prices: DataFrame, days: int = 3, lag: str | None = None) -> DataFrame:
    """Two streams joined: each report with its market's closes of the day it became public and ``days`` after.

    Reports of a backlog come long after their dates, so their watermark waits as long as
    the release calendar's longest delay, and prices are kept as long; the time range of the
    join lets Spark drop both sides' rows once they can meet nothing more.
    """
    lag = lag or f"{calendar.longest_delay()} days"
    due = F.col("availability_date").cast("timestamp").alias("due")
    left = reports.select("market", "report_date", "availability_date", due).withWatermark("due", lag)
    right = prices.select(F.col("market").alias("m"), F.col("date").cast("timestamp").alias("at"), "date", "close").withWatermark("at", lag)
    met = left.join(right, F.expr(f"market = m AND at >= due AND at <= due + INTERVAL {days} DAYS"))
    return met.select("market", "report_date", "availability_date", "date", "close")


def flag_sessions(rows: DataFrame, time_col: str, gap: str = "8 days", lag: str = "30 days", by: tuple[str, ...] = ("market",)) -> DataFrame:
    """Episodes of flagged rows as session windows: a gap longer than ``gap`` starts a new one."""
    session = F.session_window(time_col, gap)
    counted = rows.filter("flag").withWatermark(time_col, lag).groupBy(*by, session.alias("session")).agg(F.count(F.lit(1)).alias("weeks"))
    return counted.select(*by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "weeks")

"""Streaks as a keyed, stateful stream: weeks may arrive in any order within the lag.

The state of a market and role is the weeks that are still open and one settled week
before them.  A week that arrives is put in its place and every later open week is
counted again; rows whose streak is new or different go out with the batch's clock, so
a sink that keeps each week's last version holds what a batch computation gives.  The
watermark settles weeks, which bounds the state to those of the lag; a timer clears
keys from which nothing has come for ``SILENCE``.  Weeks older than the watermark
are dropped and counted by Spark (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds of event time after which a key that is silent is cleared.
SILENCE = 3 * 365 * 86_400_000
OUTPUT = "market string, role string, report_date date, streak_up_weeks long, streak_down_weeks long, version long"
EPOCH = date(1970, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stepped(before: tuple[float | None, int, int] | None, net: float | None) -> tuple[float | None, int, int]:
    """A week's (net, weeks up, weeks down) after the week before; a flat or unknown week ends both."""
    if before is None or before[0] is None or net is None:
        return net, 0, 0
    return net, before[1] + 1 if net > before[0] else 0, before[2] + 1 if net < before[0] else 0


def _day(ms: int) -> int:
    return ms // 86_400_000


class Streaks(StatefulProcessor):
    """Days are numbers since the epoch throughout."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day int", "net double, up long, down long")
        self.settled = handle.getValueState("settled", "day int, net double, up long, down long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        weeks = {day: (net, up, down) for (day,), (net, up, down) in self.open.iterator()}
        base = self.settled.get() if self.settled.exists() else None
        new: dict[int, float | None] = {}
        for frame in rows:
            for day, net in zip(frame["report_date"], frame["net"], strict=True):
                at = (day - EPOCH).days
                if base is None or at > base[0]:
                    new[at] = None if pd.isna(net) else float(net)
        changed = []
        if new:
            first = min(new)
            last = tuple(base[1:]) if base is not None else None
            for day in sorted({*weeks, *new}):
                if day < first:
                    last = weeks[day]
                    continue
                last = stepped(last, new[day] if day in new else weeks[day][0])
                if day in new or weeks[day] != last:
                    changed.append((day, *last[1:]))
                    self.open.updateValue((day,), last)
                weeks[day] = last
        self._settle(weeks, timerValues.getCurrentWatermarkInMs())
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        newest = max([*weeks, *([base[0]] if base is not None else [])], default=0)
        self.handle.registerTimer(newest * 86_400_000 + SILENCE)
        if changed:
            yield pd.DataFrame({
                "market": key[0], "role": key[1], "report_date": [EPOCH + timedelta(days=d) for d, _, _ in changed],
                "streak_up_weeks": [u for _, u, _ in changed], "streak_down_weeks": [d for _, _, d in changed], "version": timerValues.getCurrentProcessingTimeInMs(),
            })

    def _settle(self, weeks: dict[int, tuple], watermark: int) -> None:
        """Weeks before the watermark can't change any more: the last of them stands for all."""
        done = [d for d in weeks if d < _day(watermark)]
        if done:
            self.settled.update((max(done), *weeks[max(done)]))
            for day in done:
                self.open.removeKey((day,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        self.settled.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is held outside the state."""


def streak_changes(rows: DataFrame, lag: str = "56 days") -> DataFrame:
    """(market, role, report_date, net) as they come, to the weeks whose streaks are new or different."""
    timed = rows.select("market", "role", "report_date", "net", F.col("report_date").cast("timestamp").alias("at")).withWatermark("at", lag)
    return timed.groupBy("market", "role").transformWithStateInPandas(Streaks(), OUTPUT, "Update", "eventTime")


def write_versions(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's rows under its number: a batch that is run again replaces what it wrote before."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_versions(rows: DataFrame, keys: tuple[str, ...] = ("market", "role", "report_date")) -> DataFrame:
    """Of each key the row of the last batch."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams with such state need this store; what was set before is set again."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)

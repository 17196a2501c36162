"""What followed: outcome summaries, base rates, regime history, scanner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HORIZONS
from ..functions import expressions as E
from . import states


def summary(r: Column) -> list[Column]:
    """Aggregates of returns; quantiles are exact."""
    return [
        F.count(r).alias("n"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(r).alias("mean_return"),
        F.median(r).alias("median_return"),
        F.percentile(r, F.lit(0.25)).alias("p25"),
        F.percentile(r, F.lit(0.75)).alias("p75"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
        F.stddev_samp(r).alias("std"),
    ]


def outcomes(rows: DataFrame, by: tuple[str, ...], r: str) -> DataFrame:
    found = rows.groupBy(*by).agg(*summary(F.col(r)))
    return found.withColumn("quality", E.sample_quality(F.col("n")))


def long_returns(rows: DataFrame, keys, horizons=HORIZONS) -> DataFrame:
    """Horizons as rows: (keys, horizon, r)."""
    cells = [F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_return_{h}w").alias("r")) for h in horizons]
    return rows.select(*keys, F.inline(F.array(*cells)))


def compare_to_base(rows: DataFrame, chosen: Column, r: str, by: tuple[str, ...]) -> DataFrame:
    """Chosen rows against all rows, in one pass."""
    x, picked = F.col(r), F.when(chosen, F.col(r))
    win = lambda v: F.avg((v > 0).cast("double"))
    return rows.groupBy(*by).agg(
        F.count(picked).alias("n"),
        F.count(x).alias("base_n"),
        win(picked).alias("win_rate"),
        win(x).alias("base_win_rate"),
        ((win(picked) - win(x)) * 100).alias("win_diff_pp"),
        F.median(picked).alias("median_return"),
        F.median(x).alias("base_median"),
        (F.median(picked) - F.median(x)).alias("median_diff"),
    )


def regime_runs(rows: DataFrame) -> DataFrame:
    """Unbroken runs of a regime: (market, regime, start_date, end_date, weeks)."""
    w = E.market_weeks("market")
    change = F.coalesce((F.col("regime") != F.lag("regime").over(w)).cast("int"), F.lit(1))
    runs = rows.select("market", "report_date", "regime").withColumn("run", F.sum(change).over(w))
    return runs.groupBy("market", "run", "regime").agg(F.min("report_date").alias("start_date"), F.max("report_date").alias("end_date"), F.count(F.lit(1)).alias("weeks")).drop("run")


def regime_history(rows: DataFrame, horizon: int = 8) -> DataFrame:
    """Per market, for the regime of its last week: earlier weeks in it, run lengths, outcomes against the base rate."""
    now = states.latest(rows.select("market", "report_date", "regime")).select("market", F.col("regime").alias("now"), F.col("report_date").alias("last_date"))
    past = rows.join(now, "market")
    same = (F.col("regime") == F.col("now")) & (F.col("report_date") < F.col("last_date"))
    counted = past.groupBy("market", F.col("now").alias("regime")).agg(F.count_if(same).alias("occurrences"))
    runs = regime_runs(past.filter("report_date < last_date or regime <> now").drop("now", "last_date"))
    lengths = runs.join(now, (runs.market == now.market) & (runs.regime == now.now)).groupBy(runs.market).agg(F.median("weeks").alias("median_weeks"))
    base = compare_to_base(past, same, f"fwd_return_{horizon}w", ("market",))
    return counted.join(lengths, "market", "left").join(base, "market")


def regime_comparisons(rows: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Earlier weeks in the regime of each market's last week against all weeks, for every horizon."""
    now = states.latest(rows.select("market", "report_date", "regime")).select("market", F.col("regime").alias("now"), F.col("report_date").alias("last_date"))
    past = rows.join(now, "market").withColumn("same", (F.col("regime") == F.col("now")) & (F.col("report_date") < F.col("last_date")))
    return compare_to_base(long_returns(past, ("market", "now", "same"), horizons), F.col("same"), "r", ("market", "now", "horizon")).withColumnRenamed("now", "regime")


def regime_dates(rows: DataFrame) -> DataFrame:
    """The dates of those earlier weeks, a row each: (market, regime, report_date)."""
    now = states.latest(rows.select("market", "report_date", "regime")).select("market", "regime", F.col("report_date").alias("last_date"))
    return rows.select("market", "regime", "report_date").join(now, ["market", "regime"]).filter("report_date < last_date").drop("last_date")


def scan(rows: DataFrame, horizon: int = 8) -> DataFrame:
    """One row per market for its last week, with the history of its regime; highest percentile first, unknown last."""
    last = states.latest(rows.select("market", "report_date", "regime", "spec_net_oi", "spec_pct_52w", "spec_chg_4w", "slow_net_oi", "slow_pct_52w"))
    history = regime_history(rows, horizon).drop("regime")
    return last.join(history, "market").orderBy(F.desc_nulls_last("spec_pct_52w"), "market")


def table_stats(rows: DataFrame, column: str = "spec_net") -> DataFrame:
    """All-time range, range of the last 261 weeks, mean of the last 13."""
    aged = rows.withColumn("age", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("report_date"))))
    x = F.col(column)
    recent = lambda n: F.when(F.col("age") <= n, x)
    return aged.groupBy("market").agg(
        F.max(x).alias("max_all"), F.min(x).alias("min_all"), F.max(recent(261)).alias("max_5y"), F.min(recent(261)).alias("min_5y"), F.avg(recent(13)).alias("mean_13w")
    )

"""Backtests of condition strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COST_BPS, FOLDS
from ..functions import expressions as E
from ..functions.conditions import condition

DIRECTIONS = {"long_currency": 1.0, "short_currency": -1.0}


def signals(rows: DataFrame, text: str, horizon: int, direction: str = "long_currency", cost_bps: float = COST_BPS) -> DataFrame:
    """Rows that meet the condition, with their trade's return (NULL while it is open)."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {sorted(DIRECTIONS)}")
    name = f"fwd_return_{horizon}w"
    if name not in rows.columns:
        raise KeyError(f"no column {name}")
    trade = F.col(name) * DIRECTIONS[direction] - cost_bps / 10000
    return rows.filter(condition(text, rows.columns)).select("market", "report_date", trade.alias("trade_return"))


def counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("market").agg(F.count(F.lit(1)).alias("n_signals"), F.count("trade_return").alias("n_matured"), F.count_if(F.col("trade_return").isNull()).alias("n_open"))


def equity(trades: DataFrame) -> DataFrame:
    """Compounded equity, its highest point so far and the drawdown from it, trade by trade."""
    w = E.market_weeks("market")
    curve = trades.filter("trade_return is not null").withColumn("equity", F.product(1 + F.col("trade_return")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    curve = curve.withColumn("high", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return curve.withColumn("drawdown", (F.col("equity") - F.col("high")) / F.col("high"))


def performance(trades: DataFrame, horizon: int) -> DataFrame:
    """Per market; a profit factor without losses is NULL with ``no_losses`` true."""
    r, curve = F.col("trade_return"), equity(trades)
    year = (52.0 / max(horizon, 1e-9)) ** 0.5
    won, lost, below = (F.when(t, r) for t in (r > 0, r <= 0, r < 0))
    found = curve.groupBy("market").agg(
        F.count(r).alias("n_trades"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(won), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(lost), F.lit(0.0)).alias("avg_loss"),
        F.avg(r).alias("expectancy"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("profit"),
        F.coalesce(-F.sum(lost), F.lit(0.0)).alias("loss"),
        (F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * year).alias("sharpe"),
        (F.avg(r) / F.nullif(F.stddev_samp(below), F.lit(0.0)) * year).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        (F.max_by("equity", "report_date") - 1).alias("total_return"),
    )
    found = found.withColumns(
        {
            "profit_factor": F.when(F.col("loss") > 0, F.col("profit") / F.col("loss")),
            "no_losses": (F.col("loss") <= 0) & (F.col("profit") > 0),
            "calmar": F.when(F.col("max_drawdown") < 0, F.col("total_return") / F.abs("max_drawdown")),
            "holding_weeks": F.lit(float(horizon)),
        }
    )
    return found.drop("profit", "loss")


def folds(trades: DataFrame, k: int = FOLDS) -> DataFrame:
    """Consecutive folds of matured trades; markets with fewer than five a fold have none."""
    w = E.market_weeks("market")
    cut = trades.filter("trade_return is not null").withColumns({"fold": F.ntile(k).over(w), "all": F.count(F.lit(1)).over(Window.partitionBy("market"))})
    r = F.col("trade_return")
    found = cut.filter(F.col("all") >= 5 * k).groupBy("market", "fold").agg(
        F.count(r).alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean_return"), F.min("report_date").alias("start_date"), F.max("report_date").alias("end_date")
    )
    by_fold = Window.partitionBy("market").orderBy("fold").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fades = (F.first("mean_return").over(by_fold) > 0) & (F.last("mean_return").over(by_fold) <= 0)
    return found.withColumn("fades", fades)

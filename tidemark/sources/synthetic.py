"""Synthetic panels: mean-reverting positions with jumps, and prices that follow them a little."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ROLES, SEED, market

SIGNAL = 0.35
JUMPS = 0.02


def mean_reverting(n: int, rng: np.random.Generator, pull: float = 0.05, noise: float = 1.0, jumps: float = JUMPS) -> np.ndarray:
    """x[t+1] = x[t] - pull * x[t] + noise, now and then a jump of several deviations."""
    shocks = rng.normal(0, noise, n) + (rng.random(n) < jumps) * rng.normal(0, 6 * noise, n)
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = (1 - pull) * x[t - 1] + shocks[t]
    return x


def _market_panel(frame: pd.DataFrame) -> pd.DataFrame:
    code, n = frame["market"].iloc[0], len(frame)
    frame = frame.sort_values("report_date")
    rng = np.random.default_rng([SEED, zlib.crc32(code.encode())])
    roles = [p for p in ROLES[market(code).report] if p != "nonreportables"]
    interest = np.maximum(200_000 + 2_000 * mean_reverting(n, rng), 50_000).round()
    net = {p: 0.05 * interest * np.tanh(mean_reverting(n, rng) / 4) for p in roles}
    gross = {p: interest * (0.15 + 0.03 * rng.random(n)) for p in roles}
    long = {p: np.maximum(gross[p] + net[p], 0) for p in roles}
    short = {p: np.maximum(gross[p] - net[p], 0) for p in roles}
    # no side may exceed the interest, so that a residual is left
    for side in (long, short):
        scale = np.minimum(1, 0.95 * interest / sum(side.values()))
        for p in roles:
            side[p] = (side[p] * scale).round()
    spec = next(p for p, r in ROLES[market(code).report].items() if r == "spec")
    flow = np.diff(long[spec] - short[spec], prepend=0) / interest
    weekly = rng.normal(0, 0.01, n) + SIGNAL * np.concatenate([[0], flow[:-1]]) * 0.1
    close = 100 * np.exp(np.cumsum(weekly))
    parts = [pd.DataFrame({"participant": p, "long": long[p], "short": short[p]}, index=frame.index) for p in roles]
    rest = pd.DataFrame({"participant": "nonreportables", "long": interest - sum(long.values()), "short": interest - sum(short.values())}, index=frame.index)
    out = pd.concat([p.assign(market=code, report_date=frame["report_date"], open_interest=interest, close=close) for p in (*parts, rest)])
    return out[["market", "participant", "report_date", "long", "short", "open_interest", "close"]]


def panel(spark: SparkSession, codes: list[str], start: str = "2015-01-06", end: str = "2025-12-30") -> DataFrame:
    """Weekly rows per market and participant, the week's close with them; the same every time."""
    weeks = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 7 days"))
    rows = spark.createDataFrame([(c,) for c in codes], "market string").select("market", F.explode(weeks).alias("report_date"))
    schema = "market string, participant string, report_date date, long double, short double, open_interest double, close double"
    return rows.groupBy("market").applyInPandas(_market_panel, schema)

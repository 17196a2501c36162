"""Quantiles of what was known before each week, kept in a counting tree.

A market's values are ranked once; a tree of counts over the ranks then takes up a value, or
gives the k-th smallest so far, in a number of steps that grows with the logarithm of the
market's weeks.  Sorting each week's history anew would cost its square.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import EVENTS
from . import events


class Counts:
    """How many of the values taken up have each of ``n`` ranks (from 0)."""

    def __init__(self, n: int):
        self.tree = [0] * (n + 1)
        self.total = 0
        self.top = 1 << max(n.bit_length() - 1, 0)

    def add(self, rank: int) -> None:
        self.total += 1
        i = rank + 1
        while i < len(self.tree):
            self.tree[i] += 1
            i += i & -i

    def kth(self, k: int) -> int:
        """Rank of the k-th smallest (from 0) of the values taken up."""
        at, step, left = 0, self.top, k + 1
        while step:
            if at + step < len(self.tree) and self.tree[at + step] < left:
                at += step
                left -= self.tree[at]
            step >>= 1
        return at


def quantiles(values: np.ndarray, q: float, lag: int, least: int) -> np.ndarray:
    """At each place the interpolated quantile of the values at least ``lag`` places before, NaN with fewer than ``least``."""
    known = ~np.isnan(values)
    levels, ranks = np.unique(values[known], return_inverse=True)
    rank = np.full(len(values), -1)
    rank[known] = ranks
    counts, out = Counts(len(levels)), np.full(len(values), np.nan)
    for t in range(len(values)):
        if t >= lag and rank[t - lag] >= 0:
            counts.add(int(rank[t - lag]))
        if counts.total >= max(least, 1):
            place = q * (counts.total - 1)
            low = levels[counts.kth(math.floor(place))]
            high = levels[counts.kth(math.ceil(place))]
            out[t] = low + (high - low) * (place - math.floor(place))
    return out


def with_quantiles(rows: DataFrame, wanted: dict[str, tuple[str, float, int]], least: int = events.LEAST_VALUES, by: str = "market", order: str = "report_date") -> DataFrame:
    """Adds columns ``{new: (column, quantile, lag in rows)}``; a market's weeks are one group."""
    columns = sorted({c for c, _, _ in wanted.values()})
    few = rows.select(by, order, *[F.col(c).cast("double").alias(c) for c in columns])
    schema = StructType([few.schema[by], few.schema[order], *[StructField(new, DoubleType()) for new in wanted]])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        found = {new: quantiles(group[c].to_numpy(float), q, lag, least) for new, (c, q, lag) in wanted.items()}
        out = group[[by, order]].assign(**found)
        return out.astype(object).where(out.notna(), None)

    return rows.join(few.groupBy(by).applyInPandas(add, schema), [by, order])


def event_thresholds(rows: DataFrame, listed=EVENTS) -> DataFrame:
    """Each week the thresholds of `events.thresholds` as they could be known then, and the events by them.

    A move over the next weeks counts once these have gone by.  ``ev_`` is NULL without a
    move or a threshold.
    """
    moved = events.with_moves(rows, listed)
    found = with_quantiles(moved, {f"thr_{key}": (f"move_{key}", q, weeks) for key, q, weeks, _ in listed})
    return found.withColumns({f"ev_{key}": F.col(f"move_{key}") >= F.col(f"thr_{key}") for key, *_ in listed})


def top_conditions(rows: DataFrame, q: float = 0.85) -> DataFrame:
    """The conditions that compare with a high quantile, against the weeks before only: flow spikes and surges of interest."""
    rows = rows.withColumn("__down", -F.col("spec_chg_1w"))
    wanted = {"flow_spike_up": "spec_chg_1w", "flow_spike_down": "__down", "oi_surge": "spec_oi_chg_1w"}
    found = with_quantiles(rows, {f"__cut_{k}": (c, q, 1) for k, c in wanted.items()})
    return found.withColumns({f"c_{k}": F.col(c) >= F.col(f"__cut_{k}") for k, c in wanted.items()}).drop("__down", *[f"__cut_{k}" for k in wanted])


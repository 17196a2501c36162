"""Running quantiles against sorting each history anew."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import events, running


@pytest.mark.parametrize("seed", range(6))
def test_quantiles(seed):
    rng = random.Random(seed)
    values = np.array([math.nan if rng.random() < 0.1 else rng.choice([rng.gauss(0, 1), 1.0, 2.0]) for _ in range(rng.choice([0, 1, 7, 300]))], dtype=float)
    q, lag, least = rng.choice([0, 0.15, 0.5, 0.85, 1]), rng.choice([0, 1, 8]), rng.choice([0, 1, 20])
    got = running.quantiles(values, q, lag, least)
    for t in range(len(values)):
        past = values[: max(0, t - lag + 1)]
        past = past[~np.isnan(past)]
        want = np.quantile(past, q) if len(past) >= max(least, 1) else math.nan
        assert got[t] == pytest.approx(want, nan_ok=True)


def test_counts():
    for n in (1, 2, 3, 8, 9):
        counts, have = running.Counts(n), []
        for _ in range(40):
            rank = random.randrange(n)
            counts.add(rank)
            have.append(rank)
            assert [counts.kth(k) for k in range(len(have))] == sorted(have)


def test_thresholds_know_the_past_only(spark):
    """What comes later changes no earlier threshold; the last week's is that of all moves that are over."""
    rng = random.Random(4)
    prices = [100.0]
    for _ in range(199):
        prices.append(prices[-1] * (1 + rng.gauss(0, 0.02)))
    rows = [(m, date(2015, 1, 6) + timedelta(days=7 * k), p if k != 20 else None) for m in ("A", "B") for k, p in enumerate(prices)]
    schema = "market string, report_date date, price_close double"
    columns = [f"thr_{k}" for k, *_ in events.EVENTS]
    full = {(r.market, r.report_date): [r[c] for c in columns] for r in running.event_thresholds(spark.createDataFrame(rows, schema)).collect()}
    cut = {(r.market, r.report_date): [r[c] for c in columns] for r in running.event_thresholds(spark.createDataFrame([r for r in rows if r[1] < date(2017, 6, 1)], schema)).collect()}
    assert len(full) == 400 and all(full[key] == pytest.approx(cut[key]) if None not in cut[key] else True for key in cut)
    assert all((a is None) == (b is None) for key in cut for a, b in zip(cut[key], full[key], strict=True)) and full["A", rows[199][1]][0] is not None
    assert running.event_thresholds(spark.createDataFrame([], schema)).count() == 0

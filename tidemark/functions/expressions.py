"""Column expressions of the engine.  Missing is NULL everywhere, never NaN."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def before(spec: WindowSpec, weeks: int) -> WindowSpec:
    """The ``weeks`` rows before the current one, without it."""
    return spec.rowsBetween(-weeks, -1)


def change(x: Column, weeks: int, spec: WindowSpec) -> Column:
    return x - F.lag(x, weeks).over(spec)


def relative_change(x: Column, weeks: int, spec: WindowSpec) -> Column:
    return ratio(x, F.lag(x, weeks).over(spec)) - 1


def percentile_of_history(x: Column, weeks: int, spec: WindowSpec) -> Column:
    """Mean of strict and weak percentile of x among a full window of earlier values."""
    history = F.collect_list(x).over(before(spec, weeks))
    below = F.size(F.filter(history, lambda y: y < x)) + F.size(F.filter(history, lambda y: y <= x))
    return F.when(x.isNotNull() & (F.size(history) == weeks), 100.0 * below / (2 * weeks))


def rank_in_history(x: Column, weeks: int, spec: WindowSpec) -> Column:
    """How many of a full window of earlier values lie below x."""
    history = F.collect_list(x).over(before(spec, weeks))
    return F.when(x.isNotNull() & (F.size(history) == weeks), F.size(F.filter(history, lambda y: y < x)).cast("double"))


def zscore_of_history(x: Column, weeks: int, spec: WindowSpec) -> Column:
    """Distance of x from the mean of a full window of earlier values in their sample deviations."""
    frame = before(spec, weeks)
    z = ratio(x - F.avg(x).over(frame), F.stddev_samp(x).over(frame))
    return F.when(F.count(x).over(frame) == weeks, z)


def rises(x: Column, spec: WindowSpec) -> Column:
    return F.coalesce(x > F.lag(x).over(spec), F.lit(False))


def falls(x: Column, spec: WindowSpec) -> Column:
    return F.coalesce(x < F.lag(x).over(spec), F.lit(False))


def direction_of_gap(a: Column, b: Column, floor: float = 0.0) -> Column:
    """True where a and b have opposite signs and both exceed ``floor`` in size; NULL is false."""
    apart = (a * b < 0) & (F.abs(a) > floor) & (F.abs(b) > floor)
    return F.coalesce(apart, F.lit(False))


_COMPARE = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, "==": lambda a, b: a == b,
}


def _holds(conditions: Sequence[tuple], columns: Sequence[str]) -> Column:
    tests = [
        F.coalesce(_COMPARE[op](F.col(c), F.lit(float(limit))), F.lit(False)) if c in columns else F.lit(False)
        for c, op, limit in conditions
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def first_rule(rules: Sequence[tuple], columns: Sequence[str]) -> tuple[Column, Column]:
    """Name of the first rule whose conditions all hold, and the reasons as an array.

    A NULL or missing column fails its condition; without conditions a rule holds, and says so.
    """
    name, reasons = None, None
    for rule, conditions in rules:
        holds = _holds(conditions, columns)
        # a rule with a missing column never holds, so its reasons needn't name the column
        parts = [F.concat(F.lit(f"{c} {op} {limit} (actual: "), F.col(c).cast("string"), F.lit(")")) for c, op, limit in conditions if c in columns]
        why = F.array(*parts) if parts else F.array(F.lit("No rule met."))
        name = F.when(holds, rule) if name is None else name.when(holds, rule)
        reasons = F.when(holds, why) if reasons is None else reasons.when(holds, why)
    if name is None:
        return F.lit("Unclassified"), F.array().cast("array<string>")
    return name.otherwise("Unclassified"), reasons.otherwise(F.array().cast("array<string>"))


def bucket(x: Column, limits: Sequence[tuple[str, float, str]], otherwise: str | Column) -> Column:
    """First label whose (op, limit) x meets."""
    chain = None
    for op, limit, label in limits:
        test = _COMPARE[op](x, F.lit(float(limit)))
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(otherwise)


def level_label(pct: Column) -> Column:
    limits = [("<=", 5, "extreme_low"), ("<=", 20, "low"), ("<", 40, "below_middle"), ("<=", 60, "middle"), ("<", 80, "above_middle"), ("<", 95, "high")]
    return F.when(pct.isNotNull(), bucket(pct, limits, "extreme_high"))


def stance(net_oi: Column) -> Column:
    return F.when(net_oi.isNotNull(), F.when(net_oi > 0.02, "long").when(net_oi < -0.02, "short").otherwise("flat"))


def extremity(pct: Column) -> Column:
    """Where a percentile lies in its range, in wider steps than ``level_label``."""
    limits = [("<=", 5, "extreme_low"), ("<=", 20, "near_low"), (">=", 95, "extreme_high"), (">=", 80, "near_high")]
    middle = F.when(pct.between(40, 60), "middle").otherwise("usual")
    return F.when(pct.isNotNull(), bucket(pct, limits, middle))


def momentum(up: Column, down: Column, chg_4w: Column) -> Column:
    """A streak of two weeks or more, else the sign of the month."""
    month = F.when(chg_4w.isNull(), "unknown").when(chg_4w > 0, "month_up").when(chg_4w < 0, "month_down").otherwise("flat")
    return F.when(F.coalesce(up >= 2, F.lit(False)), "streak_up").when(F.coalesce(down >= 2, F.lit(False)), "streak_down").otherwise(month)


def cleaned(x: Column) -> Column:
    """NULL for NaN."""
    return F.when(~F.isnan(x), x)


def badge(pct: Column, up: Column, down: Column, chg_4w: Column) -> Column:
    """Screener badge; a missing percentile counts as 50, a missing streak or change as 0."""
    p = F.coalesce(pct, F.lit(50.0))
    u, d, c = (F.coalesce(x, F.lit(0.0)) for x in (up, down, chg_4w))
    return (
        F.when((p <= 5) | (p >= 95), "extreme")
        .when(((p <= 10) & (u >= 2) & (c > 0)) | ((p >= 90) & (d >= 2) & (c < 0)), "reversal")
        .when((p <= 20) | (p >= 80), "crowded")
        .when(u >= 4, "accumulation")
        .when(d >= 4, "distribution")
        .otherwise("none")
    )


def flow_code(long_chg: Column, short_chg: Column) -> Column:
    """Which side made the week's flow."""
    a, b = F.abs(long_chg), F.abs(short_chg)
    two = (long_chg * short_chg < 0) & (F.least(a, b) * 2.5 >= F.greatest(a, b))
    side = F.when(a >= b, F.when(long_chg > 0, "longs_added").otherwise("longs_cut")).otherwise(
        F.when(short_chg > 0, "shorts_added").otherwise("shorts_covered")
    )
    known = long_chg.isNotNull() & short_chg.isNotNull()
    return F.when(known, F.when((a < 1) & (b < 1), "no_move").when(two, "two_sided").otherwise(side))


def interest_code(net_chg: Column, oi_chg: Column) -> Column:
    """Net change against open interest; a net change of 0 with rising interest falls to the last code."""
    known = net_chg.isNotNull() & oi_chg.isNotNull() & (F.abs(oi_chg) >= 1)
    return F.when(
        known,
        F.when((net_chg > 0) & (oi_chg > 0), "new_longs")
        .when((net_chg > 0) & (oi_chg < 0), "short_covering")
        .when((net_chg < 0) & (oi_chg > 0), "new_shorts")
        .otherwise("both_fell"),
    )


def configuration(spec_net_oi: Column, slow_net_oi: Column, hedger: bool = False) -> Column:
    """Who stands where: one of the pairs of stances, or which group is missing."""
    a, b = stance(spec_net_oi), stance(slow_net_oi)
    if hedger:
        return F.when(a.isNull(), "missing").when(a == "long", "funds_long_hedgers_short").when(a == "short", "funds_short_hedgers_long").otherwise("funds_flat")
    return (
        F.when(a.isNull() | b.isNull(), "missing")
        .when((a == "long") & (b == "long"), "both_long")
        .when((a == "short") & (b == "short"), "both_short")
        .when((a == "long") & (b == "short"), "fast_long_slow_short")
        .when((a == "short") & (b == "long"), "fast_short_slow_long")
        .otherwise("mixed")
    )


def sample_quality(n: Column) -> Column:
    return bucket(n, [("<", 20, "insufficient"), ("<", 30, "low"), ("<", 50, "moderate")], "good")


def effective_quality(n: Column) -> Column:
    return bucket(n, [("<", 10, "insufficient"), ("<", 20, "weak"), ("<", 40, "moderate"), ("<", 80, "good")], "strong")


def effective_n(n: Column, weeks: int) -> Column:
    """Overlapping samples count once per horizon, rounded half to even."""
    return n if weeks <= 1 else F.greatest(F.lit(1), F.bround(n / weeks).cast("long"))


def market_weeks(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("report_date")

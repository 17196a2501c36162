"""Weekly metrics per market and role; history never includes the current week."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANGE_WINDOWS, COMPRESSION_RATIO, COMPRESSION_WEEKS, EXPANSION_RATIO, RANK_WINDOWS
from ..functions import expressions as E

KEYS = ("market", "role")


def basic(rows: DataFrame) -> DataFrame:
    net = F.col("long") - F.col("short")
    oi = F.col("open_interest")
    return rows.withColumns(
        {"net": net, "net_oi": E.ratio(net, oi), "long_oi": E.ratio(F.col("long"), oi), "short_oi": E.ratio(F.col("short"), oi)}
    )


def changes(rows: DataFrame, windows=CHANGE_WINDOWS, keys=KEYS) -> DataFrame:
    w = E.market_weeks(*keys)
    added = {f"chg_{k}w": E.change(F.col("net"), k, w) for k in windows}
    added |= {f"{side}_chg_{k}w": E.change(F.col(side), k, w) for side in ("long", "short") for k in (1, 4, 13)}
    added |= {f"oi_chg_{k}w": E.change(F.col("open_interest"), k, w) for k in (1, 4)}
    return rows.withColumns(added)


def streaks(rows: DataFrame, column: str = "net", keys=KEYS) -> DataFrame:
    """Weeks in a row that ``column`` rose or fell; a flat week ends both."""
    w = E.market_weeks(*keys)
    rows = rows.withColumns({"__up": E.rises(F.col(column), w).cast("int"), "__down": E.falls(F.col(column), w).cast("int")})
    rows = rows.withColumns({"__ug": F.sum(1 - F.col("__up")).over(w), "__dg": F.sum(1 - F.col("__down")).over(w)})
    up = F.sum("__up").over(Window.partitionBy(*keys, "__ug").orderBy("report_date"))
    down = F.sum("__down").over(Window.partitionBy(*keys, "__dg").orderBy("report_date"))
    return rows.withColumns({"streak_up_weeks": up.cast("double"), "streak_down_weeks": down.cast("double")}).drop("__up", "__down", "__ug", "__dg")


def ranks(rows: DataFrame, windows=RANK_WINDOWS, keys=KEYS) -> DataFrame:
    """Percentiles and z-scores of net/interest, the rank of net, and those of derived series.

    One partitioning and order throughout, so all of it is one sort.
    """
    w = E.market_weeks(*keys)
    added = {f"pct_{k}w": E.percentile_of_history(F.col("net_oi"), k, w) for k in windows}
    added |= {f"z_{k}w": E.zscore_of_history(F.col("net_oi"), k, w) for k in windows}
    added["net_rank_156w"] = E.rank_in_history(F.col("net"), 156, w)
    added["oi_pct_52w"] = E.percentile_of_history(F.col("open_interest"), 52, w)
    added["chg_4w_z"] = E.zscore_of_history(F.col("chg_4w"), 52, w)
    return rows.withColumns(added)


def compression(rows: DataFrame, column: str = "net_oi", weeks: int = COMPRESSION_WEEKS, keys=KEYS) -> DataFrame:
    """Deviation of the last weeks against that of the weeks before, and its label."""
    w = E.market_weeks(*keys)
    full = lambda a, b: F.when(F.count(column).over(w.rowsBetween(a, b)) == weeks, F.stddev_samp(column).over(w.rowsBetween(a, b)))
    share = E.ratio(full(-(weeks - 1), 0), full(-(2 * weeks - 1), -weeks))
    rows = rows.withColumn("spread_ratio", share)
    label = F.when(F.col("spread_ratio") < COMPRESSION_RATIO, "compression").when(F.col("spread_ratio") > EXPANSION_RATIO, "expansion")
    return rows.withColumn("spread_flag", F.when(F.col("spread_ratio").isNotNull(), F.coalesce(label, F.lit("normal"))))


def processed(rows: DataFrame, windows=RANK_WINDOWS) -> DataFrame:
    """All metrics of all weeks."""
    return streaks(ranks(changes(basic(rows)), windows))


def divergence_events(wide: DataFrame, pairs: list[tuple[str, str, str]], weeks: int = 4, floor: float = 0.0) -> DataFrame:
    """Weeks in which two series moved apart: (market, kind, report_date, change_a, change_b, magnitude)."""
    w = E.market_weeks("market")
    found = None
    for kind, a, b in pairs:
        moved = wide.select("market", F.lit(kind).alias("kind"), "report_date", E.change(F.col(a), weeks, w).alias("change_a"), E.change(F.col(b), weeks, w).alias("change_b"))
        apart = moved.filter(E.direction_of_gap(F.col("change_a"), F.col("change_b"), floor))
        found = apart if found is None else found.unionByName(apart)
    return found.withColumn("magnitude", F.least(F.abs("change_a"), F.abs("change_b")))


def indicator(rows: DataFrame, weeks: int = 52, shift: int = 1, keys=KEYS) -> DataFrame:
    """The chart indicator: values shifted by whole weeks, ranks over partial windows, edge-triggered marks."""
    w = E.market_weeks(*keys)
    rows = rows.withColumn("seen", F.lag("net", shift).over(w))
    history = F.collect_list("seen").over(E.before(w, weeks))
    frame = E.before(w, weeks)
    rows = rows.withColumns(
        {
            "ind_pct": F.when(F.col("seen").isNotNull() & (F.size(history) > 0), 100.0 * F.size(F.filter(history, lambda y: y < F.col("seen"))) / F.size(history)),
            "ind_z": E.ratio(F.col("seen") - F.avg("seen").over(frame), F.stddev_samp("seen").over(frame)),
        }
    )
    mark = F.coalesce((F.col("ind_pct") <= 10) | (F.col("ind_pct") >= 90), F.lit(False))
    rows = rows.withColumn("ind_extreme", mark)
    return rows.withColumn("ind_mark", F.col("ind_extreme") & ~F.coalesce(F.lag("ind_extreme").over(w), F.lit(False)))


CHART_MODES = ("net", "pct", "z", "change")


def chart(rows: DataFrame, roles=("spec", "slow", "other"), weeks: int = 52, shift: int = 1, low: float = 10, high: float = 90, turn: int = 2) -> DataFrame:
    """The chart of a market, a row a week: what each mode shows of each role, and the conditions that are marked.

    Values are those of ``indicator``, shifted.  ``mark_`` columns are true in the first week of
    an extreme, a turn or a divergence, and in each week of short covering.
    """
    w, m = E.market_weeks(*KEYS), E.market_weeks("market")
    seen = indicator(rows, weeks, shift).withColumn("seen_long", F.lag("long", shift).over(w))
    seen = streaks(seen, "seen").withColumns({"change": E.change(F.col("seen"), 1, w), "long_change": E.change(F.col("seen_long"), 1, w)})
    shown = {"net": "seen", "pct": "ind_pct", "z": "ind_z", "change": "change"}
    cells = {f"{mode}_{r}": F.max(F.when(F.col("role") == r, F.col(c))) for mode, c in shown.items() for r in roles}
    cells |= {c: F.max(F.when(F.col("role") == roles[0], F.col(c))) for c in ("long_change", "streak_up_weeks", "streak_down_weeks")}
    wide = seen.groupBy("market", "report_date").agg(*[v.alias(k) for k, v in cells.items()])
    fast, slow = roles[:2]
    pct, moved = F.col(f"pct_{fast}"), F.col(f"change_{fast}")
    apart = E.change(F.col(f"net_{fast}"), 4, m) * E.change(F.col(f"net_{slow}"), 4, m) < 0
    conditions = {
        "low": pct <= low,
        "high": pct >= high,
        "turn_up": (pct <= 2 * low) & (F.col("streak_up_weeks") >= turn),
        "turn_down": (pct >= 100 - 2 * (100 - high)) & (F.col("streak_down_weeks") >= turn),
        "apart": apart,
    }
    wide = wide.withColumns({f"is_{k}": F.coalesce(c, F.lit(False)) for k, c in conditions.items()})
    first = {f"mark_{k}": F.col(f"is_{k}") & ~F.coalesce(F.lag(f"is_{k}").over(m), F.lit(False)) for k in conditions}
    return wide.withColumns(first).withColumn("mark_covering", F.coalesce((moved > 0) & (F.abs("long_change") < F.abs(moved) / 3), F.lit(False)))


def chart_mode(chart_rows: DataFrame, mode: str, roles=("spec", "slow", "other")) -> DataFrame:
    """What one mode of the chart draws: (market, report_date, a column for each role)."""
    if mode not in CHART_MODES:
        raise ValueError(f"mode must be one of {CHART_MODES}")
    return chart_rows.select("market", "report_date", *[F.col(f"{mode}_{r}").alias(r) for r in roles])

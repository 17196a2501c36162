"""One row per market and week: every role's metrics, prices, regime and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANGE_WINDOWS, HORIZONS, RANK_WINDOWS, REGIMES
from ..functions import expressions as E
from ..functions.calendar import with_availability
from . import asof, metrics

ROLES = ("spec", "slow", "other")
SIDES = ("long", "short")
#: What a role's columns are: its levels, changes, ranks and streaks.
WIDE = (
    *SIDES, "net", "open_interest", "net_oi", *(f"{side}_oi" for side in SIDES),
    *(f"chg_{k}w" for k in CHANGE_WINDOWS), *(f"{side}_chg_{k}w" for k in (1, 4, 13) for side in SIDES), "oi_chg_1w", "oi_chg_4w",
    *(f"{kind}_{k}w" for kind in ("pct", "z") for k in RANK_WINDOWS), "chg_4w_z", "oi_pct_52w", "net_rank_156w",
    "streak_up_weeks", "streak_down_weeks",
)
#: Labels of divergences, and what they mean in other words.
DIVERGENCES = {
    "Asset Managers vs Leveraged Funds": "slow and fast money go opposite ways: the direction is disputed until one gives in",
    "Leveraged Funds vs Price": "fast money builds up against the price: it is early, or the move lacks its support",
}


def wide(processed: DataFrame, roles=ROLES, columns=WIDE) -> DataFrame:
    """Roles side by side; which participant plays a role is settled before, so report families agree.

    The query fails if a role has two rows in a week, where a choice would hide one.
    """
    columns = [c for c in columns if c in processed.columns]
    cells = [F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in roles for c in columns]
    most = F.greatest(*[F.count_if(F.col("role") == r) for r in roles], F.lit(0)).alias("__most")
    once = F.when(F.col("__most") > 1, F.raise_error(F.lit("repeated market, role and report_date")).cast("boolean")).otherwise(F.lit(True))
    return processed.groupBy("market", "report_date").agg(*cells, most).filter(once).drop("__most")


def assert_unique(rows: DataFrame, keys=("market", "role", "report_date")) -> DataFrame:
    """``rows``, or ValueError if a key repeats (a pivot would hide it)."""
    again = rows.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"repeated key {again[0][: len(keys)]}")
    return rows


def price_features(rows: DataFrame, prices: DataFrame) -> DataFrame:
    rows = asof.forward(rows, prices, "report_date", "price_close")
    w = E.market_weeks("market")
    rows = rows.withColumns({f"price_chg_{k}w": E.relative_change(F.col("price_close"), k, w) for k in (4, 8, 12)})
    return rows.withColumn("price_chg_8w_z", E.zscore_of_history(F.col("price_chg_8w"), 52, w))


def divergence_flags(rows: DataFrame, weeks: int = 4, floor: float = 0.0) -> DataFrame:
    w = E.market_weeks("market")
    moved = {c: E.change(F.col(c), weeks, w) for c in ("slow_net", "spec_net", "price_close")}
    pairs = zip(DIVERGENCES, ("slow_net", "spec_net"), ("spec_net", "price_close"))
    flags = [F.when(E.direction_of_gap(moved[a], moved[b], floor), label) for label, a, b in pairs]
    return rows.withColumn("divergence_flags", F.filter(F.array(*flags), lambda f: f.isNotNull()))


def divergence_words(flags: Column) -> Column:
    """Labels in other words; one that isn't known stays as it is."""
    words = F.create_map(*[F.lit(x) for pair in DIVERGENCES.items() for x in pair])
    return F.transform(flags, lambda f: F.coalesce(F.try_element_at(words, f), f))


def classified(rows: DataFrame, rules=REGIMES) -> DataFrame:
    name, reasons = E.first_rule(rules, rows.columns)
    return rows.withColumns({"regime": name, "regime_reasons": reasons})


def market_states(positions: DataFrame, prices: DataFrame, as_of, inverse=(), windows=RANK_WINDOWS, horizons=HORIZONS) -> DataFrame:
    """The whole build: metrics, roles side by side, prices, divergences, regimes, returns."""
    rows = with_availability(wide(metrics.processed(positions, windows)))
    rows = classified(divergence_flags(price_features(rows, prices)))
    returns = asof.forward_returns(rows, prices, horizons, as_of, inverse)
    return rows.join(returns, ["market", "report_date"], "left")


def features_json(rows: DataFrame, keys=("market", "report_date", "availability_date")) -> DataFrame:
    """Everything but the keys packed into one JSON text, at full precision."""
    packed = [c for c in rows.columns if c not in (*keys, "regime_reasons", "divergence_flags")]
    return rows.select(*keys, F.to_json(F.struct(*packed)).alias("features_json"))


def expand_json(rows: DataFrame, columns: dict[str, str], json_col: str = "features_json") -> DataFrame:
    """JSON fields as columns (name to type); columns that are there already win."""
    new = {c: t for c, t in columns.items() if c not in rows.columns}
    parsed = F.from_json(json_col, ", ".join(f"`{c}` {t}" for c, t in new.items()))
    return rows.withColumn("__parsed", parsed).select(*rows.columns, *[F.col(f"__parsed.{c}").alias(c) for c in new])


def latest(rows: DataFrame, by: str = "market") -> DataFrame:
    """The last week of each market."""
    newest = rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), "report_date").alias("__r"))
    return newest.select(by, "__r.*")


def recent(rows: DataFrame, n: int, by: str = "market") -> DataFrame:
    """The last ``n`` weeks of each market, with ``age`` 1 for the newest."""
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("report_date")))).filter(F.col("age") <= n)


TABLE_METRICS = ("long_chg_1w", "short_chg_1w", "net_oi", "chg_1w", "net")


def table_rows(rows: DataFrame, roles=ROLES, n: int = 80) -> DataFrame:
    """The last ``n`` weeks of each market with five metrics of each role."""
    return recent(rows, n).select("market", "report_date", "age", *[f"{r}_{m}" for r in roles for m in TABLE_METRICS])

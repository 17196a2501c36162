"""Registered queries: each a plan over the driver's tables with, where SQL can say it, the same in SQL.

A query's output is a list of columns: ``~x`` is a double rounded to six places
(after a nudge, as the two engines round exact halves differently), ``^x`` the same of
sign(x) ln(1 + |x|), for values of many digits whose last ones depend on the order of
sums, ``#x`` a whole number, others are taken as they are.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANALOG_FEATURES, BOOTSTRAP_DRAWS, CONDITIONS, EVENTS, HORIZONS, MARKETS, MIN_SAMPLE, REGIMES, ROLES
from ..functions import calendar, guard
from ..functions import expressions as E
from ..functions.conditions import condition
from ..operators import analogs, asof, backtest, events, metrics, neighbours, outcomes, panel, quality, running, states, statistics
from ..streaming import incremental, stateful
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = sql.AS_OF
#: Draws of the resampling queries.
DRAWS = BOOTSTRAP_DRAWS
NUDGE = 3e-8


def _name(c: str) -> str:
    return c.lstrip("~#^")


def _shown(df: DataFrame, columns: list[str]) -> DataFrame:
    rounded = lambda x: F.round(x + NUDGE, 6) + F.lit(0.0)
    flat = lambda x: F.signum(x) * F.log(1 + F.abs(x))
    show = {"~": lambda n: rounded(F.col(n).cast("double")), "^": lambda n: rounded(flat(F.col(n).cast("double"))), "#": lambda n: F.col(n).cast("long")}
    return df.select(*[show[c[0]](_name(c)).alias(_name(c)) if c[0] in show else F.col(c) for c in columns])


def _shown_sql(columns: list[str]) -> str:
    flat = 'sign(CAST("{0}" AS DOUBLE)) * ln(1 + abs(CAST("{0}" AS DOUBLE)))'
    show = {"~": 'round(CAST("{0}" AS DOUBLE) + 3e-8::DOUBLE, 6) + 0.0::DOUBLE AS "{0}"', "^": f'round({flat} + 3e-8::DOUBLE, 6) + 0.0::DOUBLE AS "{{0}}"', "#": 'CAST("{0}" AS BIGINT) AS "{0}"'}
    return ", ".join(show.get(c[0], '"{0}"').format(_name(c)) for c in columns)


def query(columns: str, ctes: str = "", body: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, and its SQL if there is any."""
    names = columns.split()

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _shown(f(spark, sf_dir), names)
        if body is not None:
            ORACLES[f.__name__] = (f"WITH {ctes} " if ctes else "") + f"SELECT {_shown_sql(names)} FROM ({body}) AS result"
        return f

    return register


# -- shared parts ----------------------------------------------------------------


def _scratch(spark) -> str:
    """A new folder beside the checkpoints, which goes when the session's JVM ends; a local
    session without such a place gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.gettempdir() + "/tidemark-streams"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _version(spark, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)))


#: By session, table and folder: what the line items were, and where the table is.
_stored: dict[tuple, tuple[tuple, str]] = {}


def _once(spark, name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Tables that most queries start from are written once a session and read by the others.

    They are small beside the line items they are made of: a row per market, role and
    day, and one per market and week.  As they are files, plans on them stay short and a
    lost executor takes nothing along.  They are written anew if the line items change.
    """
    key, now = (spark.sparkContext.applicationId, name, sf_dir), _version(spark, f"{sf_dir}/lineitem.parquet")
    if _stored.get(key, (None,))[0] != now:
        folder = _scratch(spark)
        build().write.parquet(folder)
        _stored[key] = now, folder
    return spark.read.parquet(_stored[key][1])


def days(spark, sf_dir) -> DataFrame:
    return _once(spark, "days", sf_dir, lambda: panel.daily(panel.trades(spark, sf_dir)))


def positions(spark, sf_dir) -> DataFrame:
    return panel.positions(days(spark, sf_dir))


def prices(spark, sf_dir) -> DataFrame:
    return panel.prices(days(spark, sf_dir))


def all_states(spark, sf_dir) -> DataFrame:
    return _once(spark, "states", sf_dir, lambda: states.market_states(positions(spark, sf_dir), prices(spark, sf_dir), AS_OF, panel.INVERSE))


def _weeks(*columns: str) -> str:
    return " ".join(("market", "report_date", *columns))


# -- panel and metrics -----------------------------------------------------------


@query(
    "market role report_date ~long ~short ~open_interest ~net ~net_oi ~long_oi ~short_oi",
    sql.PANEL,
    """SELECT *, "long" - "short" AS net, ("long" - "short") / nullif(open_interest, 0) AS net_oi, "long" / nullif(open_interest, 0) AS long_oi, "short" / nullif(open_interest, 0) AS short_oi
    FROM (SELECT market, "role", report_date, "long", "short", open_interest FROM pos UNION ALL
      SELECT market, 'residual', report_date, greatest(max(open_interest) - sum("long"), 0), greatest(max(open_interest) - sum("short"), 0), max(open_interest) FROM pos GROUP BY 1, 3)""",
)
def panel_positions(spark, sf_dir):
    return metrics.basic(panel.with_residual(positions(spark, sf_dir)))


CHANGES = "~chg_1w ~chg_4w ~chg_8w ~chg_13w ~chg_26w ~chg_52w ~long_chg_1w ~long_chg_4w ~long_chg_13w ~short_chg_1w ~short_chg_4w ~short_chg_13w ~oi_chg_1w ~oi_chg_4w"


@query("market role report_date " + CHANGES, sql.metrics(), "SELECT * FROM met")
def changes(spark, sf_dir):
    return metrics.changes(metrics.basic(positions(spark, sf_dir)))


@query("market role report_date ~pct_13w ~pct_26w ~pct_52w ~pct_156w ~pct_260w ~oi_pct_52w ~net_rank_156w", sql.metrics(), "SELECT * FROM met")
def percentile_excl(spark, sf_dir):
    return metrics.processed(positions(spark, sf_dir))


@query("market role report_date ~z_13w ~z_26w ~z_52w ~z_156w ~z_260w ~chg_4w_z", sql.metrics(), "SELECT * FROM met")
def zscore_excl(spark, sf_dir):
    return metrics.processed(positions(spark, sf_dir))


@query("market role report_date #streak_up_weeks #streak_down_weeks", sql.metrics(), "SELECT * FROM met")
def streaks(spark, sf_dir):
    return metrics.streaks(metrics.basic(positions(spark, sf_dir)))


@query(
    "market role report_date ~spread_ratio spread_flag",
    sql.metrics(),
    """SELECT *, CASE WHEN spread_ratio IS NULL THEN NULL WHEN spread_ratio < 0.5 THEN 'compression' WHEN spread_ratio > 1.5 THEN 'expansion' ELSE 'normal' END AS spread_flag FROM (
      SELECT *, CASE WHEN count(net_oi) OVER a = 8 THEN stddev_samp(net_oi) OVER a END / nullif(CASE WHEN count(net_oi) OVER b = 8 THEN stddev_samp(net_oi) OVER b END, 0) AS spread_ratio
      FROM met WINDOW a AS (PARTITION BY market, "role" ORDER BY report_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), b AS (PARTITION BY market, "role" ORDER BY report_date ROWS BETWEEN 15 PRECEDING AND 8 PRECEDING))""",
)
def compression(spark, sf_dir):
    return metrics.compression(metrics.basic(positions(spark, sf_dir)))


@query(
    "market role report_date ~ind_pct ~ind_z ind_extreme ind_mark",
    sql.metrics(),
    """SELECT *, ind_extreme AND NOT coalesce(lag(ind_extreme) OVER (PARTITION BY market, "role" ORDER BY report_date), false) AS ind_mark FROM (
      SELECT *, coalesce(ind_pct <= 10 OR ind_pct >= 90, false) AS ind_extreme FROM (
        SELECT *, CASE WHEN seen IS NOT NULL AND len(h) > 0 THEN 100.0::DOUBLE * len(list_filter(h, lambda y: y < seen)) / len(h) END AS ind_pct FROM (
          SELECT *, list(seen) FILTER (seen IS NOT NULL) OVER f AS h, (seen - avg(seen) OVER f) / nullif(stddev_samp(seen) OVER f, 0) AS ind_z FROM (
            SELECT *, lag(net) OVER (PARTITION BY market, "role" ORDER BY report_date) AS seen FROM bas)
          WINDOW f AS (PARTITION BY market, "role" ORDER BY report_date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))))""",
)
def chart_indicator(spark, sf_dir):
    return metrics.indicator(metrics.basic(positions(spark, sf_dir)))


# -- prices and returns ----------------------------------------------------------


@query(
    _weeks("~close_after", "~close_before", "~close_within_2d"),
    sql.metrics(),
    """SELECT k.market, k.report_date, a.close AS close_after, b.close AS close_before, CASE WHEN a.date - k.report_date <= 2 THEN a.close END AS close_within_2d
    FROM (SELECT DISTINCT market, report_date FROM pos) k ASOF LEFT JOIN pr a ON k.market = a.market AND k.report_date <= a.date
    ASOF LEFT JOIN pr b ON k.market = b.market AND k.report_date >= b.date""",
)
def price_asof(spark, sf_dir):
    weeks, p = positions(spark, sf_dir).select("market", "report_date").distinct(), prices(spark, sf_dir)
    rows = asof.backward(asof.forward(weeks, p, "report_date", "close_after"), p, "report_date", "close_before")
    return asof.forward(rows, p, "report_date", "close_within_2d", tolerance_days=2)


@query(_weeks("~price_close", "~price_chg_4w", "~price_chg_8w", "~price_chg_12w", "~price_chg_8w_z"), sql.states(), "SELECT * FROM st")
def price_changes(spark, sf_dir):
    weeks = positions(spark, sf_dir).select("market", "report_date").distinct()
    return states.price_features(weeks, prices(spark, sf_dir))


@query(_weeks("availability_date", *[f"~fwd_return_{h}w" for h in HORIZONS]), sql.states(), "SELECT * FROM st")
def fwd_returns(spark, sf_dir):
    weeks = calendar.with_availability(positions(spark, sf_dir).select("market", "report_date").distinct())
    found = asof.forward_returns(weeks, prices(spark, sf_dir), HORIZONS, AS_OF, panel.INVERSE)
    return weeks.join(found, ["market", "report_date"], "left")


@query(
    _weeks("#n_prices", "~mfe", "~mae"),
    sql.states(),
    """SELECT market, report_date, n_prices, CASE WHEN n_prices >= 2 AND p0 <> 0 THEN hi / p0 - 1 END AS mfe, CASE WHEN n_prices >= 2 AND p0 <> 0 THEN lo / p0 - 1 END AS mae FROM (
      SELECT a.market, a.report_date, count(*) AS n_prices, arg_min(close, date) AS p0, max(close) AS hi, min(close) AS lo
      FROM avl a JOIN pr p ON a.market = p.market AND p.date BETWEEN a.availability_date AND a.availability_date + 56 GROUP BY 1, 2)""",
)
def excursions(spark, sf_dir):
    weeks = calendar.with_availability(positions(spark, sf_dir).select("market", "report_date").distinct())
    return asof.excursions(weeks, prices(spark, sf_dir), 8)


# -- calendar and guard ----------------------------------------------------------


@query(
    "report_date availability_date availability_source availability_warning",
    "",
    f"""SELECT d AS report_date, {sql.availability("d")[0]} AS availability_date, CASE WHEN {sql.availability("d")[1]} THEN 'published_schedule' ELSE 'derived_rule' END AS availability_source,
    NOT {sql.availability("d")[1]} AND d {sql.LAPSE_TEST} AS availability_warning
    FROM (SELECT DISTINCT unnest([d, CAST(d + INTERVAL 372 MONTH AS DATE)]) AS d FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders))""",
)
def availability(spark, sf_dir):
    """The days of the orders and the same days 31 years on, which meet the published schedule and the lapse."""
    day = F.col("o_orderdate").cast("date")
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.explode(F.array(day, F.add_months(day, 372))).alias("report_date"))
    return calendar.with_availability(days.distinct())


@query(
    "#n_rows #n_future #n_unknown #n_available",
    sql.states(),
    """SELECT count(*) AS n_rows, count(*) FILTER (availability_date > DATE '2000-01-01') AS n_future, count(*) FILTER (availability_date IS NULL) AS n_unknown,
    count(*) FILTER (availability_date <= DATE '2000-01-01') AS n_available FROM avl""",
)
def guard_counts(spark, sf_dir):
    weeks = calendar.with_availability(positions(spark, sf_dir).select("market", "report_date").distinct())
    known = guard.available(weeks, "2000-01-01").agg(F.count(F.lit(1)).alias("n_available"))
    return guard.violations(weeks, "2000-01-01").join(known)


# -- states ----------------------------------------------------------------------

STATE_COLUMNS = ["~spec_net", "~spec_pct_52w", "~spec_z_52w", "~spec_chg_4w_z", "~slow_net_oi", "~other_net_oi", "~price_close", "~price_chg_8w_z", "regime"]


@query(_weeks("availability_date", *STATE_COLUMNS, "#n_flags", *[f"~fwd_return_{h}w" for h in HORIZONS]), sql.states(), "SELECT *, div_slow::INT + div_price::INT AS n_flags FROM st")
def market_states(spark, sf_dir):
    return all_states(spark, sf_dir).withColumn("n_flags", F.size("divergence_flags"))


@query(
    "market kind report_date ~change_a ~change_b ~magnitude",
    sql.states(),
    """SELECT *, least(abs(change_a), abs(change_b)) AS magnitude FROM (
      SELECT market, 'slow_spec' AS kind, report_date, slow_net - lag(slow_net, 4) OVER w AS change_a, spec_net - lag(spec_net, 4) OVER w AS change_b FROM st WINDOW w AS (PARTITION BY market ORDER BY report_date)
      UNION ALL SELECT market, 'spec_price', report_date, spec_net - lag(spec_net, 4) OVER w, price_close - lag(price_close, 4) OVER w FROM st WINDOW w AS (PARTITION BY market ORDER BY report_date))
    WHERE change_a * change_b < 0 AND abs(change_a) > 10 AND abs(change_b) > 10""",
)
def divergence(spark, sf_dir):
    wide = states.price_features(states.wide(metrics.basic(positions(spark, sf_dir))), prices(spark, sf_dir))
    return metrics.divergence_events(wide, [("slow_spec", "slow_net", "spec_net"), ("spec_price", "spec_net", "price_close")], floor=10)


@query(_weeks("~spec_net_oi", "~spec_pct_52w", "regime"), sql.states(), "SELECT * FROM st")
def features_json(spark, sf_dir):
    rows = all_states(spark, sf_dir)
    return states.expand_json(states.features_json(rows), {"spec_net_oi": "double", "spec_pct_52w": "double", "regime": "string"})


@query(_weeks("regime", "~spec_pct_52w"), sql.states(), "SELECT market, report_date, regime, spec_pct_52w FROM st QUALIFY row_number() OVER (PARTITION BY market ORDER BY report_date DESC) = 1")
def regime_latest(spark, sf_dir):
    return states.latest(all_states(spark, sf_dir).select("market", "report_date", "regime", "spec_pct_52w"))


@query(
    _weeks("badge", "level", "stance", "flow", "interest", "config"),
    sql.states(),
    """SELECT market, report_date,
    CASE WHEN p <= 5 OR p >= 95 THEN 'extreme' WHEN (p <= 10 AND u >= 2 AND c > 0) OR (p >= 90 AND dn >= 2 AND c < 0) THEN 'reversal' WHEN p <= 20 OR p >= 80 THEN 'crowded'
      WHEN u >= 4 THEN 'accumulation' WHEN dn >= 4 THEN 'distribution' ELSE 'none' END AS badge,
    CASE WHEN spec_pct_52w IS NULL THEN NULL WHEN spec_pct_52w <= 5 THEN 'extreme_low' WHEN spec_pct_52w <= 20 THEN 'low' WHEN spec_pct_52w < 40 THEN 'below_middle' WHEN spec_pct_52w <= 60 THEN 'middle'
      WHEN spec_pct_52w < 80 THEN 'above_middle' WHEN spec_pct_52w < 95 THEN 'high' ELSE 'extreme_high' END AS level,
    sa AS stance,
    CASE WHEN l IS NULL OR s IS NULL THEN NULL WHEN abs(l) < 1 AND abs(s) < 1 THEN 'no_move' WHEN l * s < 0 AND least(abs(l), abs(s)) * 2.5 >= greatest(abs(l), abs(s)) THEN 'two_sided'
      WHEN abs(l) >= abs(s) THEN CASE WHEN l > 0 THEN 'longs_added' ELSE 'longs_cut' END ELSE CASE WHEN s > 0 THEN 'shorts_added' ELSE 'shorts_covered' END END AS flow,
    CASE WHEN n IS NULL OR o IS NULL OR abs(o) < 1 THEN NULL WHEN n > 0 AND o > 0 THEN 'new_longs' WHEN n > 0 AND o < 0 THEN 'short_covering' WHEN n < 0 AND o > 0 THEN 'new_shorts' ELSE 'both_fell' END AS interest,
    CASE WHEN sa IS NULL OR sb IS NULL THEN 'missing' WHEN sa = 'long' AND sb = 'long' THEN 'both_long' WHEN sa = 'short' AND sb = 'short' THEN 'both_short'
      WHEN sa = 'long' AND sb = 'short' THEN 'fast_long_slow_short' WHEN sa = 'short' AND sb = 'long' THEN 'fast_short_slow_long' ELSE 'mixed' END AS config
    FROM (SELECT *, coalesce(spec_pct_52w, 50) AS p, coalesce(spec_streak_up_weeks, 0) AS u, coalesce(spec_streak_down_weeks, 0) AS dn, coalesce(spec_chg_4w, 0) AS c,
      spec_long_chg_1w AS l, spec_short_chg_1w AS s, spec_chg_1w AS n, spec_oi_chg_1w AS o,
      CASE WHEN spec_net_oi > 0.02 THEN 'long' WHEN spec_net_oi < -0.02 THEN 'short' WHEN spec_net_oi IS NOT NULL THEN 'flat' END AS sa,
      CASE WHEN slow_net_oi > 0.02 THEN 'long' WHEN slow_net_oi < -0.02 THEN 'short' WHEN slow_net_oi IS NOT NULL THEN 'flat' END AS sb FROM st)""",
)
def labels_and_badges(spark, sf_dir):
    c = F.col
    return states.wide(metrics.processed(positions(spark, sf_dir), (52,))).select(
        "market",
        "report_date",
        E.badge(c("spec_pct_52w"), c("spec_streak_up_weeks"), c("spec_streak_down_weeks"), c("spec_chg_4w")).alias("badge"),
        E.level_label(c("spec_pct_52w")).alias("level"),
        E.stance(c("spec_net_oi")).alias("stance"),
        E.flow_code(c("spec_long_chg_1w"), c("spec_short_chg_1w")).alias("flow"),
        E.interest_code(c("spec_chg_1w"), c("spec_oi_chg_1w")).alias("interest"),
        E.configuration(c("spec_net_oi"), c("slow_net_oi")).alias("config"),
    )


# -- outcomes --------------------------------------------------------------------

SUMMARY = "#n ~win_rate ~mean_return ~median_return ~p25 ~p75 ~best ~worst ~std quality"
SUMMARY_SQL = """count(r) AS n, avg((r > 0)::INT) AS win_rate, avg(r) AS mean_return, median(r) AS median_return, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.75) AS p75,
  max(r) AS best, min(r) AS worst, stddev_samp(r) AS std"""
LONG_SQL = " UNION ALL ".join(f"SELECT market, report_date, regime, {h} AS horizon, fwd_return_{h}w AS r FROM st" for h in HORIZONS)


@query(
    f"regime horizon {SUMMARY}",
    sql.states(),
    f"SELECT *, CASE WHEN n < 20 THEN 'insufficient' WHEN n < 30 THEN 'low' WHEN n < 50 THEN 'moderate' ELSE 'good' END AS quality FROM (SELECT regime, horizon, {SUMMARY_SQL} FROM ({LONG_SQL}) GROUP BY 1, 2)",
)
def outcome_summary(spark, sf_dir):
    rows = outcomes.long_returns(all_states(spark, sf_dir), ("market", "report_date", "regime"))
    return outcomes.outcomes(rows, ("regime", "horizon"), "r")


BASE = "#n #base_n ~win_rate ~base_win_rate ~win_diff_pp ~median_return ~base_median ~median_diff"
base_sql = """count(r) FILTER (t) AS n, count(r) AS base_n, avg((r > 0)::INT) FILTER (t AND r IS NOT NULL) AS win_rate, avg((r > 0)::INT) AS base_win_rate,
  (avg((r > 0)::INT) FILTER (t AND r IS NOT NULL) - avg((r > 0)::INT)) * 100 AS win_diff_pp, median(r) FILTER (t) AS median_return, median(r) AS base_median, median(r) FILTER (t) - median(r) AS median_diff"""


@query(f"market {BASE}", sql.states(), f"SELECT market, {base_sql} FROM (SELECT market, fwd_return_8w AS r, coalesce(spec_pct_52w >= 80, false) AS t FROM st) GROUP BY 1")
def base_rate(spark, sf_dir):
    return outcomes.compare_to_base(all_states(spark, sf_dir), F.coalesce(F.col("spec_pct_52w") >= 80, F.lit(False)), "fwd_return_8w", ("market",))


@query(
    "market #mfe_n ~mean_mfe ~mean_mae",
    sql.states(),
    """SELECT market, count(*) AS mfe_n, avg(mfe) AS mean_mfe, avg(mae) AS mean_mae FROM (SELECT market, report_date, max(close) / arg_min(close, date) - 1 AS mfe, min(close) / arg_min(close, date) - 1 AS mae
    FROM (SELECT a.market, a.report_date, p.close, p.date FROM st a JOIN pr p ON a.market = p.market AND p.date BETWEEN a.availability_date AND a.availability_date + 28 WHERE regime = 'Extreme Long')
    GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1""",
)
def outcome_excursions(spark, sf_dir):
    rows = all_states(spark, sf_dir).filter("regime = 'Extreme Long'")
    found = asof.excursions(rows, prices(spark, sf_dir), 4).filter("mfe is not null")
    return found.groupBy("market").agg(F.count("mfe").alias("mfe_n"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"))


HISTORY_SQL = f"""
lst AS (SELECT market, arg_max(regime, report_date) AS now, max(report_date) AS last_date FROM st GROUP BY 1),
pst AS (SELECT st.market, st.report_date, st.regime, now, fwd_return_8w AS r, regime = now AND report_date < last_date AS t FROM st JOIN lst USING (market)),
run AS (SELECT market, regime, now, g, count(*) AS weeks FROM (SELECT *, sum(ch) OVER (PARTITION BY market ORDER BY report_date) AS g FROM (
  SELECT p.*, CASE WHEN p.regime IS DISTINCT FROM lag(p.regime) OVER (PARTITION BY p.market ORDER BY p.report_date) THEN 1 ELSE 0 END AS ch FROM pst p JOIN lst USING (market) WHERE report_date < last_date OR p.regime <> lst.now)) GROUP BY 1, 2, 3, 4),
his AS (SELECT market, now AS regime, count(*) FILTER (t) AS occurrences, {base_sql} FROM pst GROUP BY 1, 2),
len AS (SELECT market, median(weeks) AS median_weeks FROM run WHERE regime = now GROUP BY 1)"""


@query(f"market regime #occurrences ~median_weeks {BASE}", sql.states() + "," + HISTORY_SQL, "SELECT his.*, median_weeks FROM his LEFT JOIN len USING (market)")
def regime_history(spark, sf_dir):
    return outcomes.regime_history(all_states(spark, sf_dir))


@query(
    _weeks("regime", "~spec_net_oi", "~spec_pct_52w", "~slow_pct_52w", "#occurrences", "~median_weeks", "~win_diff_pp"),
    sql.states() + "," + HISTORY_SQL,
    "SELECT s.market, s.report_date, s.regime, s.spec_net_oi, s.spec_pct_52w, s.slow_pct_52w, occurrences, median_weeks, win_diff_pp FROM st s JOIN lst ON s.market = lst.market AND s.report_date = last_date JOIN his ON s.market = his.market LEFT JOIN len ON s.market = len.market",
)
def scanner(spark, sf_dir):
    return outcomes.scan(all_states(spark, sf_dir))


@query(
    "market ~max_all ~min_all ~max_5y ~min_5y ~mean_13w",
    sql.states(),
    """SELECT market, max(spec_net) AS max_all, min(spec_net) AS min_all, max(spec_net) FILTER (age <= 261) AS max_5y, min(spec_net) FILTER (age <= 261) AS min_5y, avg(spec_net) FILTER (age <= 13) AS mean_13w
    FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY report_date DESC) AS age FROM st) GROUP BY 1""",
)
def table_stats(spark, sf_dir):
    return outcomes.table_stats(states.wide(metrics.basic(positions(spark, sf_dir))))


@query(
    "market #n ~effect",
    sql.states(),
    "SELECT market, count(fwd_return_1w) FILTER (spec_chg_1w > 0) AS n, avg(fwd_return_1w) FILTER (spec_chg_1w > 0) - avg(fwd_return_1w) AS effect FROM st GROUP BY 1",
)
def signal_recovery(spark, sf_dir):
    up = F.when(F.col("spec_chg_1w") > 0, F.col("fwd_return_1w"))
    return all_states(spark, sf_dir).groupBy("market").agg(F.count(up).alias("n"), (F.avg(up) - F.avg("fwd_return_1w")).alias("effect"))


# -- analogs ---------------------------------------------------------------------

_f = list(ANALOG_FEATURES)
_complete = " AND ".join(f"{f} IS NOT NULL" for f in _f)
ANALOG_SQL = f"""{sql.states()},
ful AS (SELECT * FROM st WHERE {_complete}),
qry AS (SELECT * FROM ful QUALIFY row_number() OVER (PARTITION BY market ORDER BY report_date DESC) = 1),
pol AS (SELECT f.* FROM ful f JOIN qry q ON f.market = q.market AND f.report_date < q.report_date AND f.availability_date <= q.availability_date),
fit AS (SELECT market, {", ".join(f"avg({f}) AS mean_{f}, nullif(stddev_samp({f}), 0) AS std_{f}" for f in _f)} FROM pol GROUP BY 1),
rms AS (SELECT market, coalesce(nullif(sqrt(avg({" + ".join(f"pow({w} * ({f} - mean_{f}) / std_{f}, 2)" for f, w in ANALOG_FEATURES.items())})), 0), 1) AS rms FROM pol JOIN fit USING (market) GROUP BY 1),
dst AS (SELECT p.market, p.report_date, p.fwd_return_8w, sqrt({" + ".join(f"pow({w} * (p.{f} - q.{f}) / std_{f}, 2)" for f, w in ANALOG_FEATURES.items())}) AS distance, rms
  FROM pol p JOIN qry q ON p.market = q.market JOIN fit ON p.market = fit.market JOIN rms ON p.market = rms.market),
ana AS (SELECT *, 100 * exp(-distance / rms) AS similarity, row_number() OVER (PARTITION BY market ORDER BY distance, report_date) AS place FROM dst WHERE distance IS NOT NULL QUALIFY place <= 40)"""


def _analog_parts(spark, sf_dir):
    full = all_states(spark, sf_dir).dropna(subset=_f)
    asked = states.latest(full.select("market", "report_date", "availability_date", *_f))
    last = asked.select("market", F.col("report_date").alias("__q"), F.col("availability_date").alias("__k"))
    pool = full.join(last, "market").filter("report_date < __q and availability_date <= __k").drop("__q", "__k")
    return asked, pool


@query("market ~rms " + " ".join(f"~mean_{f} ~std_{f}" for f in _f), ANALOG_SQL, "SELECT fit.*, rms FROM fit JOIN rms USING (market)")
def analog_fit(spark, sf_dir):
    return analogs.fit(_analog_parts(spark, sf_dir)[1])


@query(_weeks("#place", "~distance", "~similarity"), ANALOG_SQL, "SELECT * FROM ana")
def analog_search(spark, sf_dir):
    return analogs.search(*_analog_parts(spark, sf_dir))


@query(f"market {SUMMARY}", ANALOG_SQL, f"SELECT *, CASE WHEN n < 20 THEN 'insufficient' WHEN n < 30 THEN 'low' WHEN n < 50 THEN 'moderate' ELSE 'good' END AS quality FROM (SELECT market, {SUMMARY_SQL} FROM (SELECT market, fwd_return_8w AS r FROM ana) GROUP BY 1)")
def analog_outcomes(spark, sf_dir):
    return outcomes.outcomes(analogs.search(*_analog_parts(spark, sf_dir)), ("market",), "fwd_return_8w")


_every = f"""{sql.states()},
ful AS (SELECT * FROM st WHERE {_complete}),
fit AS (SELECT market, {", ".join(f"avg({f}) AS mean_{f}, nullif(stddev_samp({f}), 0) AS std_{f}" for f in _f)} FROM ful GROUP BY 1),
rms AS (SELECT market, coalesce(nullif(sqrt(avg({" + ".join(f"pow({w} * ({f} - mean_{f}) / std_{f}, 2)" for f, w in ANALOG_FEATURES.items())})), 0), 1) AS rms FROM ful JOIN fit USING (market) GROUP BY 1),
nbr AS (SELECT q.market, q.report_date AS query_date, p.report_date, sqrt({" + ".join(f"pow({w} * (p.{f} - q.{f}) / std_{f}, 2)" for f, w in ANALOG_FEATURES.items())}) AS distance, rms
  FROM ful q JOIN ful p ON p.market = q.market AND p.report_date < q.report_date AND p.availability_date <= q.availability_date JOIN fit ON q.market = fit.market JOIN rms ON q.market = rms.market)"""


@query(
    "market query_date report_date #place ~distance ~similarity",
    _every,
    "SELECT *, 100 * exp(-distance / rms) AS similarity, row_number() OVER (PARTITION BY market, query_date ORDER BY distance, report_date) AS place FROM nbr WHERE distance IS NOT NULL QUALIFY place <= 40",
)
def analog_neighbours(spark, sf_dir):
    """Every week as a query, by the pivot index, which is stored first."""
    folder = _scratch(spark)
    neighbours.build(all_states(spark, sf_dir).dropna(subset=_f)).write.parquet(folder)
    return neighbours.nearest(spark.read.parquet(folder))


# -- statistics ------------------------------------------------------------------

CHOSEN = "coalesce(spec_pct_52w >= 70, false)"


def _chosen():
    return F.coalesce(F.col("spec_pct_52w") >= 70, F.lit(False))


@query(
    "market #n_a #n_b ~mean_a ~mean_b ~cohens_d",
    sql.states(),
    f"""SELECT *, CASE WHEN n_a >= 2 AND n_b >= 2 THEN (mean_a - mean_b) / nullif(sqrt(((n_a - 1) * va + (n_b - 1) * vb) / nullif(n_a + n_b - 2, 0)), 0) END AS cohens_d FROM (
      SELECT market, count(r) FILTER (t) AS n_a, count(r) FILTER (NOT t) AS n_b, avg(r) FILTER (t) AS mean_a, avg(r) FILTER (NOT t) AS mean_b, var_samp(r) FILTER (t) AS va, var_samp(r) FILTER (NOT t) AS vb
      FROM (SELECT market, fwd_return_8w AS r, {CHOSEN} AS t FROM st) GROUP BY 1)""",
)
def cohens_d(spark, sf_dir):
    return statistics.cohens_d(all_states(spark, sf_dir), ("market",), "fwd_return_8w", _chosen())


_ps = "SELECT o_custkey AS family, o_orderkey AS id, ((o_orderkey * 7919) % 1000 + 1) / 1001.0::DOUBLE * CASE WHEN o_orderkey % 17 = 0 THEN 0.0001::DOUBLE ELSE 1.0::DOUBLE END AS p FROM orders"


@query(
    "#family #id ~p #rank #m ~threshold rejected",
    "",
    f"""SELECT *, max(CASE WHEN "rank" = lst THEN p END) OVER (PARTITION BY family) AS threshold, coalesce("rank" <= lst, false) AS rejected FROM (
      SELECT *, max(CASE WHEN p <= 0.05::DOUBLE * "rank" / m THEN "rank" END) OVER (PARTITION BY family) AS lst FROM (
        SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS "rank", count(*) OVER (PARTITION BY family) AS m FROM ({_ps})))""",
)
def benjamini_hochberg(spark, sf_dir):
    return statistics.benjamini_hochberg(_tests(spark, sf_dir), "p", by=("family",))


def _tests(spark, sf_dir):
    k = F.col("o_orderkey")
    p = (k * 7919 % 1000 + 1) / F.lit(1001.0) * F.when(k % 17 == 0, 0.0001).otherwise(1.0)
    # every order stands for a test, every customer for a family of tests
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("family"), k.alias("id"), p.alias("p"))


def _boot_sql(block: int) -> str:
    idx = "CAST(('0x' || substr(md5('42:' || draw || ':' || {p}), 1, 8))::UBIGINT % {n} AS INTEGER)"
    start = idx.format(p="(p // block)", n="(n - block + 1)")
    return f"""{sql.states()},
val AS (SELECT market, list(r ORDER BY report_date) AS v, count(*) AS n, least({block}, count(*)) AS block FROM (SELECT market, report_date, fwd_return_8w AS r FROM st WHERE {CHOSEN} AND fwd_return_8w IS NOT NULL) GROUP BY 1 HAVING count(*) >= 10),
drw AS (SELECT market, v, n, block, draw, unnest(generate_series(0, n - 1)) AS p FROM val CROSS JOIN (SELECT unnest(generate_series(0, {DRAWS - 1})) AS draw)),
smp AS (SELECT market, n, draw, v[{start} + p % block + 1] AS x FROM drw),
ech AS (SELECT market, n, draw, median(x) AS median, avg(x) AS mean, avg((x > 0)::INT) AS win_rate FROM smp GROUP BY 1, 2, 3),
bot AS (SELECT market, n, {", ".join(f"quantile_cont({s}, {q}) AS {s}_{e}" for s in ("median", "mean", "win_rate") for e, q in (("lo", 0.025), ("hi", 0.975)))} FROM ech GROUP BY 1, 2)"""


BOOT = "market #n ~median_lo ~median_hi ~mean_lo ~mean_hi ~win_rate_lo ~win_rate_hi"


@query(BOOT, _boot_sql(1), "SELECT * FROM bot")
def bootstrap(spark, sf_dir):
    return statistics.bootstrap(all_states(spark, sf_dir).filter(_chosen()), ("market",), "fwd_return_8w", ("report_date",), draws=DRAWS)


@query(BOOT, _boot_sql(8), "SELECT * FROM bot")
def block_bootstrap(spark, sf_dir):
    return statistics.bootstrap(all_states(spark, sf_dir).filter(_chosen()), ("market",), "fwd_return_8w", ("report_date",), block=8, draws=DRAWS)


PERMUTED = f"""SELECT market, any_value(k) AS k, any_value(n) AS population, any_value(obs) AS mean_return, avg((round(abs(m - c), 9) >= round(abs(obs - c), 9))::INT) AS p FROM (
      SELECT market, draw, k, n, obs, c, avg(v[CAST(('0x' || substr(md5('42:' || draw || ':' || p), 1, 8))::UBIGINT % n AS INTEGER) + 1]) AS m FROM (
        SELECT *, unnest(generate_series(0, k - 1)) AS p FROM (SELECT market, list(r ORDER BY report_date) AS v, count(*) AS n, count(*) FILTER (t) AS k, avg(r) FILTER (t) AS obs, avg(r) AS c
          FROM (SELECT market, report_date, fwd_return_8w AS r, {CHOSEN} AS t FROM st WHERE fwd_return_8w IS NOT NULL) GROUP BY 1)
        CROSS JOIN (SELECT unnest(generate_series(0, {DRAWS - 1})) AS draw)) GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1"""


@query(
    "market #k #population ~mean_return ~p_value",
    sql.states(),
    "SELECT *, chance AS p_value FROM (" + PERMUTED.replace("AS p FROM (", "AS chance FROM (", 1) + ")",
)
def permutation_test(spark, sf_dir):
    return statistics.permutation(all_states(spark, sf_dir), ("market",), "fwd_return_8w", ("report_date",), _chosen(), draws=DRAWS)


@query(
    "market mode #used_n ~win_rate ~median_return ~mean_return #effective_n quality",
    sql.states(),
    f"""SELECT *, CASE WHEN effective_n < 10 THEN 'insufficient' WHEN effective_n < 20 THEN 'weak' WHEN effective_n < 40 THEN 'moderate' WHEN effective_n < 80 THEN 'good' ELSE 'strong' END AS quality FROM (
      SELECT market, mode, count(r) AS used_n, avg((r > 0)::INT) AS win_rate, median(r) AS median_return, avg(r) AS mean_return,
      CASE WHEN mode = 'non_overlapping' THEN count(r) ELSE greatest(1, CAST(round_even(count(r) / 8, 0) AS BIGINT)) END AS effective_n
      FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY report_date) - 1 AS pos FROM (SELECT market, report_date, fwd_return_8w AS r FROM st WHERE {CHOSEN} AND fwd_return_8w IS NOT NULL))
      CROSS JOIN (SELECT unnest(['raw', 'block', 'non_overlapping']) AS mode) WHERE mode <> 'non_overlapping' OR pos % 8 = 0 GROUP BY 1, 2)""",
)
def sampling_modes(spark, sf_dir):
    return statistics.sampling_modes(all_states(spark, sf_dir).filter(_chosen()), ("market",), "fwd_return_8w", ("report_date",), 8)


@query(
    "market #n ~win_rate ~base_win_rate ~win_diff_pp ~win_rate_lo ~win_rate_hi #effective_n quality verdict",
    _boot_sql(8),
    f"""SELECT *, CASE WHEN effective_n < 10 THEN 'insufficient' WHEN effective_n < 20 THEN 'weak' WHEN effective_n < 40 THEN 'moderate' WHEN effective_n < 80 THEN 'good' ELSE 'strong' END AS quality,
      CASE WHEN effective_n < 10 THEN 'not_proven' WHEN win_diff_pp IS NULL THEN 'no_data' WHEN abs(win_diff_pp) < 5 THEN 'noise' WHEN coalesce(base_win_rate BETWEEN win_rate_lo AND win_rate_hi, false) THEN 'unconfirmed' ELSE 'robust' END AS verdict
    FROM (SELECT b.*, win_rate_lo, win_rate_hi, greatest(1, CAST(round_even(b.n / 8, 0) AS BIGINT)) AS effective_n
      FROM (SELECT market, {base_sql} FROM (SELECT market, fwd_return_8w AS r, {CHOSEN} AS t FROM st) GROUP BY 1) b LEFT JOIN bot ON b.market = bot.market)""",
)
def edge_evidence(spark, sf_dir):
    return statistics.edge_evidence(all_states(spark, sf_dir), ("market",), "fwd_return_8w", ("report_date",), _chosen(), 8, draws=DRAWS)


def _binomial_sql(k: str, n: str, p: str) -> str:
    log = lambda i: f"(lgamma({n} + 1) - lgamma({i} + 1) - lgamma({n} - {i} + 1) + {i} * ln({p}) + ({n} - {i}) * ln(1 - {p}))"
    each = f"list_transform(generate_series(0, CAST({n} AS BIGINT)), lambda i: exp({log('i')}))"
    exact = f"least(1.0::DOUBLE, list_sum(list_filter({each}, lambda c: c <= exp({log(k)}) * (1 + 1e-7::DOUBLE))))"
    return f"CASE WHEN {n} = 0 OR {p} IS NULL THEN NULL WHEN {p} IN (0, 1) THEN CASE WHEN {k} = {n} * {p} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {exact} END"


@query(
    "market #n ~win_rate ~base_win_rate ~p_value",
    sql.states(),
    f"""SELECT *, {_binomial_sql("k", "n", "base_win_rate")} AS p_value FROM (SELECT *, CAST(round(win_rate * n) AS DOUBLE) AS k
      FROM (SELECT market, {base_sql} FROM (SELECT market, fwd_return_8w AS r, {CHOSEN} AS t FROM st) GROUP BY 1))""",
)
def binomial_test(spark, sf_dir):
    base = outcomes.compare_to_base(all_states(spark, sf_dir), _chosen(), "fwd_return_8w", ("market",))
    return base.withColumn("p_value", statistics.binomial_p(F.round(F.col("win_rate") * F.col("n")), F.col("n"), F.col("base_win_rate")))


# -- events ----------------------------------------------------------------------

KEYS = [e[0] for e in EVENTS]


@query(_weeks(*[f"~move_{k}" for k in KEYS], *[f"ev_{k}" for k in KEYS]), sql.moves(), "SELECT * FROM evt")
def forward_moves(spark, sf_dir):
    return events.with_events(all_states(spark, sf_dir))


@query("market " + " ".join(f"~thr_{k}" for k in KEYS), sql.moves(), "SELECT * FROM thr")
def event_thresholds(spark, sf_dir):
    return events.thresholds(events.with_moves(all_states(spark, sf_dir)))


@query(_weeks(*[f"c_{k}" for k in CONDITIONS]), sql.conditions(), "SELECT * FROM cnd")
def nine_conditions(spark, sf_dir):
    return events.with_conditions(all_states(spark, sf_dir))


_cells = " UNION ALL ".join(f"SELECT market, '{c}' AS cond, '{e}' AS event, c_{c} AS x, ev_{e} AS y FROM cnd" for c in CONDITIONS for e in KEYS)

_dated = _cells.replace("SELECT market,", "SELECT market, report_date,")


@query(
    "market cond event #a #b #c #d #n ~rate_with ~rate_without ~base_rate ~lift_pp verdict",
    sql.conditions(),
    f"""SELECT *, CASE WHEN n < 15 THEN 'few' WHEN lift_pp IS NULL THEN 'no_data' WHEN abs(lift_pp) < 5 THEN 'noise' WHEN lift_pp > 0 THEN 'more_often' ELSE 'less_often' END AS verdict FROM (
      SELECT *, (rate_with - base_rate) * 100 AS lift_pp FROM (SELECT *, a + b AS n, a / nullif(a + b, 0) AS rate_with, c / nullif(c + d, 0) AS rate_without, (a + c) / nullif(a + b + c + d, 0) AS base_rate FROM (
        SELECT market, cond, event, count(*) FILTER (x AND y) AS a, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c, count(*) FILTER (NOT x AND NOT y) AS d
        FROM ({_cells}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3)))""",
)
def contingency(spark, sf_dir):
    return events.contingency(all_states(spark, sf_dir))


LARGEST = (
    "lrg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, event ORDER BY move DESC, report_date) AS place, count(move) OVER (PARTITION BY market, event) AS n_moves_all FROM ("
    + " UNION ALL ".join(f"SELECT *, '{k}' AS event, move_{k} AS move FROM {{0}}" for k in KEYS)
    + ") WHERE move IS NOT NULL) WHERE place <= 25 AND n_moves_all >= 50)"
)
_m = events.PRECURSOR_METRICS


@query(
    "market event metric #n_moves ~before ~always ~diff",
    sql.moves()
    + f", bef AS (SELECT *, {', '.join(f'avg({m}) OVER w AS b_{m}' for m in _m)} FROM mov WINDOW w AS (PARTITION BY market ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), "
    + LARGEST.format("bef"),
    "SELECT *, before - always AS diff FROM ("
    + " UNION ALL ".join(
        f"SELECT l.market, l.event, '{m}' AS metric, l.n_moves, before, always FROM (SELECT market, event, count(*) AS n_moves, avg(b_{m}) AS before FROM lrg GROUP BY 1, 2) l JOIN (SELECT market, avg({m}) AS always FROM mov GROUP BY 1) a ON l.market = a.market" for m in _m
    )
    + ") WHERE n_moves >= 5 AND before IS NOT NULL AND always IS NOT NULL",
)
def precursor_metrics(spark, sf_dir):
    return events.precursor_metrics(all_states(spark, sf_dir))


@query(
    "market event cond #n_moves ~share_before ~base_share ~diff_pp",
    sql.conditions()
    + f", bef AS (SELECT *, {', '.join(f'coalesce(max(c_{c}::INT) OVER w, 0) AS h_{c}' for c in CONDITIONS)} FROM cnd WINDOW w AS (PARTITION BY market ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), "
    + LARGEST.format("bef"),
    "SELECT *, (share_before - base_share) * 100 AS diff_pp FROM ("
    + " UNION ALL ".join(
        f"SELECT l.market, l.event, '{c}' AS cond, l.n_moves, share_before, base_share FROM (SELECT market, event, count(*) AS n_moves, avg(h_{c}) AS share_before FROM lrg GROUP BY 1, 2) l JOIN (SELECT market, avg(c_{c}::INT) AS base_share FROM cnd GROUP BY 1) a ON l.market = a.market"
        for c in CONDITIONS
    )
    + ") WHERE n_moves >= 5 AND base_share IS NOT NULL",
)
def precursor_conditions(spark, sf_dir):
    return events.precursor_conditions(all_states(spark, sf_dir))


FLAG = "coalesce(spec_pct_52w >= 75, false)"


def _flag():
    return F.col("spec_pct_52w") >= 75


def _episode_sql(gap: int) -> str:
    return f"""{sql.states()},
pos2 AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY report_date) AS n FROM st),
tru AS (SELECT market, report_date, n, CASE WHEN n - lag(n) OVER (PARTITION BY market ORDER BY report_date) - 1 <= {gap} THEN 0 ELSE 1 END AS new FROM pos2 WHERE {FLAG}),
epi AS (SELECT market, episode, min(report_date) AS start_date, max(report_date) AS end_date, max(n) - min(n) + 1 AS weeks FROM (SELECT *, sum(new) OVER (PARTITION BY market ORDER BY report_date) AS episode FROM tru) GROUP BY 1, 2)"""


@query("market #episode start_date end_date #weeks", _episode_sql(1), "SELECT * FROM epi")
def episodes(spark, sf_dir):
    return events.episodes(all_states(spark, sf_dir), _flag(), gap=1)


_h = [-8, -4, -2, -1, 0, 1, 2, 4, 8, 12]
_ret = {h: "0.0::DOUBLE" if h == 0 else f"-(price_close / nullif(lag(price_close, {-h}) OVER w, 0) - 1)" if h < 0 else f"lead(price_close, {h}) OVER w / nullif(price_close, 0) - 1" for h in _h}


@query(
    "market horizon #n ~mean ~median ~p25 ~p75",
    _episode_sql(0)
    + f", pth AS (SELECT market, report_date, unnest([{', '.join(map(str, _h))}]) AS horizon, unnest([{', '.join(_ret[h] for h in _h)}]) AS r FROM st WINDOW w AS (PARTITION BY market ORDER BY report_date))",
    "SELECT p.market, horizon, count(r) AS n, avg(r) AS mean, median(r) AS median, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.75) AS p75 FROM pth p JOIN epi e ON p.market = e.market AND p.report_date = e.start_date GROUP BY 1, 2",
)
def event_study(spark, sf_dir):
    return events.event_study(all_states(spark, sf_dir), _flag())


# -- backtest --------------------------------------------------------------------

TEXT = "spec_pct_52w > 55 and not (spec_streak_down_weeks >= 3) and -1 < spec_net_oi <= 1 and regime in ['Extreme Long', 'Bullish Positioning', 'Accumulation', 'Bearish Reversal']"
TEXT_SQL = "coalesce(spec_pct_52w > 55, false) AND NOT coalesce(spec_streak_down_weeks >= 3, false) AND coalesce(spec_net_oi > -1 AND spec_net_oi <= 1, false) AND regime IN ('Extreme Long', 'Bullish Positioning', 'Accumulation', 'Bearish Reversal')"
TRADES = f"""{sql.states()},
sig AS (SELECT market, report_date, -fwd_return_4w - 0.0005 AS r FROM st WHERE {TEXT_SQL}),
mat AS (SELECT * FROM sig WHERE r IS NOT NULL),
cur AS (SELECT *, product(1 + r) OVER (PARTITION BY market ORDER BY report_date ROWS UNBOUNDED PRECEDING) AS equity FROM mat),
hig AS (SELECT *, max(equity) OVER (PARTITION BY market ORDER BY report_date ROWS UNBOUNDED PRECEDING) AS high FROM cur),
ddn AS (SELECT *, (equity - high) / high AS drawdown FROM hig)"""


def _trades(spark, sf_dir):
    return backtest.signals(all_states(spark, sf_dir), TEXT, 4, "short_currency", cost_bps=5)


@query(_weeks("regime"), sql.states(), f"SELECT market, report_date, regime FROM st WHERE {TEXT_SQL}")
def condition_filter(spark, sf_dir):
    rows = all_states(spark, sf_dir)
    return rows.filter(condition(TEXT, rows.columns))


@query("market #n_signals #n_matured #n_open", TRADES, "SELECT market, count(*) AS n_signals, count(r) AS n_matured, count(*) - count(r) AS n_open FROM sig GROUP BY 1")
def backtest_counts(spark, sf_dir):
    return backtest.counts(_trades(spark, sf_dir))


@query(_weeks("~trade_return", "^equity", "~drawdown"), TRADES, "SELECT *, r AS trade_return FROM ddn")
def backtest_equity(spark, sf_dir):
    return backtest.equity(_trades(spark, sf_dir))


@query(
    "market #n_trades ~win_rate ~avg_win ~avg_loss ~expectancy ~profit_factor no_losses ~sharpe ~sortino ~max_drawdown ^calmar ~holding_weeks",
    TRADES,
    """SELECT *, CASE WHEN loss > 0 THEN profit / loss END AS profit_factor, loss <= 0 AND profit > 0 AS no_losses, CASE WHEN max_drawdown < 0 THEN total / abs(max_drawdown) END AS calmar, 4.0 AS holding_weeks FROM (
      SELECT market, count(*) AS n_trades, avg((r > 0)::INT) AS win_rate, coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, coalesce(avg(r) FILTER (r <= 0), 0) AS avg_loss, avg(r) AS expectancy,
      coalesce(sum(r) FILTER (r > 0), 0) AS profit, coalesce(-sum(r) FILTER (r <= 0), 0) AS loss, avg(r) / nullif(stddev_samp(r), 0) * sqrt(13.0) AS sharpe,
      avg(r) / nullif(stddev_samp(r) FILTER (r < 0), 0) * sqrt(13.0) AS sortino, min(drawdown) AS max_drawdown, arg_max(equity, report_date) - 1 AS total FROM ddn GROUP BY 1)""",
)
def backtest_performance(spark, sf_dir):
    return backtest.performance(_trades(spark, sf_dir), 4)


@query(
    "market #fold #n ~win_rate ~mean_return start_date end_date fades",
    TRADES,
    """SELECT *, first(mean_return) OVER (PARTITION BY market ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) > 0 AND last(mean_return) OVER (PARTITION BY market ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) <= 0 AS fades FROM (
      SELECT market, fold, count(*) AS n, avg((r > 0)::INT) AS win_rate, avg(r) AS mean_return, min(report_date) AS start_date, max(report_date) AS end_date
      FROM (SELECT *, ntile(4) OVER (PARTITION BY market ORDER BY report_date) AS fold, count(*) OVER (PARTITION BY market) AS n_all FROM mat) WHERE n_all >= 20 GROUP BY 1, 2)""",
)
def walk_forward(spark, sf_dir):
    return backtest.folds(_trades(spark, sf_dir))


# -- quality ---------------------------------------------------------------------


@query(
    "market role report_date ~diff ~score",
    sql.PANEL,
    """SELECT *, 0.6745 * (diff - med) / nullif(mad, 0) AS score FROM (SELECT *, median(abs(diff - med)) OVER (PARTITION BY market, "role") AS mad FROM (
      SELECT *, median(diff) OVER (PARTITION BY market, "role") AS med, count(*) OVER (PARTITION BY market, "role") AS n FROM (
        SELECT *, open_interest - lag(open_interest) OVER (PARTITION BY market, "role" ORDER BY report_date) AS diff FROM pos) WHERE diff IS NOT NULL) WHERE n >= 10)
    WHERE CASE WHEN mad = 0 THEN diff <> med ELSE abs(0.6745 * (diff - med) / mad) > 2.0 END""",
)
def quality_jumps(spark, sf_dir):
    return quality.jumps(positions(spark, sf_dir), limit=2.0)


@query(
    "#o_custkey report_date #gap_days",
    "",
    """SELECT * FROM (SELECT o_custkey, report_date, report_date - lag(report_date) OVER (PARTITION BY o_custkey ORDER BY report_date) AS gap_days
      FROM (SELECT DISTINCT o_custkey, CAST(date_trunc('week', o_orderdate) AS DATE) + 1 AS report_date FROM orders)) WHERE gap_days > 7 AND gap_days < 21""",
)
def quality_missing_weeks(spark, sf_dir):
    # the panel has no gaps, the weeks in which a customer orders have
    weeks = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", panel.tuesday(F.col("o_orderdate")).alias("report_date"))
    return quality.missing_weeks(weeks, keys=("o_custkey",))


@query(
    "#o_custkey o_orderpriority #copies #n",
    "",
    "SELECT o_custkey, o_orderpriority, copies, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS copies FROM orders) WHERE copies > 1 GROUP BY 1, 2, 3",
)
def quality_duplicates(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderpriority")
    return quality.duplicates(orders, ("o_custkey", "o_orderpriority")).groupBy("o_custkey", "o_orderpriority", "copies").agg(F.count(F.lit(1)).alias("n"))


@query(
    _weeks("~long", "~short", "~open_interest"),
    sql.PANEL,
    'SELECT market, report_date, sum("long") AS "long", sum("short") AS "short", max(open_interest) AS open_interest FROM pos GROUP BY 1, 2 HAVING sum("long") <> max(open_interest) OR sum("short") <> max(open_interest)',
)
def quality_identity(spark, sf_dir):
    return quality.accounting_identity(positions(spark, sf_dir))


@query(
    "market newest #age_days stale",
    sql.states(),
    "SELECT market, max(availability_date) AS newest, DATE '2001-12-01' - max(availability_date) AS age_days, DATE '2001-12-01' - max(availability_date) > 14 AS stale FROM avl GROUP BY 1",
)
def quality_freshness(spark, sf_dir):
    return quality.freshness(calendar.with_availability(positions(spark, sf_dir).select("market", "report_date").distinct()), "2001-12-01")


@query(
    "market result #n_bad",
    sql.PANEL,
    """SELECT market, CASE WHEN count(*) FILTER (s IN ('ok', 'differs')) = 0 THEN 'BLOCKED' WHEN count(*) FILTER (s <> 'ok') > 0 THEN 'FAIL' ELSE 'PASS' END AS result, count(*) FILTER (s <> 'ok') AS n_bad FROM (
      SELECT coalesce(a.market, b.market) AS market, CASE WHEN a.market IS NULL THEN 'missing_left' WHEN b.market IS NULL THEN 'missing_right' WHEN v IS NOT DISTINCT FROM u THEN 'ok' ELSE 'differs' END AS s
      FROM (SELECT market, "role", report_date, unnest(["long", "short"]) AS v, unnest([1, 2]) AS f FROM pos WHERE market <> 'ASIA') a
      FULL JOIN (SELECT market, "role", report_date, unnest(["long" + CASE WHEN market = 'EUROPE' AND day(report_date) = 9 THEN 1 ELSE 0 END, "short"]) AS u, unnest([1, 2]) AS f FROM pos WHERE market <> 'AFRICA' OR year(report_date) < 2000) b
      ON a.market = b.market AND a."role" = b."role" AND a.report_date = b.report_date AND a.f = b.f) GROUP BY 1""",
)
def reconciliation(spark, sf_dir):
    rows = positions(spark, sf_dir)
    left = rows.filter("market <> 'ASIA'")
    right = rows.filter("market <> 'AFRICA' or year(report_date) < 2000").withColumn("long", F.col("long") + F.when(F.expr("market = 'EUROPE' and day(report_date) = 9"), 1).otherwise(0))
    return quality.reconcile_status(quality.reconcile(left, right, ["market", "role", "report_date"], ["long", "short"]))


@query(
    "market nearest #days",
    sql.PANEL,
    "SELECT market, arg_min(report_date, abs(report_date - DATE '1999-07-02') * 100000 + (report_date - DATE '1990-01-01')) AS nearest, min(abs(report_date - DATE '1999-07-02')) AS days FROM pos GROUP BY 1",
)
def nearest_date(spark, sf_dir):
    return quality.nearest_date(positions(spark, sf_dir), "1999-07-02")


_want = ", ".join("('{}', '{}')".format(c, m) for c, m in (("A", "BURNISHED|PLATED"), ("B", "no such part|STEEL"), ("C", "ECONOMY|BRUSHED")))


@query(
    "code name variant",
    "",
    f"""SELECT code, name, variant FROM (SELECT code, name, variant, row_number() OVER (PARTITION BY code ORDER BY pos, length(name), name) AS place FROM (SELECT DISTINCT p_type AS name FROM part) n
      JOIN (SELECT code, unnest(string_split(m, '|')) AS variant, unnest(generate_series(0, len(string_split(m, '|')) - 1)) AS pos FROM (VALUES {_want}) AS w(code, m)) v ON contains(upper(name), upper(variant))) WHERE place = 1""",
)
def contract_resolution(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("name"))
    wanted = spark.createDataFrame([("A", "BURNISHED|PLATED"), ("B", "no such part|STEEL"), ("C", "ECONOMY|BRUSHED")], "code string, match string")
    return quality.resolve_contracts(names, wanted)


_registered = ", ".join(f"({i}, '{m.code}', '{m.sector}', '{m.report}', {m.inverse}, {m.pip})" for i, m in enumerate(MARKETS.values()))


@query(
    "code sector report inverse ~pip #n_orders ~total",
    "",
    f"""SELECT code, sector, report, inverse, pip, count(o_orderkey) AS n_orders, sum(o_totalprice) AS total FROM (VALUES {_registered}) AS m(i, code, sector, report, inverse, pip)
    LEFT JOIN orders ON o_custkey % {len(MARKETS)} = i GROUP BY 1, 2, 3, 4, 5""",
)
def market_registry(spark, sf_dir):
    """Orders dealt to the markets by customer, with each market's attributes."""
    dims = spark.createDataFrame([(i, m.code, m.sector, m.report, m.inverse, m.pip) for i, m in enumerate(MARKETS.values())], "i int, code string, sector string, report string, inverse boolean, pip double")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy((F.col("o_custkey") % len(MARKETS)).alias("i")).agg(F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    return dims.join(orders, "i", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))


@query(
    "market participant report_date #long #short",
    sql.PANEL,
    """SELECT market, participant, report_date, "long", "short" FROM (SELECT market, report_date, unnest(['spec', 'slow', 'other']) AS participant, unnest([sl, wl, ol]) AS "long", unnest([ss, ws, os]) AS "short" FROM (
      SELECT market, report_date, coalesce(max("long") FILTER ("role" = 'spec'), 0) AS sl, coalesce(max("short") FILTER ("role" = 'spec'), 0) AS ss, coalesce(max("long") FILTER ("role" = 'slow'), 0) AS wl,
      coalesce(max("short") FILTER ("role" = 'slow'), 0) AS ws, coalesce(max("long") FILTER ("role" = 'other'), 0) AS ol, coalesce(max("short") FILTER ("role" = 'other'), 0) AS os FROM pos GROUP BY 1, 2))""",
)
def unpivot_participants(spark, sf_dir):
    wide = states.wide(positions(spark, sf_dir), columns=("long", "short"))
    return panel.unpivot_participants(wide, {r: (f"{r}_long", f"{r}_short") for r in states.ROLES}, ["market", "report_date"])


@query(
    "market role report_date ~long #version",
    sql.PANEL,
    """SELECT market, "role", report_date, "long", 1 AS version FROM pos WHERE report_date < DATE '1999-06-01' UNION ALL
      SELECT market, "role", report_date, "long" + 1, 2 FROM pos WHERE report_date >= DATE '1999-06-01'""",
)
def append_ignore(spark, sf_dir):
    from ..sources.store import new_rows

    rows = positions(spark, sf_dir)
    have = rows.filter("report_date < '1999-06-01'").select("market", "role", "report_date", "long", F.lit(1).alias("version"))
    arriving = rows.select("market", "role", "report_date", (F.col("long") + 1).alias("long"), F.lit(2).alias("version"))
    return have.unionByName(new_rows(arriving, have, ["market", "role", "report_date"]))


# -- further views of the states -----------------------------------------------------


@query(
    _weeks("regime", "reasons"),
    sql.states(),
    "SELECT market, report_date, regime, CASE regime "
    + " ".join("WHEN '{}' THEN {}".format(name, " || '; ' || ".join(f"'{c} {op} {limit} (actual: ' || CAST({c} AS VARCHAR) || ')'" for c, op, limit in conditions) or "'No rule met.'") for name, conditions in REGIMES)
    + " END AS reasons FROM st",
)
def regime_reasons(spark, sf_dir):
    return all_states(spark, sf_dir).withColumn("reasons", F.array_join("regime_reasons", "; "))


@query(
    _weeks("extremity", "momentum", "hedged"),
    sql.states(),
    """SELECT market, report_date,
    CASE WHEN p IS NULL THEN NULL WHEN p <= 5 THEN 'extreme_low' WHEN p <= 20 THEN 'near_low' WHEN p >= 95 THEN 'extreme_high' WHEN p >= 80 THEN 'near_high' WHEN p BETWEEN 40 AND 60 THEN 'middle' ELSE 'usual' END AS extremity,
    CASE WHEN spec_streak_up_weeks >= 2 THEN 'streak_up' WHEN spec_streak_down_weeks >= 2 THEN 'streak_down' WHEN spec_chg_4w IS NULL THEN 'unknown' WHEN spec_chg_4w > 0 THEN 'month_up' WHEN spec_chg_4w < 0 THEN 'month_down' ELSE 'flat' END AS momentum,
    CASE WHEN spec_net_oi IS NULL THEN 'missing' WHEN spec_net_oi > 0.02 THEN 'funds_long_hedgers_short' WHEN spec_net_oi < -0.02 THEN 'funds_short_hedgers_long' ELSE 'funds_flat' END AS hedged
    FROM (SELECT *, spec_pct_52w AS p FROM st)""",
)
def extremity_and_momentum(spark, sf_dir):
    c = F.col
    return all_states(spark, sf_dir).select(
        "market",
        "report_date",
        E.extremity(c("spec_pct_52w")).alias("extremity"),
        E.momentum(c("spec_streak_up_weeks"), c("spec_streak_down_weeks"), c("spec_chg_4w")).alias("momentum"),
        E.configuration(c("spec_net_oi"), c("slow_net_oi"), hedger=True).alias("hedged"),
    )


_words = list(states.DIVERGENCES.values())


@query(
    _weeks("words"),
    sql.states(),
    f"SELECT market, report_date, array_to_string(list_filter([CASE WHEN div_slow THEN '{_words[0]}' END, CASE WHEN div_price THEN '{_words[1]}' END], lambda x: x IS NOT NULL), '; ') AS words FROM st",
)
def divergence_words(spark, sf_dir):
    return all_states(spark, sf_dir).withColumn("words", F.array_join(states.divergence_words(F.col("divergence_flags")), "; "))


_table_cells = [f"{r}_{m}" for r in states.ROLES for m in states.TABLE_METRICS]


@query(
    _weeks("#age", *[f"~{c}" for c in _table_cells]),
    sql.states(),
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY report_date DESC) AS age FROM st) WHERE age <= 80",
)
def recent_table(spark, sf_dir):
    return states.table_rows(all_states(spark, sf_dir))


@query(f"market regime horizon {BASE}", sql.states() + "," + HISTORY_SQL, f"SELECT market, regime, horizon, {base_sql} FROM (SELECT l.market, now AS regime, horizon, r, l.regime = now AND report_date < last_date AS t FROM ({LONG_SQL}) l JOIN lst USING (market)) GROUP BY 1, 2, 3")
def regime_comparisons(spark, sf_dir):
    return outcomes.regime_comparisons(all_states(spark, sf_dir))


@query("market regime report_date", sql.states() + "," + HISTORY_SQL, "SELECT market, regime, report_date FROM pst WHERE t")
def regime_dates(spark, sf_dir):
    return outcomes.regime_dates(all_states(spark, sf_dir))


# -- assessment and hypotheses -------------------------------------------------------

TESTS = 24


@query(
    "market #n sufficient quality ~median_lo ~median_hi ~permutation_p ~cohens_d ~binomial_p many_tests",
    _boot_sql(1),
    f"""SELECT market, n, n >= {MIN_SAMPLE} AS sufficient, CASE WHEN n < 20 THEN 'insufficient' WHEN n < 30 THEN 'low' WHEN n < 50 THEN 'moderate' ELSE 'good' END AS quality,
      CASE WHEN n >= {MIN_SAMPLE} THEN median_lo END AS median_lo, CASE WHEN n >= {MIN_SAMPLE} THEN median_hi END AS median_hi, CASE WHEN n >= {MIN_SAMPLE} THEN p END AS permutation_p,
      CASE WHEN n >= {MIN_SAMPLE} AND base_n >= 2 THEN (m - bm) / nullif(sqrt(((n - 1) * v + (base_n - 1) * bv) / (n + base_n - 2)), 0) END AS cohens_d,
      CASE WHEN n >= {MIN_SAMPLE} THEN {_binomial_sql("k", "n", "base_win_rate")} END AS binomial_p, n >= {MIN_SAMPLE} AS many_tests
    FROM (SELECT market, count(r) FILTER (t) AS n, count(r) AS base_n, avg(r) FILTER (t) AS m, avg(r) AS bm, var_samp(r) FILTER (t) AS v, var_samp(r) AS bv,
        CAST(count(*) FILTER (t AND r > 0) AS DOUBLE) AS k, avg((r > 0)::INT) AS base_win_rate FROM (SELECT market, fwd_return_8w AS r, {CHOSEN} AS t FROM st) GROUP BY 1) a
    LEFT JOIN (SELECT market, median_lo, median_hi FROM bot) b USING (market)
    LEFT JOIN (SELECT market, p FROM ({PERMUTED})) c USING (market)""",
)
def assessment(spark, sf_dir):
    return statistics.assess(all_states(spark, sf_dir), ("market",), "fwd_return_8w", ("report_date",), _chosen(), TESTS, draws=DRAWS)


@query(
    "#family mode #n_tests ~best_p #n_rejected ~threshold ~expected_false many_tests fails_bonferroni confirmed",
    "",
    f"""SELECT *, CASE WHEN n_tests > 1 THEN n_tests * 0.05::DOUBLE END AS expected_false, n_tests > 20 AS many_tests, n_tests > 1 AND best_p > 0.05::DOUBLE / n_tests AS fails_bonferroni,
      mode = 'confirmatory' AND n_rejected > 0 AS confirmed FROM (
      SELECT family, CASE WHEN family % 2 = 0 THEN 'confirmatory' ELSE 'discovery' END AS mode, count(*) AS n_tests, min(p) AS best_p, count(*) FILTER (coalesce("rank" <= lst, false)) AS n_rejected, max(CASE WHEN "rank" = lst THEN p END) AS threshold FROM (
        SELECT *, max(CASE WHEN p <= 0.05::DOUBLE * "rank" / m THEN "rank" END) OVER (PARTITION BY family) AS lst FROM (
          SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS "rank", count(*) OVER (PARTITION BY family) AS m FROM ({_ps}))) GROUP BY 1, 2)""",
)
def run_assessment(spark, sf_dir):
    return statistics.run_assessment(_tests(spark, sf_dir), "p", ("family",), F.when(F.col("family") % 2 == 0, "confirmatory").otherwise("discovery"))


@query(
    "#hid market mode train_end #prior_tests frozen_at",
    "",
    """SELECT n_nationkey AS hid, n_name AS market, 'confirmatory' AS mode, CASE WHEN n_nationkey % 3 = 0 THEN DATE '1996-01-01' ELSE DATE '1999-12-31' END AS train_end,
      CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE n_nationkey + 1 END AS prior_tests, CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '1996-02-01 00:00:00' ELSE TIMESTAMP '2000-01-03 00:00:00' END AS frozen_at FROM nation""",
)
def hypothesis_freeze(spark, sf_dir):
    # every nation stands for a hypothesis; every third is frozen already
    key = F.col("n_nationkey")
    old = lambda x, kind: F.when(key % 3 == 0, F.lit(x).cast(kind))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        key.alias("hid"), F.col("n_name").alias("market"), F.when(key % 3 == 0, "confirmatory").otherwise("discovery").alias("mode"),
        old("1996-01-01", "date").alias("train_end"), old(1, "int").alias("prior_tests"), old("1996-02-01 00:00:00", "timestamp_ntz").alias("frozen_at"),
    )
    return statistics.freeze(rows, "1999-12-31", F.col("hid") + 1, F.lit("2000-01-03 00:00:00").cast("timestamp_ntz"))


# -- more on events, quality and the chart -------------------------------------------


@query("market cond event report_date", sql.conditions(), f"SELECT market, cond, event, report_date FROM ({_dated}) WHERE x AND y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market, cond, event ORDER BY report_date DESC) <= 40")
def condition_dates(spark, sf_dir):
    return events.condition_dates(all_states(spark, sf_dir))


@query(
    "market " + " ".join(f"~points_{k}" for k in KEYS),
    sql.moves(),
    "SELECT thr.market, " + ", ".join(f"round_even(thr_{k} * middle / 0.01::DOUBLE, 0) AS points_{k}" for k in KEYS) + " FROM thr JOIN (SELECT market, median(price_close) AS middle FROM st GROUP BY 1) USING (market)",
)
def threshold_points(spark, sf_dir):
    return events.threshold_points(all_states(spark, sf_dir), 0.01)


@query(
    "market horizon #n ~mean ~median ~p25 ~p75",
    sql.states()
    + f", pth AS (SELECT market, report_date, {FLAG} AS flag, unnest([{', '.join(map(str, _h))}]) AS horizon, unnest([{', '.join(_ret[h] for h in _h)}]) AS r FROM st WINDOW w AS (PARTITION BY market ORDER BY report_date))",
    "SELECT market, horizon, count(r) AS n, avg(r) AS mean, median(r) AS median, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.75) AS p75 FROM pth WHERE flag GROUP BY 1, 2",
)
def event_study_weeks(spark, sf_dir):
    return events.event_study(all_states(spark, sf_dir), _flag(), use_episodes=False)


@query(
    "market check #n",
    sql.PANEL,
    """SELECT market, 'identity' AS "check", count(*) AS n FROM (SELECT market, report_date FROM pos GROUP BY 1, 2 HAVING sum("long") <> max(open_interest) OR sum("short") <> max(open_interest)) GROUP BY 1
    UNION ALL SELECT market, 'missing_weeks', count(*) FROM (SELECT market, report_date - lag(report_date) OVER (PARTITION BY market, "role" ORDER BY report_date) AS gap FROM pos) WHERE gap > 7 AND gap < 21 GROUP BY 1
    UNION ALL SELECT market, 'stale', 1 FROM pos GROUP BY 1 HAVING DATE '2001-12-01' - max(report_date) > 14
    UNION ALL SELECT market, 'jumps', count(*) FROM (SELECT *, median(abs(diff - med)) OVER (PARTITION BY market, "role") AS mad FROM (
      SELECT *, median(diff) OVER (PARTITION BY market, "role") AS med, count(*) OVER (PARTITION BY market, "role") AS n FROM (
        SELECT *, open_interest - lag(open_interest) OVER (PARTITION BY market, "role" ORDER BY report_date) AS diff FROM pos WHERE "role" = 'spec') WHERE diff IS NOT NULL) WHERE n >= 10)
      WHERE CASE WHEN mad = 0 THEN diff <> med ELSE abs(0.6745 * (diff - med) / mad) > 3.5 END GROUP BY 1""",
)
def findings(spark, sf_dir):
    return quality.findings(positions(spark, sf_dir).withColumn("availability_date", F.col("report_date")), "2001-12-01")


@query(
    "#n_sources #n_markets any_made_up",
    sql.PANEL,
    """SELECT count(DISTINCT "role") AS n_sources, count(DISTINCT market) AS n_markets, bool_or("role" = 'other') AS any_made_up FROM pos""",
)
def loaded(spark, sf_dir):
    return quality.loaded(positions(spark, sf_dir).withColumn("source", F.when(F.col("role") == "other", "synthetic").otherwise(F.col("role"))))


@query(
    _weeks("known", "sure"),
    sql.states(),
    "SELECT market, report_date, coalesce(d <= DATE '2000-01-01', false) AS known, coalesce(d <= DATE '2000-01-01', false) AND div_slow AS sure FROM (SELECT *, CASE WHEN day(report_date) <> 9 THEN availability_date END AS d FROM st)",
)
def known_at(spark, sf_dir):
    rows = all_states(spark, sf_dir).withColumn("d", F.expr("case when day(report_date) <> 9 then availability_date end"))
    sure = F.when(F.array_contains("divergence_flags", next(iter(states.DIVERGENCES))), "confirmed").otherwise("unknown")
    return rows.select("market", "report_date", guard.known_at(F.col("d"), "2000-01-01").alias("known"), guard.known_at(F.col("d"), "2000-01-01", sure).alias("sure"))


@query("#o_orderkey ~value", "", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS value FROM orders")
def nan_cleaning(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", E.cleaned(value).alias("value"))


_drawn = ("spec", "slow", "other")
_shown_by = {"net": "seen", "pct": "ind_pct", "z": "ind_z", "change": "change"}
CHART_SQL = f"""{sql.metrics()},
see AS (SELECT *, lag(net) OVER w AS seen, lag("long") OVER w AS seen_long FROM bas WINDOW w AS (PARTITION BY market, "role" ORDER BY report_date)),
ind AS (SELECT *, CASE WHEN seen IS NOT NULL AND len(h) > 0 THEN 100.0::DOUBLE * len(list_filter(h, lambda y: y < seen)) / len(h) END AS ind_pct FROM (
  SELECT *, list(seen) FILTER (seen IS NOT NULL) OVER f AS h, (seen - avg(seen) OVER f) / nullif(stddev_samp(seen) OVER f, 0) AS ind_z, seen - lag(seen) OVER w AS change, seen_long - lag(seen_long) OVER w AS long_change,
    CASE WHEN seen > lag(seen) OVER w THEN 1 ELSE 0 END AS u, CASE WHEN seen < lag(seen) OVER w THEN 1 ELSE 0 END AS dn
  FROM see WINDOW w AS (PARTITION BY market, "role" ORDER BY report_date), f AS (PARTITION BY market, "role" ORDER BY report_date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))),
run2 AS (SELECT *, sum(u) OVER (PARTITION BY market, "role", ug ORDER BY report_date) AS up, sum(dn) OVER (PARTITION BY market, "role", dg ORDER BY report_date) AS down FROM (
  SELECT *, sum(1 - u) OVER w AS ug, sum(1 - dn) OVER w AS dg FROM ind WINDOW w AS (PARTITION BY market, "role" ORDER BY report_date))),
chw AS (SELECT market, report_date, {", ".join(f"max({c}) FILTER (\"role\" = '{r}') AS {m}_{r}" for m, c in _shown_by.items() for r in _drawn)},
  max(long_change) FILTER ("role" = 'spec') AS long_change, max(up) FILTER ("role" = 'spec') AS up, max(down) FILTER ("role" = 'spec') AS down FROM run2 GROUP BY 1, 2),
cht AS (SELECT *, coalesce(pct_spec <= 10, false) AS is_low, coalesce(pct_spec >= 90, false) AS is_high, coalesce(pct_spec <= 20 AND up >= 2, false) AS is_turn_up, coalesce(pct_spec >= 80 AND down >= 2, false) AS is_turn_down,
  coalesce((net_spec - lag(net_spec, 4) OVER w) * (net_slow - lag(net_slow, 4) OVER w) < 0, false) AS is_apart, coalesce(change_spec > 0 AND abs(long_change) < abs(change_spec) / 3, false) AS mark_covering
  FROM chw WINDOW w AS (PARTITION BY market ORDER BY report_date))"""
_marked = ("low", "high", "turn_up", "turn_down", "apart")


@query(
    _weeks(*[f"mark_{k}" for k in _marked], "mark_covering"),
    CHART_SQL,
    "SELECT market, report_date, mark_covering, " + ", ".join(f"is_{k} AND NOT coalesce(lag(is_{k}) OVER w, false) AS mark_{k}" for k in _marked) + " FROM cht WINDOW w AS (PARTITION BY market ORDER BY report_date)",
)
def chart_marks(spark, sf_dir):
    return metrics.chart(metrics.basic(positions(spark, sf_dir)))


@query(_weeks("mode", "~spec", "~slow", "~other"), CHART_SQL, " UNION ALL ".join(f"SELECT market, report_date, '{m}' AS mode, {', '.join(f'{m}_{r} AS {r}' for r in _drawn)} FROM cht" for m in metrics.CHART_MODES))
def chart_modes(spark, sf_dir):
    rows = metrics.chart(metrics.basic(positions(spark, sf_dir)))
    return reduce(DataFrame.unionByName, [metrics.chart_mode(rows, m).withColumn("mode", F.lit(m)) for m in metrics.CHART_MODES])


# -- streams -------------------------------------------------------------------------


@query("#user_id event_type", "", "SELECT DISTINCT user_id, event_type FROM events")
def stream_once_each(spark, sf_dir):
    source, folder = f"{sf_dir}/events.parquet", _scratch(spark)
    # a pattern, as the stream's folder may be a single file
    landed = incremental.read_landing(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(source).schema)
    once = incremental.once_each(landed.select("user_id", "event_type", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "ts", lag="36500 days")
    return incremental.drained(incremental.append_once(once, f"{folder}/out", f"{folder}/state"), f"{folder}/out")


_past = ", ".join(
    f"CASE WHEN count(move_{k}) OVER {f} >= 50 THEN quantile_cont(move_{k}, {q}) OVER {f} END AS past_{k}"
    for k, q, weeks, _ in EVENTS
    for f in [f"(PARTITION BY market ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND {weeks} PRECEDING)"]
)


@query(
    _weeks(*[f"~thr_{k}" for k, *_ in EVENTS], *[f"ev_{k}" for k, *_ in EVENTS]),
    sql.moves(),
    "SELECT market, report_date, " + ", ".join(f"past_{k} AS thr_{k}, move_{k} >= past_{k} AS ev_{k}" for k, *_ in EVENTS) + f" FROM (SELECT *, {_past} FROM mov)",
)
def event_thresholds_past(spark, sf_dir):
    """Beside the thresholds over the whole sample, those that could be known each week."""
    return running.event_thresholds(all_states(spark, sf_dir))


_before = "OVER (PARTITION BY market ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_tops = {"flow_spike_up": "spec_chg_1w", "flow_spike_down": "(-spec_chg_1w)", "oi_surge": "spec_oi_chg_1w"}


@query(
    _weeks(*[f"c_{k}" for k in _tops]),
    sql.states(),
    "SELECT market, report_date, " + ", ".join(f"CASE WHEN count({x}) {_before} >= 50 THEN {x} >= quantile_cont({x}, 0.85) {_before} END AS c_{k}" for k, x in _tops.items()) + " FROM st",
)
def conditions_past(spark, sf_dir):
    return running.top_conditions(all_states(spark, sf_dir))


@query(
    "market start end #weeks",
    sql.states(),
    """SELECT market, min(report_date)::TIMESTAMP AS start, max(report_date)::TIMESTAMP + INTERVAL 8 DAY AS "end", count(*) AS weeks FROM (
      SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY market ORDER BY report_date) AS nth FROM (
        SELECT *, report_date - lag(report_date) OVER (PARTITION BY market ORDER BY report_date) AS gap FROM st WHERE coalesce(spec_pct_52w >= 80, false))) GROUP BY market, nth""",
)
def extreme_sessions(spark, sf_dir):
    """Episodes of high weeks as session windows, as a stream has them once its watermark has passed."""
    rows = all_states(spark, sf_dir).select("market", F.col("report_date").cast("timestamp").alias("at"), F.coalesce(F.col("spec_pct_52w") >= 80, F.lit(False)).alias("flag"))
    return incremental.flag_sessions(rows, "at")


_no_asia = sql.states().replace("FROM li GROUP BY 1, 2)", "FROM li WHERE market <> 'ASIA' GROUP BY 1, 2)")
assert _no_asia != sql.states()


@query(_weeks("regime", "~price_close", "~fwd_return_8w", "#n_flags"), _no_asia, "SELECT *, div_slow::INT + div_price::INT AS n_flags FROM st")
def states_without_prices(spark, sf_dir):
    """A market that no price source has keeps its weeks and regimes; what rests on prices is NULL."""
    some = prices(spark, sf_dir).where("market <> 'ASIA'")
    return states.market_states(positions(spark, sf_dir), some, AS_OF, panel.INVERSE).withColumn("n_flags", F.size("divergence_flags"))


@query("market role report_date ~long ~short ~open_interest", sql.PANEL, 'SELECT * FROM pos')
def participant_roles(spark, sf_dir):
    """Participants of both report families as roles; each week is there from two sources, of which the first counts."""
    rows = positions(spark, sf_dir)
    names = {report: {role: p for p, role in found.items()} for report, found in ROLES.items()}
    named = lambda report: F.element_at(F.create_map(*[F.lit(x) for pair in names[report].items() for x in pair]), F.col("role"))
    rows = rows.withColumn("participant", F.when(F.col("market").isin(*panel.INVERSE), named("disaggregated")).otherwise(named("financial")))
    twice = rows.withColumn("source", F.lit("b")).withColumn("long", F.col("long") + 1).unionByName(rows.withColumn("source", F.lit("a")))
    return panel.roles_of(twice.drop("role"))


def _landed(rows: DataFrame, path: str, parts: int) -> None:
    """Rows in files in order of ``landed`` (a date), so that a stream reads them one after the other."""
    first, last = rows.agg(F.min("landed"), F.max("landed")).first()
    step = ((last - first).days + 1) / parts
    for part in range(parts):
        rows.where(F.floor(F.datediff("landed", F.lit(first)) / step) == part).drop("landed").coalesce(1).write.mode("append").parquet(path)


@query(
    _weeks("availability_date", "date", "~close"),
    sql.states(),
    "SELECT a.market, a.report_date, a.availability_date, p.date, p.close FROM avl a JOIN pr p ON a.market = p.market AND p.date BETWEEN a.availability_date AND a.availability_date + 3",
)
def stream_priced_reports(spark, sf_dir):
    """Reports and prices land in three files each, those of one quarter 70 days late; two streams are joined."""
    folder = _scratch(spark)
    weeks = calendar.with_availability(positions(spark, sf_dir).select("market", "report_date").distinct()).select("market", "report_date", "availability_date")
    closes = prices(spark, sf_dir)
    if weeks.isEmpty():
        return weeks.join(closes, "market").select("market", "report_date", "availability_date", "date", "close")
    held = (F.year("report_date") == 1998) & (F.quarter("report_date") == 2)
    _landed(weeks.withColumn("landed", F.date_add("report_date", F.when(held, 70).otherwise(3))), f"{folder}/reports", 3)
    _landed(closes.withColumn("landed", F.col("date")), f"{folder}/prices", 3)
    read = lambda name, rows: incremental.read_landing(spark, f"{folder}/{name}", rows.schema, files_per_batch=1)
    joined = incremental.priced_reports(read("reports", weeks), read("prices", closes))
    return incremental.drained(incremental.append_once(joined, f"{folder}/out", f"{folder}/state"), f"{folder}/out")


@query("market role report_date #streak_up_weeks #streak_down_weeks", sql.metrics(), "SELECT * FROM met")
def stream_streaks(spark, sf_dir):
    """The panel's weeks land in four files, up to five weeks late each; a stateful stream counts them."""
    folder = _scratch(spark)
    weeks = metrics.basic(positions(spark, sf_dir)).select("market", "role", "report_date", "net")
    late = 7 * F.pmod(F.xxhash64("market", "role", "report_date"), F.lit(6))
    weeks = weeks.withColumn("landed", F.date_add("report_date", late.cast("int")))
    if weeks.isEmpty():
        return metrics.streaks(metrics.basic(positions(spark, sf_dir)))
    _landed(weeks, f"{folder}/in", 4)
    rows = incremental.read_landing(spark, f"{folder}/in", weeks.drop("landed").schema, files_per_batch=1)
    with stateful.rocksdb(spark):
        stateful.write_versions(stateful.streak_changes(rows), f"{folder}/out", f"{folder}/state").awaitTermination()
    return stateful.last_versions(spark.read.parquet(f"{folder}/out"))

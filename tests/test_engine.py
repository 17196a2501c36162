"""Hand-computed cases of the engine."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import config, reports
from tidemark.functions import calendar, guard
from tidemark.functions import expressions as E
from tidemark.functions.conditions import UnsafeConditionError, condition
from tidemark.operators import analogs, asof, backtest, events, metrics, outcomes, panel, quality, states, statistics

START = date(2024, 1, 2)


def weekly(spark, values, column="net", market="M", role="spec"):
    rows = [(market, role, START + timedelta(weeks=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"market string, role string, report_date date, {column} double")


def column(df, name):
    return [r[name] for r in df.orderBy("market", "report_date").collect()]


def test_basic_metrics_and_zero_interest(spark):
    rows = spark.createDataFrame([(100.0, 40.0, 200.0), (5.0, 3.0, 0.0)], "long double, short double, open_interest double")
    a, b = metrics.basic(rows).collect()
    assert (a.net, a.net_oi, a.long_oi, a.short_oi) == (60, 0.3, 0.5, 0.2) and b.net == 2 and b.net_oi is None


def test_changes(spark):
    w = E.market_weeks("market", "role")
    rows = weekly(spark, [10, 12, 15, 11, 20]).withColumn("c", E.change(F.col("net"), 1, w)).withColumn("d", E.change(F.col("net"), 4, w))
    assert column(rows, "c") == [None, 2, 3, -4, 9] and column(rows, "d") == [None] * 4 + [10]


def test_streaks_reset_on_flat(spark):
    rows = metrics.streaks(weekly(spark, [10, 12, 15, 11, 9, 9, 20]))
    assert column(rows, "streak_up_weeks") == [0, 1, 2, 0, 0, 0, 1] and column(rows, "streak_down_weeks") == [0, 0, 0, 1, 2, 0, 0]


def test_percentile_excludes_the_current_row(spark):
    w = E.market_weeks("market", "role")
    p = lambda values, k: column(weekly(spark, values).withColumn("p", E.percentile_of_history(F.col("net"), k, w)), "p")
    assert p([1, 2, 3, 10], 3) == [None, None, None, 100]
    assert p([1, 2, 3, 2], 3)[-1] == 50
    assert p([1, None, 3, 2, 4, 5, None], 3) == [None] * 5 + [100, None]
    assert p([0] * 52 + [999], 52)[-1] == 100


def test_zscore_and_rank(spark):
    w = E.market_weeks("market", "role")
    z = lambda values, k: column(weekly(spark, values).withColumn("z", E.zscore_of_history(F.col("net"), k, w)), "z")
    assert z([1, 2, 3, 100], 3)[-1] == 98 and z([5, 5, 5, 5, 9], 4)[-1] is None
    rows = weekly(spark, [1, 5, 3, 4]).withColumn("r", E.rank_in_history(F.col("net"), 3, w))
    assert column(rows, "r") == [None, None, None, 2]


def test_regimes(spark):
    schema = "spec_pct_52w double, spec_streak_up_weeks double, spec_chg_4w double, slow_chg_4w double, spec_streak_down_weeks double"
    cases = [((4, 3, 10, 1, 0), "Bullish Reversal"), ((96, 0, -5, -1, 2), "Bearish Reversal"), ((96, 0, 1, 1, 0), "Extreme Long"), ((4, 0, 1, 1, 0), "Extreme Short"), ((50, 4, 1, 1, 0), "Accumulation"),
             ((50, 0, 1, 1, 4), "Distribution"), ((61, 0, 1, 1, 0), "Bullish Positioning"), ((40, 0, 1, 1, 0), "Bearish Positioning"), ((50, 0, 1, 1, 0), "Neutral"), ((None, 0, 1, 1, 0), "Neutral")]
    rows = spark.createDataFrame([tuple(None if x is None else float(x) for x in c) for c, _ in cases], schema)
    got = states.classified(rows).collect()
    assert [r.regime for r in got] == [name for _, name in cases]
    assert got[2].regime_reasons == ["spec_pct_52w >= 95 (actual: 96.0)"] and got[8].regime_reasons == ["No rule met."]
    assert states.classified(rows.select("slow_chg_4w")).first().regime == "Neutral"
    assert states.classified(rows, rules=config.REGIMES[:1]).collect()[8].regime == "Unclassified"


def test_divergence(spark):
    rows = spark.createDataFrame([("M", START + timedelta(weeks=i), a, b) for i, (a, b) in enumerate([(0.0, 0.0)] * 4 + [(100.0, -40.0)])], "market string, report_date date, slow_net double, spec_net double")
    got = metrics.divergence_events(rows, [("k", "slow_net", "spec_net")]).collect()
    assert len(got) == 1 and got[0].magnitude == 40
    assert metrics.divergence_events(rows, [("k", "slow_net", "spec_net")], floor=50).count() == 0


def daily(spark, closes, start=START, market="M", step=1):
    return spark.createDataFrame([(market, start + timedelta(days=step * i), float(c)) for i, c in enumerate(closes)], "market string, date date, close double")


def test_asof_both_ways(spark):
    prices = spark.createDataFrame([("M", date(2024, 1, 3), 1.0), ("M", date(2024, 1, 9), 2.0)], "market string, date date, close double")
    rows = weekly(spark, [0, 0, 0])
    rows = asof.backward(asof.forward(rows, prices, "report_date", "after"), prices, "report_date", "before")
    assert column(rows, "after") == [1, 2, None] and column(rows, "before") == [None, 2, 2]
    near = asof.forward(weekly(spark, [0]), prices, "report_date", "x", tolerance_days=0)
    assert column(near, "x") == [None]


def test_forward_returns(spark):
    prices = daily(spark, range(100, 120), step=7)
    rows = weekly(spark, [0, 0]).select("market", "report_date", F.col("report_date").alias("availability_date"))
    got = asof.forward_returns(rows, prices, (4, 26), date(2024, 2, 1)).orderBy("report_date").collect()
    assert got[0].fwd_return_4w == pytest.approx(0.04) and got[0].fwd_return_26w is None and got[1].fwd_return_4w is None
    turned = asof.forward_returns(rows, prices, (4,), date(2024, 2, 1), inverse=("M",)).orderBy("report_date").first()
    assert turned.fwd_return_4w == pytest.approx(-0.04)


def test_excursions(spark):
    closes = [100, 101, 103, 105, 104, 102, 100, 99, 98, 99, 100, 101, 101, 101, 101]
    rows = weekly(spark, [0]).withColumn("availability_date", F.col("report_date"))
    got = asof.excursions(rows, daily(spark, closes), 2).first()
    assert got.mfe == pytest.approx(0.05) and got.mae == pytest.approx(-0.02) and got.n_prices == 15


def test_availability_dates(spark):
    cases = [("2018-03-06", "2018-03-09"), ("2025-07-01", "2025-07-05"), ("2025-10-07", "2025-10-10"), ("2026-08-18", "2026-08-21"), ("2025-12-30", "2026-01-05"), ("2026-06-16", "2026-06-22"), ("2023-11-21", "2023-11-24")]
    rows = spark.createDataFrame([(a,) for a, _ in cases], "d string").select(F.to_date("d").alias("report_date"))
    got = {str(r.report_date): r for r in calendar.with_availability(rows).collect()}
    assert {a: str(r.availability_date) for a, r in got.items()} == dict(cases)
    assert got["2025-10-07"].availability_warning and not got["2025-12-30"].availability_warning
    assert len(calendar.published()) == 52


def test_guard(spark):
    rows = spark.createDataFrame([("2026-08-01",), ("2500-06-15",), (None,)], "availability_date string")
    with pytest.raises(guard.LookaheadError):
        guard.assert_available(rows, "2026-08-21")
    with pytest.raises(guard.LookaheadError):
        guard.assert_available(rows.limit(1).unionByName(rows.filter("availability_date is null")), "2026-08-21")
    assert guard.assert_available(rows.limit(1), "2026-08-21").count() == 1
    assert guard.assert_available(rows.drop("availability_date"), "2026-08-21") is not None
    assert guard.available(rows.select(F.to_date("availability_date").alias("availability_date")), "2026-08-21").count() == 1
    with pytest.raises(guard.LookaheadError):
        guard.assert_not_outcomes(["spec_net_oi", "fwd_return_8w"])
    with pytest.raises(Exception, match="not public"):
        guard.checked(rows.select(F.to_date("availability_date").alias("availability_date")), "2026-08-21").count()


def test_conditions(spark):
    rows = spark.createDataFrame([(5, 1.0), (50, -1.0), (None, 2.0)], "pct int, chg double")
    n = lambda text: rows.filter(condition(text, rows.columns)).count()
    assert n("pct < 10 and chg > 0") == 1 and n("1 < pct <= 50") == 2 and n("pct in [5, 7]") == 1 and n("~(pct < 10)") == 2
    assert n("(pct > 10) | (chg > 1.5)") == 2 and n("abs(chg) >= 1 and not pct > 10") == 2 and n("-chg > 0") == 1 and n("pct / 0 > 1") == 0
    for bad in ("__import__('x')", "pct.mean() > 1 or exec", "lambda: 1"):
        with pytest.raises(UnsafeConditionError):
            condition(bad, rows.columns)
    for bad in ("nope > 1", "pct.mean() > 1", "pct >", "[1]"):
        with pytest.raises(ValueError):
            condition(bad, rows.columns)


def test_outcomes(spark):
    rows = spark.createDataFrame([("a", r) for r in (0.01, 0.02, -0.01, 0.03, None)], "k string, r double")
    got = outcomes.outcomes(rows, ("k",), "r").first()
    assert got.n == 4 and got.win_rate == 0.75 and got.median_return == pytest.approx(0.015) and got.quality == "insufficient"


def test_episodes(spark):
    flags = lambda v: spark.createDataFrame([("M", START + timedelta(weeks=i), x) for i, x in enumerate(v)], "market string, report_date date, flag boolean")
    got = events.episodes(flags([False, True, True, True, False, False, True, False]), F.col("flag")).orderBy("episode").collect()
    assert [r.weeks for r in got] == [3, 1]
    assert events.episodes(flags([True, False, True, False, False, False]), F.col("flag")).count() == 2
    one = events.episodes(flags([True, False, True, None, False, False]), F.col("flag"), gap=1).collect()
    assert len(one) == 1 and one[0].weeks == 3


def test_event_study_signs(spark):
    def study(prices, at, horizons):
        rows = weekly(spark, prices, "price_close").withColumn("hit", F.col("report_date") == F.lit(START + timedelta(weeks=at)))
        return {r.horizon: r["mean"] for r in events.event_study(rows, F.col("hit"), horizons).collect()}

    assert study([100, 100, 100, 100, 110], 4, (-4, 0))[-4] == pytest.approx(-0.10)
    got = study([100, 105, 110, 115, 120], 0, (0, 2, 8))
    assert got[2] == pytest.approx(0.10) and got[0] == 0 and got[8] is None


def test_forward_move_tail(spark):
    rows = weekly(spark, [100, 90, 120, 110], "price_close").withColumn("up", events.forward_move(F.col("price_close"), 2, "up")).withColumn("full", events.forward_move(F.col("price_close"), 2, "up", True))
    assert column(rows, "up") == pytest.approx([0.2, 120 / 90 - 1, 110 / 120 - 1, None]) and column(rows, "full")[2] is None


def test_conditions_of_events(spark):
    rows = spark.createDataFrame(
        [("M", START + timedelta(weeks=i), n, 2900.0 if i == 1 else None, c1, 10.0, 1.0, 1.0, 1.0, 1.0, 15.0, 2.0, 0.0) for i, (n, c1) in enumerate([(-500.0, None), (-100.0, 3000.0), (200.0, 300.0), (400.0, 200.0)])],
        "market string, report_date date, spec_net double, spec_long_chg_1w double, spec_chg_1w double, spec_chg_4w double, slow_chg_1w double, slow_chg_4w double, spec_oi_chg_1w double, x double, spec_pct_52w double, spec_streak_up_weeks double, spec_streak_down_weeks double",
    )
    got = events.with_conditions(rows)
    assert column(got, "c_net_flip_up") == [None, False, True, False] and column(got, "c_short_squeeze") == [None, False, None, None]
    assert column(got, "c_turn_from_low") == [True] * 4 and column(got, "c_flow_spike_up") == [None] * 4


def trades(spark, returns):
    return spark.createDataFrame([("M", START + timedelta(weeks=i), r) for i, r in enumerate(returns)], "market string, report_date date, trade_return double")


def test_performance(spark):
    p = backtest.performance(trades(spark, [0.02, -0.01, 0.03, -0.02, 0.0, None]), 4).first()
    assert p.n_trades == 5 and p.win_rate == 0.4 and p.avg_loss == pytest.approx(-0.01) and p.profit_factor == pytest.approx(0.05 / 0.03) and p.max_drawdown < 0
    all_won = backtest.performance(trades(spark, [0.01, 0.02]), 4).first()
    assert all_won.profit_factor is None and all_won.no_losses and all_won.calmar is None
    assert backtest.performance(trades(spark, []), 4).count() == 0


def test_folds(spark):
    got = backtest.folds(trades(spark, [0.02] * 30 + [-0.01] * 10)).orderBy("fold").collect()
    assert [r.n for r in got] == [10] * 4 and got[0].fades
    assert backtest.folds(trades(spark, [0.01] * 5)).count() == 0


def test_backtest_arguments(spark):
    rows = spark.createDataFrame([("M", START, 5.0, 0.1), ("M", START + timedelta(weeks=1), 5.0, None)], "market string, report_date date, p double, fwd_return_4w double")
    got = backtest.signals(rows, "p < 10", 4, "short_currency", cost_bps=10)
    assert column(got, "trade_return") == [pytest.approx(-0.101), None] and tuple(backtest.counts(got).first())[1:] == (2, 1, 1)
    with pytest.raises(ValueError):
        backtest.signals(rows, "p < 10", 4, "auto")
    with pytest.raises(KeyError):
        backtest.signals(rows, "p < 10", 8)


def test_binomial():
    assert statistics.binomial_two_sided(5, 10, 0.5) == pytest.approx(1.0)
    assert statistics.binomial_two_sided(9, 10, 0.5) == pytest.approx(22 / 1024)
    assert statistics.binomial_two_sided(0, 0, 0.5) is None
    assert statistics.binomial_two_sided(3, 10, 0.0) == 0.0


def test_benjamini_hochberg(spark):
    tests = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.0005, 0.002] + [0.6] * 50 + [None, float("nan")])], "id int, p double")
    got = statistics.benjamini_hochberg(tests, "p").collect()
    assert len(got) == 53 and {r.id for r in got if r.rejected} == {0, 1, 2} and got[0].threshold == 0.002


def test_bootstrap_blocks_are_wider(spark):
    values, x = [], 0.0
    for i in range(240):
        x = 0.9 * x + math.sin(i * 12.9898) * 0.01
        values.append(x)
    rows = weekly(spark, values, "r")
    one = statistics.bootstrap(rows, ("market",), "r", ("report_date",), draws=200).first()
    many = statistics.bootstrap(rows, ("market",), "r", ("report_date",), block=8, draws=200).first()
    assert many.mean_hi - many.mean_lo > 0.95 * (one.mean_hi - one.mean_lo)
    assert statistics.bootstrap(weekly(spark, [1.0] * 9, "r"), ("market",), "r", ("report_date",), draws=10).count() == 0


def test_analogs(spark):
    rows = [("M", START + timedelta(weeks=i), START + timedelta(weeks=i, days=3), float(i % 7), float((i * 3) % 11), 0.01 * i) for i in range(60)]
    pool = spark.createDataFrame(rows, "market string, report_date date, availability_date date, a double, b double, fwd_return_4w double")
    query = pool.orderBy(F.desc("report_date")).limit(1)
    got = analogs.search(query, pool, {"a": 1.0, "b": 0.5}, k=10).orderBy("place").collect()
    assert len(got) == 10 and [r.distance for r in got] == sorted(r.distance for r in got) and [r.similarity for r in got] == sorted((r.similarity for r in got), reverse=True)
    assert all(r.availability_date <= rows[-1][2] and r.report_date < rows[-1][1] for r in got)
    assert analogs.search(query, pool.withColumn("b", F.lit(1.0)), {"a": 1.0, "b": 0.5}).count() == 0
    with pytest.raises(guard.LookaheadError):
        analogs.search(query, pool, {"fwd_return_4w": 1.0})


def test_quality(spark):
    jump = weekly(spark, list(range(1000, 1030)) + [50000], "open_interest")
    assert quality.jumps(jump).count() == 1
    gap = weekly(spark, range(5)).filter(F.col("report_date") != F.lit(START + timedelta(weeks=2)))
    assert [r.gap_days for r in quality.missing_weeks(gap).collect()] == [14]
    two = weekly(spark, [1]).unionByName(weekly(spark, [1]))
    assert quality.duplicates(two, ("market", "role", "report_date")).count() == 2
    with pytest.raises(ValueError):
        states.assert_unique(two)
    parts = spark.createDataFrame([("M", START, 60.0, 40.0, 100.0), ("M", START, 40.0, 60.0, 100.0), ("N", START, 60.0, 40.0, 100.0)], "market string, report_date date, long double, short double, open_interest double")
    assert [r.market for r in quality.accounting_identity(parts).collect()] == ["N"]


def test_registry():
    assert len(config.MARKETS) == 22 and {m.code for m in config.MARKETS.values() if m.inverse} == {"JPY", "CAD", "CHF", "MXN"}
    assert config.participant_for("GOLD", "spec") == "managed_money" and config.participant_for("EUR", "slow") == "asset_manager"
    assert config.slow_is_contrarian("GOLD") and len(config.codes_for_report("disaggregated")) == 4
    with pytest.raises(KeyError):
        config.market("NONE")


def test_labels(spark):
    c = F.col
    got = spark.createDataFrame([(3.0, 0.0, 0.0, 0.0, 5.0, -4.0), (None, 4.0, 0.0, 1.0, 0.0, 0.0), (9.0, 2.0, 0.0, 1.0, 10.0, 1.0)], "p double, u double, d double, ch double, l double, s double")
    rows = got.select(E.badge(c("p"), c("u"), c("d"), c("ch")).alias("b"), E.level_label(c("p")).alias("lv"), E.flow_code(c("l"), c("s")).alias("f")).collect()
    assert [tuple(r) for r in rows] == [("extreme", "extreme_low", "two_sided"), ("accumulation", None, "no_move"), ("reversal", "low", "longs_added")]


def test_reports():
    outcome = {4: {"n": 60, "win_rate": 0.61, "median_return": 0.0123, "base_win_rate": 0.5, "win_diff_pp": 11.0}, 8: {"n": 3}}
    row = {"regime": "Extreme Long", "regime_reasons": ["spec_pct_52w >= 95 (actual: 96.0)"], "spec_chg_1w": 120.0, "spec_pct_52w": 96.0, "flow": "longs_added", "config": "mixed"}
    text = reports.analysis("EUR", row, outcome, "noise")
    assert "too few" in text and "96th" in text and "61.0%" in text
    reports.assert_no_new_numbers(text, [row, outcome])
    with pytest.raises(ValueError):
        reports.assert_no_new_numbers(text + " It will rise 42.7%.", [row, outcome])
    page = reports.html_page("T", reports.markdown("T <x>", [("Facts", ["a & b"])], [{"k": 1}]))
    assert "&lt;x&gt;" in page and "<li>a &amp; b</li>" in page
    assert "</script>" not in reports.site("T", {"x": "</script>"}).split("const DATA")[1].split(";</script>")[0]
    with pytest.raises(NotImplementedError):
        reports.polish("x")


def test_residual_role(spark):
    rows = spark.createDataFrame([("M", "spec", START, 60.0, 30.0, 100.0), ("M", "slow", START, 50.0, 30.0, 100.0)], "market string, role string, report_date date, long double, short double, open_interest double")
    r = panel.with_residual(rows).filter("role = 'residual'").first()
    assert (r.long, r.short) == (0.0, 40.0)


def test_registered_resampling_draws_as_often_as_the_settings_say():
    import inspect

    from tidemark.config import BOOTSTRAP_DRAWS
    from tidemark.plans import dossier, queries

    assert queries.DRAWS == BOOTSTRAP_DRAWS == 2000
    assert inspect.signature(dossier.dossier).parameters["draws"].default == BOOTSTRAP_DRAWS
    for name in ("bootstrap", "block_bootstrap", "permutation_test", "edge_evidence"):
        assert f"generate_series(0, {BOOTSTRAP_DRAWS - 1})" in queries.ORACLES[name]


def test_precursors_cover_every_event(spark):
    from tidemark.config import EVENTS
    from tidemark.plans.queries import QUERIES

    for name in ("precursor_metrics", "precursor_conditions"):
        got = QUERIES[name](spark, "/root/testdata/sf0.01")
        assert {r.event for r in got.select("event").distinct().collect()} == {k for k, *_ in EVENTS}


def test_condition_lists_hold_any_expression(spark):
    rows = spark.createDataFrame([(-1, 2), (2, 5), (0, 0), (None, 1)], "x int, y int")
    found = lambda text: [r.x for r in rows.filter(condition(text, rows.columns)).collect()]
    assert found("x in [-1, 2]") == [-1, 2] and found("x in (y, 2)") == [2, 0] and found("x in []") == []
    assert found("x not in [-1]") == [2, 0, None] and found("x in [y - 3]") == [-1, 2]
    with pytest.raises(ValueError):
        condition("x in [z]", rows.columns)


def test_matured_analogs_are_the_first_with_an_outcome(spark):
    from tidemark.plans import dossier

    rows = [("M", START + timedelta(weeks=k), float(100 - k), k, None if k < 4 else 0.01 * k) for k in range(1, 12)]
    found = spark.createDataFrame(rows, "market string, report_date date, similarity double, place int, fwd_return_8w double")
    assert [r.fwd_return_8w for r in dossier.matured(found).collect()] == pytest.approx([0.04, 0.05, 0.06, 0.07, 0.08])


def test_a_repeated_role_fails_the_states(spark):
    rows = weekly(spark, [1.0, 2.0])
    with pytest.raises(Exception, match="repeated market"):
        states.wide(rows.union(rows.limit(1)), columns=("net",)).collect()


def test_extremity_and_momentum(spark):
    rows = spark.createDataFrame([(5.0, 0.0, 0.0, 1.0), (20.0, 2.0, 0.0, -1.0), (80.0, 0.0, 3.0, 1.0), (95.0, 1.0, 1.0, 0.0), (50.0, None, None, None), (30.0, 0.0, 0.0, -2.0), (None, 0.0, 0.0, 5.0)], "p double, u double, d double, c double")
    got = rows.select(E.extremity(F.col("p")).alias("e"), E.momentum(F.col("u"), F.col("d"), F.col("c")).alias("m")).collect()
    assert [r.e for r in got] == ["extreme_low", "near_low", "near_high", "extreme_high", "middle", "usual", None]
    assert [r.m for r in got] == ["month_up", "streak_up", "streak_down", "flat", "unknown", "month_down", "month_up"]


def test_assessment_is_gated(spark):
    rows = [("few", START + timedelta(weeks=i), 0.01 * (i % 3), i < 10) for i in range(60)] + [("many", START + timedelta(weeks=i), 0.01 * (i % 5) - 0.02, i < 30) for i in range(90)]
    table = spark.createDataFrame(rows, "market string, report_date date, r double, t boolean")
    got = {r.market: r for r in statistics.assess(table, ("market",), "r", ("report_date",), F.col("t"), tests=25, draws=200).collect()}
    few, many = got["few"], got["many"]
    assert few.n == 10 and not few.sufficient and few.permutation_p is None and few.median_lo is None and not few.many_tests
    assert many.sufficient and many.many_tests and many.quality == "moderate" and many.cohens_d == pytest.approx(0) and many.binomial_p == pytest.approx(1)
    assert many.median_lo <= 0 <= many.median_hi and many.permutation_p > 0.5


def test_run_assessment_and_freeze(spark):
    rows = [("a", i, p) for i, p in enumerate([1e-5] * 3 + [0.6] * 50)] + [("b", 0, 0.2), ("c", 0, None)]
    got = {r.family: r for r in statistics.run_assessment(spark.createDataFrame(rows, "family string, id int, p double"), "p", ("family",), F.when(F.col("family") == "a", "confirmatory").otherwise("discovery")).collect()}
    assert got["a"].n_rejected == 3 and got["a"].many_tests and got["a"].confirmed and not got["a"].fails_bonferroni and got["a"].expected_false == pytest.approx(2.65)
    assert got["b"].expected_false is None and not got["b"].confirmed and got["c"].best_p is None and got["c"].n_rejected == 0
    open_ = spark.createDataFrame([("h", "discovery", None, None, None)], "hid string, mode string, train_end date, prior_tests int, frozen_at timestamp")
    once = statistics.freeze(open_, "2020-01-01", F.lit(7))
    again = statistics.freeze(once, "2024-01-01", F.lit(99)).first()
    assert again.mode == "confirmatory" and str(again.train_end) == "2020-01-01" and again.prior_tests == 7


def test_chart_marks_are_first_weeks(spark):
    spec = [0, 5, 4, 3, 2, 1, 0, -1, -2, -3, -4, -5, -6, 2, 3, 4]
    rows = [("M", r, START + timedelta(weeks=i), float(max(v, 0)), float(max(-v, 0)), 100.0) for r, k in (("spec", 1), ("slow", -1), ("other", 0)) for i, v in enumerate(k * x for x in spec)]
    table = metrics.basic(spark.createDataFrame(rows, "market string, role string, report_date date, long double, short double, open_interest double"))
    got = metrics.chart(table).orderBy("report_date").collect()
    low = [r.is_low for r in got]
    assert [r.mark_low for r in got] == [x and not (k and low[k - 1]) for k, x in enumerate(low)] and sum(r.mark_low for r in got) == 1
    assert got[14].is_turn_down is False and any(r.mark_apart for r in got) and got[14].mark_covering  # -6 to 2: mostly shorts closed
    drawn = metrics.chart_mode(metrics.chart(table), "change").orderBy("report_date").collect()
    assert drawn[14].spec == 8 and drawn[14].slow == -8
    with pytest.raises(ValueError):
        metrics.chart_mode(metrics.chart(table), "price")


def test_known_at_never_passes_the_unknown(spark):
    rows = spark.createDataFrame([("2020-01-01", "confirmed"), ("2020-01-01", "UNKNOWN"), ("2020-01-01", None), ("2030-01-01", "confirmed"), (None, "confirmed")], "d string, c string").select(F.to_date("d").alias("d"), "c")
    assert [r[0] for r in rows.select(guard.known_at(F.col("d"), "2021-01-01", F.col("c"))).collect()] == [True, False, False, False, False]


def test_divergences_in_words(spark):
    rows = spark.createDataFrame([(["Leveraged Funds vs Price", "other"],), ([],)], "f array<string>")
    got = [r[0] for r in rows.select(states.divergence_words(F.col("f"))).collect()]
    assert got == [[states.DIVERGENCES["Leveraged Funds vs Price"], "other"], []]


def test_interpretation_has_five_sections():
    row = {"spec_pct_52w": 4.0, "spec_net_oi": -0.2, "spec_chg_4w": 10.0, "momentum": "streak_up", "spec_streak_up_weeks": 3, "price_chg_4w": -0.01, "spec_net_rank_156w": 3.0, "spec_oi_pct_52w": 90.0, "contradictions": ["apart"]}
    got = reports.interpretation(row, {"n": 12})
    assert list(got) == ["Seen", "Says", "Doesn't say", "History", "Against"]
    assert "sellers" in got["Says"][0] and "turn" in got["Says"][1] and "too few" in got["History"][0] and got["Against"][0] == "apart"
    seen = " ".join(got["Seen"])
    assert "against the price" in seen and "3 of the last 156" in seen and "unusually busy" in seen and "3 weeks up" in seen
    calm = reports.interpretation({"spec_pct_52w": 50.0, "spec_net_oi": 0.1})
    assert len(calm["Says"]) == 1 and len(calm["Doesn't say"]) == 1 and calm["History"] == ["No analogs were looked for."]
    assert reports.market_summary("EUR", "Neutral", {"fast": calm}).startswith("EUR: Neutral.")

"""Large moves, the conditions before them, episodes and event studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONDITIONS, EVENT_HORIZONS, EVENTS, LOOKBACK_WEEKS, MIN_OCCURRENCES, TOP_MOVES
from ..functions import expressions as E

LEAST_VALUES = 50


def forward_move(price: Column, weeks: int, direction: str, require_full: bool = False) -> Column:
    """Largest move in ``direction`` within the next rows; the tail uses what there is unless full horizons are required."""
    ahead = E.market_weeks("market").rowsBetween(1, weeks)
    move = E.ratio(F.max(price).over(ahead), price) - 1 if direction == "up" else 1 - E.ratio(F.min(price).over(ahead), price)
    return F.when(F.count(price).over(ahead) == weeks, move) if require_full else move


def with_moves(rows: DataFrame, events=EVENTS, price: str = "price_close") -> DataFrame:
    return rows.withColumns({f"move_{key}": forward_move(F.col(price), weeks, direction) for key, _, weeks, direction in events})


def thresholds(rows: DataFrame, events=EVENTS) -> DataFrame:
    """Per market the quantile of each event's moves, NULL with fewer than 50; rows from ``with_moves``."""
    cut = lambda key, q: F.when(F.count(f"move_{key}") >= LEAST_VALUES, F.percentile(f"move_{key}", F.lit(q)))
    return rows.groupBy("market").agg(*[cut(key, q).alias(f"thr_{key}") for key, q, _, _ in events])


def with_events(rows: DataFrame, events=EVENTS) -> DataFrame:
    """Adds ev_{key}: did the move reach the threshold; NULL without a move or a threshold."""
    moved = with_moves(rows, events)
    joined = moved.join(thresholds(moved, events), "market")
    return joined.withColumns({f"ev_{key}": F.col(f"move_{key}") >= F.col(f"thr_{key}") for key, *_ in events})


def _top(x: Column, q: float = 0.85) -> Column:
    everything = Window.partitionBy("market")
    return F.when(F.count(x).over(everything) >= LEAST_VALUES, x >= F.percentile(x, F.lit(q)).over(everything))


def with_conditions(rows: DataFrame) -> DataFrame:
    """Adds c_{key} for the nine named conditions; NULL where what they need is NULL."""
    w = E.market_weeks("market")
    net, last = F.col("spec_net"), F.lag("spec_net").over(w)
    one, four, pct = F.col("spec_chg_1w"), F.col("spec_chg_4w"), F.col("spec_pct_52w")
    slow1, slow4, long1 = F.col("slow_chg_1w"), F.col("slow_chg_4w"), F.col("spec_long_chg_1w")
    known = lambda *cols: F.greatest(*[c.isNull().cast("int") for c in cols], F.lit(0)) == 0
    up, down = (F.coalesce(F.col(f"spec_streak_{d}_weeks") >= 2, F.lit(False)) for d in ("up", "down"))
    found = {
        "flow_spike_up": _top(one),
        "flow_spike_down": _top(-one),
        "net_flip_up": F.when(known(net, last), (net > 0) & (last <= 0)),
        "net_flip_down": F.when(known(net, last), (net < 0) & (last >= 0)),
        "turn_from_low": F.when(known(pct), (pct <= 20) & up),
        "turn_from_high": F.when(known(pct), (pct >= 80) & down),
        "short_squeeze": F.when(known(one, long1), (one > 0) & (F.abs(long1) < F.abs(one) / 3)),
        "divergence_closing": F.when(known(one, four, slow1, slow4), (four * slow4 < 0) & (one * slow1 > 0)),
        "oi_surge": _top(F.col("spec_oi_chg_1w")),
    }
    return rows.withColumns({f"c_{k}": v for k, v in found.items()})


def _flags(rows: DataFrame, prefix: str, keys, name: str) -> Column:
    return F.array(*[F.struct(F.lit(k).alias(name), F.col(f"{prefix}{k}").alias(f"{name}_flag")) for k in keys])


def contingency(rows: DataFrame, events=EVENTS, conditions=CONDITIONS) -> DataFrame:
    """Every condition against every event: the four cells, rates, lift and a verdict.

    Conditions and events of a row are crossed inside the row (nine by six); rows
    never meet each other.
    """
    full = with_events(with_conditions(rows), events)
    keys = [e[0] for e in events]
    wide = full.select("market", F.explode(_flags(full, "c_", conditions, "cond")).alias("c"), _flags(full, "ev_", keys, "event").alias("evs"))
    pairs = wide.select("market", "c.cond", "c.cond_flag", F.inline("evs")).filter("cond_flag is not null and event_flag is not null")
    c, e = F.col("cond_flag"), F.col("event_flag")
    counts = pairs.groupBy("market", "cond", "event").agg(F.count_if(c & e).alias("a"), F.count_if(c & ~e).alias("b"), F.count_if(~c & e).alias("c"), F.count_if(~c & ~e).alias("d"))
    n, total = F.col("a") + F.col("b"), F.col("a") + F.col("b") + F.col("c") + F.col("d")
    rated = counts.withColumns(
        {
            "n": n,
            "rate_with": F.try_divide(F.col("a"), n),
            "rate_without": F.try_divide(F.col("c"), F.col("c") + F.col("d")),
            "base_rate": F.try_divide(F.col("a") + F.col("c"), total),
        }
    ).withColumn("lift_pp", (F.col("rate_with") - F.col("base_rate")) * 100)
    call = F.when(F.col("n") < MIN_OCCURRENCES, "few").when(F.col("lift_pp").isNull(), "no_data").when(F.abs("lift_pp") < 5, "noise")
    return rated.withColumn("verdict", call.otherwise(F.when(F.col("lift_pp") > 0, "more_often").otherwise("less_often")))


def condition_dates(rows: DataFrame, events=EVENTS, conditions=CONDITIONS, last: int = 40) -> DataFrame:
    """The last weeks in which a condition held and its event is known: (market, cond, event, report_date)."""
    full = with_events(with_conditions(rows), events)
    held = full.select("market", "report_date", F.explode(_flags(full, "c_", conditions, "cond")).alias("c"), _flags(full, "ev_", [e[0] for e in events], "event").alias("evs")).filter("c.cond_flag")
    known = held.select("market", "report_date", "c.cond", F.inline("evs")).filter("event_flag is not null").drop("event_flag")
    newest = Window.partitionBy("market", "cond", "event").orderBy(F.desc("report_date"))
    return known.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= last).drop("place")


def threshold_points(rows: DataFrame, pip: float, events=EVENTS) -> DataFrame:
    """Thresholds in points of the median price, rounded half to even."""
    moved = with_moves(rows, events)
    middle = rows.groupBy("market").agg(F.median("price_close").alias("middle"))
    joined = thresholds(moved, events).join(middle, "market")
    return joined.select("market", *[F.bround(F.col(f"thr_{k}") * F.col("middle") / pip).alias(f"points_{k}") for k, *_ in events])


PRECURSOR_METRICS = ("spec_chg_1w", "spec_chg_4w", "spec_pct_52w", "slow_chg_4w", "spec_oi_chg_4w")


def _largest(rows: DataFrame, events, top: int) -> DataFrame:
    """The largest moves of each market and event."""
    ranked = Window.partitionBy("market", "event").orderBy(F.desc("move"), "report_date")
    moves = rows.withColumns({f"move_{k}": forward_move(F.col("price_close"), weeks, direction) for k, _, weeks, direction in events})
    cells = [F.struct(F.lit(k).alias("event"), F.col(f"move_{k}").alias("move")) for k, *_ in events]
    moved = moves.select("*", F.inline(F.array(*cells)))
    # a market without a threshold (fewer than 50 moves) has no precursors
    enough = F.count("move").over(Window.partitionBy("market", "event")) >= LEAST_VALUES
    found = moved.withColumn("enough", enough).filter("move is not null and enough")
    return found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= top)


def precursor_metrics(rows: DataFrame, events=EVENTS, weeks_before: int = LOOKBACK_WEEKS, top: int = TOP_MOVES) -> DataFrame:
    """For each event the mean of each metric in the weeks up to the largest moves against its mean always."""
    w = E.market_weeks("market").rowsBetween(-(weeks_before - 1), 0)
    before = rows.withColumns({f"b_{m}": F.avg(m).over(w) for m in PRECURSOR_METRICS})
    always = rows.groupBy("market").agg(*[F.avg(m).alias(f"a_{m}") for m in PRECURSOR_METRICS])
    at = _largest(before, events, top).groupBy("market", "event").agg(F.count(F.lit(1)).alias("n_moves"), *[F.avg(f"b_{m}").alias(f"b_{m}") for m in PRECURSOR_METRICS])
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.col(f"a_{m}").alias("always")) for m in PRECURSOR_METRICS]
    joined = at.filter("n_moves >= 5").join(always, "market").select("market", "event", "n_moves", F.inline(F.array(*cells)))
    return joined.filter("before is not null and always is not null").withColumn("diff", F.col("before") - F.col("always"))


def precursor_conditions(rows: DataFrame, events=EVENTS, weeks_before: int = LOOKBACK_WEEKS, top: int = TOP_MOVES, conditions=CONDITIONS) -> DataFrame:
    """For each event the share of the largest moves with a condition in the weeks before, against its weekly share; the largest
    differences of an event come first."""
    w = E.market_weeks("market").rowsBetween(-(weeks_before - 1), 0)
    flagged = with_conditions(rows)
    flagged = flagged.withColumns({f"h_{c}": F.coalesce(F.max(F.col(f"c_{c}").cast("int")).over(w), F.lit(0)) for c in conditions})
    always = flagged.groupBy("market").agg(*[F.avg(F.col(f"c_{c}").cast("double")).alias(f"a_{c}") for c in conditions])
    at = _largest(flagged, events, top).groupBy("market", "event").agg(F.count(F.lit(1)).alias("n_moves"), *[F.avg(F.col(f"h_{c}").cast("double")).alias(f"s_{c}") for c in conditions])
    cells = [F.struct(F.lit(c).alias("cond"), F.col(f"s_{c}").alias("share_before"), F.col(f"a_{c}").alias("base_share")) for c in conditions]
    joined = at.filter("n_moves >= 5").join(always, "market").select("market", "event", "n_moves", F.inline(F.array(*cells)))
    return joined.filter("base_share is not null").withColumn("diff_pp", (F.col("share_before") - F.col("base_share")) * 100).orderBy("market", "event", F.desc(F.abs("diff_pp")), "cond")


def episodes(rows: DataFrame, flag: Column, gap: int = 0) -> DataFrame:
    """Runs of flagged weeks, up to ``gap`` unflagged ones inside: number, first and last date, weeks."""
    w = E.market_weeks("market")
    placed = rows.select("market", "report_date", F.coalesce(flag, F.lit(False)).alias("flag"), F.row_number().over(w).alias("pos")).filter("flag")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(w) - 1 > gap).cast("int"), F.lit(1))
    runs = placed.withColumn("episode", F.sum(new).over(w))
    return runs.groupBy("market", "episode").agg(
        F.min("report_date").alias("start_date"), F.max("report_date").alias("end_date"), (F.max("pos") - F.min("pos") + 1).cast("long").alias("weeks")
    )


def event_study(rows: DataFrame, flag: Column, horizons=EVENT_HORIZONS, use_episodes: bool = True, gap: int = 0) -> DataFrame:
    """Returns around the first week of each episode (or each flagged week), by horizon.

    Before the event it is minus the return up to it, at it 0, after it the return since.
    """
    w = E.market_weeks("market")
    p = F.col("price_close")
    around = {h: F.lit(0.0) if h == 0 else -(E.ratio(p, F.lag(p, -h).over(w)) - 1) if h < 0 else E.ratio(F.lead(p, h).over(w), p) - 1 for h in horizons}
    # inline turns each anchor into one row per horizon
    valued = rows.select("market", "report_date", F.coalesce(flag, F.lit(False)).alias("flag"), F.array(*[F.struct(F.lit(h).alias("horizon"), around[h].alias("r")) for h in horizons]).alias("path"))
    if use_episodes:
        anchors = episodes(rows, flag, gap).select("market", F.col("start_date").alias("report_date"))
        valued = valued.join(anchors, ["market", "report_date"], "left_semi")
    else:
        valued = valued.filter("flag")
    r = F.col("r")
    return valued.select("market", F.inline("path")).groupBy("market", "horizon").agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.percentile(r, F.lit(0.25)).alias("p25"), F.percentile(r, F.lit(0.75)).alias("p75")
    )

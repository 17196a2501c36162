"""Whole analyses of a market, from states to text, and the command line.

    python -m tidemark.plans.dossier synthetic STORE [CODE ...]
    python -m tidemark.plans.dossier live STORE [CODE ...] [--start YYYY-MM-DD] [--end YYYY-MM-DD]
    python -m tidemark.plans.dossier refresh STORE
    python -m tidemark.plans.dossier site STORE OUT.html
    python -m tidemark.plans.dossier date STORE CODE YYYY-MM-DD
    python -m tidemark.plans.dossier validate STORE OUT.json
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import reports
from ..config import ANALOG_FEATURES, ANALOG_FEATURES_WITH_PRICE, BOOTSTRAP_DRAWS, HORIZONS, MARKETS
from ..functions import expressions as E
from ..operators import analogs, events, panel, quality, states, statistics
from ..sources import feeds, reports_source, synthetic
from ..sources.store import Store

FIRST_DATE = "2015-01-06"
MODES = {"positions": ANALOG_FEATURES, "positions_and_price": ANALOG_FEATURES_WITH_PRICE}


def build(store: Store, as_of, codes: list[str] | None = None) -> DataFrame:
    """States of the stored markets, or of some of them: only their partitions are read and written."""
    inverse = tuple(m.code for m in MARKETS.values() if m.inverse)
    read = lambda table: store.read(table) if codes is None else store.read(table).where(F.col("market").isin(codes))
    prices = read("price_raw").groupBy("market", "date").agg(F.min_by("close", "source").alias("close"))
    rows = states.market_states(panel.roles_of(read("positions_raw")), prices, as_of, inverse)
    if codes is None:
        store.replace("states", rows)
    else:
        store.replace_touched("states", rows)
    return store.spark.read.parquet(store.path("states"))


def dossier(rows: DataFrame, draws: int = BOOTSTRAP_DRAWS) -> dict:
    """Per market: latest state, labels, analogs by both feature sets, evidence, events, text.

    Only the last week and aggregates are collected: a few hundred rows a market.
    """
    last = {r.market: r.asDict(recursive=True) for r in _labelled(states.latest(rows)).collect()}
    out = {code: {"state": row, "analogs": {}, "evidence": {}} for code, row in last.items()}
    for mode, features in MODES.items():
        full = rows.dropna(subset=list(features))
        query = states.latest(full.select("market", "report_date", "availability_date", *features))
        found = analogs.search(query, full, features).cache()
        chosen = rows.join(found.select("market", "report_date", F.lit(True).alias("is_analog")), ["market", "report_date"], "left")
        chosen = chosen.withColumn("is_analog", F.coalesce("is_analog", F.lit(False)))
        for r in matured(found).collect():
            out[r.market]["analogs"].setdefault(mode, []).append(r.asDict())
        for weeks in HORIZONS:
            base = statistics.edge_evidence(chosen, ("market",), f"fwd_return_{weeks}w", ("report_date",), F.col("is_analog"), weeks, draws)
            for r in base.collect():
                out[r.market]["evidence"].setdefault(mode, {})[weeks] = r.asDict()
    for r in events.contingency(rows).collect():
        out[r.market].setdefault("contingency", []).append(r.asDict())
    for r in states.table_rows(rows).orderBy("market", "age").collect():
        out[r.market].setdefault("table", []).append(r.asDict())
    for name, f in (("metrics", events.precursor_metrics), ("conditions", events.precursor_conditions)):
        for r in f(rows).collect():  # in the order in which they are shown
            out[r.market].setdefault("precursors", {}).setdefault(r.event, {}).setdefault(name, []).append(r.asDict())
    for code, d in out.items():
        found = d["evidence"].get("positions", {})
        d["text"] = reports.analysis(code, d["state"], found, found.get(8, {}).get("verdict"))
        d["report"] = reports.report(code, d)
    return out


def matured(found: DataFrame, horizon: int = 8, n: int = 5) -> DataFrame:
    """The ``n`` nearest analogs of each market whose outcome is known, however far down the list they are."""
    outcome = f"fwd_return_{horizon}w"
    nearest = Window.partitionBy("market").orderBy("place")
    known = found.filter(F.col(outcome).isNotNull()).withColumn("nth", F.row_number().over(nearest))
    return known.filter(F.col("nth") <= n).select("market", "report_date", "similarity", outcome).orderBy("market", "nth")


def _labelled(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumns(
        {
            "badge": E.badge(c("spec_pct_52w"), c("spec_streak_up_weeks"), c("spec_streak_down_weeks"), c("spec_chg_4w")),
            "flow": E.flow_code(c("spec_long_chg_1w"), c("spec_short_chg_1w")),
            "interest": E.interest_code(c("spec_chg_1w"), c("spec_oi_chg_1w")),
            "config": E.configuration(c("spec_net_oi"), c("slow_net_oi")),
            "level": E.level_label(c("spec_pct_52w")),
            "extremity": E.extremity(c("spec_pct_52w")),
            "momentum": E.momentum(c("spec_streak_up_weeks"), c("spec_streak_down_weeks"), c("spec_chg_4w")),
            "contradictions": states.divergence_words(c("divergence_flags")),
        }
    )


def load_synthetic(store: Store, codes: list[str]) -> None:
    rows = synthetic.panel(store.spark, codes).cache()
    now = F.current_timestamp()
    from ..functions.calendar import with_availability

    positions = with_availability(rows.drop("close")).drop("availability_warning")
    whole = {c: F.col(c).cast("long") for c in ("long", "short", "open_interest")}
    store.append("positions_raw", positions.withColumns({**whole, "source": F.lit("synthetic"), "ingested_at": now}))
    prices = rows.select("market", F.col("report_date").alias("date"), "close").distinct()
    store.append("price_raw", prices.withColumns({"source": F.lit("synthetic"), "ingested_at": now}))


def live_positions(spark: SparkSession, code: str, start: str, end: str, get=feeds.http_get) -> DataFrame:
    """A market's reports: asked for by tasks, or through ``get`` where one is given."""
    if get is not feeds.http_get:
        return feeds.fetch_positions(spark, code, start, end, get)
    return reports_source.read_positions(spark, [code], start, end)


def load_live(store: Store, codes: list[str], get=feeds.http_get, start: str | None = None, end: str | None = None) -> list[str]:
    """Fetches market by market from ``start`` (else from where the store ends) to ``end`` (else today).

    One that fails doesn't stop the others; rows that are stored already are left alone.
    """
    failed = []
    for code in codes:
        try:
            since = start or store.read("positions_raw", code).agg(F.date_add(F.max("report_date"), 1)).first()[0] or FIRST_DATE
            rows = live_positions(store.spark, code, str(since), end or str(date.today()), get)
            store.append("positions_raw", rows.withColumn("ingested_at", F.current_timestamp()))
            if feeds.has_price(code):
                first = start or store.read("price_raw", code).agg(F.date_sub(F.max("date"), 30)).first()[0] or FIRST_DATE
                prices = feeds.fetch_prices(store.spark, code, str(first), get)
                store.append("price_raw", prices.withColumns({"source": F.lit("web"), "ingested_at": F.current_timestamp()}))
        except (feeds.FeedError, feeds.PriceError, PySparkException, ValueError) as e:
            failed.append(code)
            store.log("quality_log", source=code, check_name="fetch", status="failed", detail=str(e)[:500])
    return failed


def validate(store: Store, codes: list[str], get=feeds.http_get) -> tuple[dict, int]:
    """Stored against live positions; exit code 0 for PASS, 1 for FAIL, 2 for BLOCKED, the worst of all."""
    results = {}
    for code in codes:
        try:
            stored = store.read("positions_raw", code).select("market", "participant", "report_date", "long", "short", "open_interest")
            newest = stored.agg(F.max("report_date")).first()[0]
            live = live_positions(store.spark, code, str(newest), str(newest), get)
            cells = quality.reconcile(live, stored.filter(F.col("report_date") == F.lit(newest)), ["market", "participant", "report_date"], ["long", "short", "open_interest"])
            results[code] = quality.reconcile_status(cells).first().result
        except (feeds.FeedError, PySparkException):
            results[code] = "BLOCKED"
    worst = max((("PASS", "FAIL", "BLOCKED").index(r) for r in results.values()), default=2)
    return results, worst


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", choices=("synthetic", "live", "refresh", "site", "date", "validate"))
    parser.add_argument("store")
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--start", help="first report date to fetch")
    parser.add_argument("--end", help="last report date to fetch")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, today = Store(spark, a.store), str(date.today())
    codes = a.rest if a.what in ("synthetic", "live") and a.rest else list(MARKETS)
    if a.what == "synthetic":
        load_synthetic(store, codes)
        build(store, today)
    elif a.what in ("live", "refresh"):
        failed = load_live(store, codes, start=a.start, end=a.end)
        if len(failed) == len(codes):
            return 1  # nothing came, so nothing is rebuilt
        build(store, today, [c for c in codes if c not in failed])
    elif a.what == "site":
        payload = dossier(spark.read.parquet(store.path("states")))
        with open(a.rest[0], "w", encoding="utf-8") as f:
            f.write(reports.site("Positions", payload))
    elif a.what == "date":
        rows = spark.read.parquet(store.path("states")).filter(F.col("market") == a.rest[0])
        near = quality.nearest_date(rows, a.rest[1]).first()
        row = rows.filter(F.col("report_date") == F.lit(near.nearest)).first()
        print(near.nearest, near.days, json.dumps(row.asDict(recursive=True), default=str))
    else:
        results, code = validate(store, codes)
        with open(a.rest[0], "w", encoding="utf-8") as f:
            json.dump(results, f)
        return code
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

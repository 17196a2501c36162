"""External feeds: position reports over HTTP as JSON, prices as CSV.

The driver fetches (a few hundred rows a market and request); what comes back is
a DataFrame with a fixed schema.  ``get`` is a parameter, so tests and mirrors
need no network.
"""

from __future__ import annotations

import csv
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MARKETS, market
from ..functions.calendar import with_availability
from ..operators.panel import unpivot_participants

PAGE = 50_000
TIMEOUT = 45
LEAST_PRICES = 100

# The two hosts, the data sets of the report families and their columns.
HOSTS = ("https://publicreporting.cftc.gov", "https://data.cftc.gov")
DATASETS = {"financial": "gpe5-46if", "disaggregated": "72hh-3qpy"}
COLUMNS = {
    "financial": {
        "dealer": ("dealer_positions_long_all", "dealer_positions_short_all"),
        "asset_manager": ("asset_mgr_positions_long", "asset_mgr_positions_short"),
        "leveraged_funds": ("lev_money_positions_long", "lev_money_positions_short"),
        "other_reportables": ("other_rept_positions_long", "other_rept_positions_short"),
    },
    "disaggregated": {
        "producer_merchant": ("prod_merc_positions_long", "prod_merc_positions_short"),
        "swap_dealers": ("swap_positions_long_all", "swap__positions_short_all"),
        "managed_money": ("m_money_positions_long_all", "m_money_positions_short_all"),
        "other_reportables": ("other_rept_positions_long", "other_rept_positions_short"),
    },
}
NAME, DATE, INTEREST = "market_and_exchange_names", "report_date_as_yyyy_mm_dd", "open_interest_all"


class FeedError(RuntimeError):
    """No host answered."""


class FeedSchemaError(FeedError):
    """An answer lacks columns, or no contract fits."""


class PriceError(RuntimeError):
    """No price source had enough rows."""


def http_get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
        return answer.read()


def from_any_host(path: str, params: dict[str, str], get: Callable[[str], bytes] = http_get, hosts: Iterable[str] = HOSTS) -> list[dict]:
    failed = []
    for host in hosts:
        try:
            return json.loads(get(f"{host}{path}?{urllib.parse.urlencode(params)}"))
        except (OSError, ValueError) as e:
            failed.append(f"{host}: {e}")
    raise FeedError("; ".join(failed))


_names: dict[str, list[str]] = {}


def contract_names(report: str, pattern: str = "", get: Callable[[str], bytes] = http_get) -> list[str]:
    """Distinct contract names of a report family, kept for the process; the pattern is looked for here."""
    if report not in _names:
        rows = from_any_host(f"/resource/{DATASETS[report]}.json", {"$select": f"distinct {NAME}", "$limit": str(PAGE)}, get)
        _names[report] = sorted({r[NAME] for r in rows if r.get(NAME)})
    return [n for n in _names[report] if pattern.upper() in n.upper()]


def chosen_contract(names: list[str], match: str) -> str:
    """The shortest name for the first alternative that has any."""
    fits = lambda pattern: [n for n in names if pattern.upper() in n.upper()]
    for variant in match.split("|"):
        if found := fits(variant.strip()):
            return min(found, key=lambda n: (len(n), n))
    raise FeedSchemaError(f"no contract for {match!r}; similar: {sorted(fits(match.split('|')[0].split()[0]))[:15]}")


def resolve_contract(report: str, match: str, get: Callable[[str], bytes] = http_get) -> str:
    return chosen_contract(contract_names(report, "", get), match)


def predicate(contract: str, start: object, end: object) -> str:
    """The service's predicate for a contract's reports of some days, both ends included."""
    quoted = contract.replace("'", "''")
    return f"{NAME} = '{quoted}' AND {DATE} between '{start}T00:00:00' and '{end}T00:00:00'"


def check_fields(records: list[dict], report: str, name: str) -> list[str]:
    """The fields of a report; an answer that lacks one is an error."""
    fields = [DATE, INTEREST, *(c for pair in COLUMNS[report].values() for c in pair)]
    if records and (missing := [f for f in fields if f not in records[0]]):
        raise FeedSchemaError(f"{name}: missing {missing}")
    return fields


def fetch_positions(spark: SparkSession, code: str, start: str, end: str, get: Callable[[str], bytes] = http_get) -> DataFrame:
    """A market's reports, one row per participant and the residual one, with when each became public."""
    m = market(code)
    name = resolve_contract(m.report, m.match, get)
    records = from_any_host(f"/resource/{DATASETS[m.report]}.json", {"$where": predicate(name, start, end), "$order": DATE, "$limit": str(PAGE)}, get)
    fields = check_fields(records, m.report, name)
    rows = spark.createDataFrame([tuple(str(r[f]) if r.get(f) is not None else None for f in fields) for r in records], ", ".join(f"`{f}` string" for f in fields))
    whole = lambda c: F.coalesce(F.col(c).try_cast("double").cast("long"), F.lit(0)).alias(c)
    rows = rows.select(F.lit(code).alias("market"), F.to_date(F.substring(DATE, 1, 10)).alias("report_date"), *[whole(f) for f in fields if f != DATE])
    keys = ["market", "report_date", INTEREST]
    parts = unpivot_participants(rows, COLUMNS[m.report], keys)
    left = parts.groupBy(*keys).agg(F.sum("long").alias("l"), F.sum("short").alias("s"))
    rest = lambda side: F.greatest(F.col(INTEREST) - F.col(side), F.lit(0))
    residual = left.select(*keys, F.lit("nonreportables").alias("participant"), rest("l").alias("long"), rest("s").alias("short"))
    both = parts.unionByName(residual).withColumnRenamed(INTEREST, "open_interest").withColumn("source", F.lit("cftc"))
    return with_availability(both).drop("availability_warning")


def price_lines(spark: SparkSession, text: str) -> DataFrame:
    """(date, close, line, fault) of a CSV text, a row per line below the header.

    Columns are named date and close in any case, or there are two.  Fields may be quoted and
    hold commas; a byte-order mark and empty lines are skipped.  ``fault`` is ``malformed``
    where a line has more or fewer fields than the header or an open quote, ``no number``
    where date or close can't be read, else NULL.
    """
    lines = [x for x in text.removeprefix("\ufeff").splitlines() if x.strip()]
    header = [c.strip() for c in next(csv.reader(lines[:1]), [])]
    by_name = {c.lower(): i for i, c in enumerate(header)}
    if {"date", "close"} <= set(by_name):
        d, c = by_name["date"], by_name["close"]
    elif len(header) == 2:
        d, c = 0, 1
    else:
        raise FeedSchemaError(f"no date and close in {header}")
    fields = ", ".join([*[f"c{i} string" for i in range(len(header))], "bad string"])
    rows = spark.createDataFrame([(x,) for x in lines[1:]], "line string")
    read = F.from_csv("line", fields, {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = rows.select("line", read.alias("r"))
    # an odd number of quotes is a quote that isn't closed
    whole = F.col("r.bad").isNull() & (F.regexp_count("line", F.lit('"')) % 2 == 0)
    day, number = F.expr(f"try_to_date(trim(r.c{d}))"), F.expr(f"try_cast(trim(r.c{c}) as double)")
    number = F.when(~F.isnan(number), number)
    fault = F.when(~whole, "malformed").when(day.isNull() | number.isNull(), "no number")
    return rows.select(day.alias("date"), number.alias("close"), "line", fault.alias("fault"))


def parse_prices(spark: SparkSession, text: str) -> DataFrame:
    """(date, close) of the lines of a CSV text that have both, in order of date."""
    return price_lines(spark, text).where("fault IS NULL").select("date", "close").orderBy("date")


def faults(lines: DataFrame) -> dict[str, int]:
    """How many lines of `price_lines` were rejected, by fault."""
    return {r["fault"]: r["count"] for r in lines.where("fault IS NOT NULL").groupBy("fault").count().collect()}


def price_urls(code: str) -> list[str]:
    """Where a market's prices may be, in order."""
    m = MARKETS[code]
    first = [f"https://fred.stlouisfed.org/graph/fredgraph.csv?id={m.fred}"] if m.fred else []
    return first + [f"https://stooq.com/q/d/l/?s={urllib.parse.quote(s)}&i=d" for s in (m.stooq or "").split("|") if s]


def has_price(code: str) -> bool:
    return bool(price_urls(code))


def fetch_prices(spark: SparkSession, code: str, start: str, get: Callable[[str], bytes] = http_get) -> DataFrame:
    """The first source with at least 100 prices, from ``start`` on."""
    failed = []
    for url in price_urls(code):
        try:
            rows = parse_prices(spark, get(url).decode()).cache()
            if rows.count() >= LEAST_PRICES:
                return rows.filter(F.col("date") >= F.lit(start).cast("date")).select(F.lit(code).alias("market"), "date", "close")
            failed.append(f"{url}: too few rows")
        except (OSError, ValueError, FeedError) as e:
            failed.append(f"{url}: {e}")
    raise PriceError(f"{code}: {'; '.join(failed) or 'no source'}")

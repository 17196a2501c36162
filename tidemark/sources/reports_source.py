"""Position reports as a Spark source, for batches and for streams.

    register(spark)
    spark.read.format("positions").option("markets", "EUR,GOLD").load()
    spark.readStream.format("positions").option("start", "2024-01-02").load()

A partition is a market and a year, and tasks ask the service for it themselves: the first
host that answers counts, answers are paged, and nothing goes through the driver but
contract names and, for streams, the newest date.

With ``pushdown`` filters on market and report date become predicates of the request
(and fewer partitions), so a query for a month asks for a month; a filter on
participants drops rows before they reach Spark.  It is off unless asked for, because Spark
4.1 keeps what one plan has pushed for the whole DataFrame that `load` returned: then load
anew for each query and don't join a load to itself.  ``markets``, ``start`` and ``end``
narrow requests in the same way and have no such limit.

Stream offsets are dates: a batch holds the reports from one offset's date to the day
before the next one's, so a batch that is replayed after a restart asks for the
same dates.  Reports that the service adds later to dates already read are not seen.

Options: ``markets`` (codes, all by default), ``start``, ``end`` (dates, the first year
and today by default), ``hosts``, ``page`` (rows asked for at once) and ``pushdown``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from ..config import MARKETS, market
from ..functions.calendar import with_availability
from . import feeds

NAME = "positions"
SCHEMA = "market string, report_date date, open_interest bigint, participant string, long bigint, short bigint, source string"
FIRST = "2006-01-01"
REST = "nonreportables"


@dataclass
class Slice(InputPartition):
    """A market's reports of some days, all in one year."""

    market: str
    contract: str
    start: date
    end: date


def whole(value: str | None) -> int:
    """A number that may be written as a decimal; 0 where there is none."""
    try:
        return int(float(value))
    except (TypeError, ValueError, OverflowError):
        return 0


def years(start: date, end: date) -> list[tuple[date, date]]:
    return [(max(start, date(y, 1, 1)), min(end, date(y, 12, 31))) for y in range(start.year, end.year + 1) if start <= end]


class Service:
    """What the options say: which markets, of which hosts."""

    def __init__(self, options: dict[str, str]):
        self.codes = [c.strip() for c in options.get("markets", ",".join(MARKETS)).split(",") if c.strip()]
        self.hosts = [h.strip() for h in options.get("hosts", ",".join(feeds.HOSTS)).split(",")]
        self.page = int(options.get("page", feeds.PAGE))
        self.pushdown = options.get("pushdown", "false").lower() == "true"
        self.start = date.fromisoformat(options.get("start", FIRST))
        self.end = date.fromisoformat(options.get("end", str(date.today())))

    def ask(self, report: str, params: dict[str, str]) -> list[dict]:
        return feeds.from_any_host(f"/resource/{feeds.DATASETS[report]}.json", params, hosts=self.hosts)

    def contracts(self, codes: Iterable[str]) -> dict[str, str]:
        """Each market's contract; names are asked for once a report family."""
        names: dict[str, list[str]] = {}
        out = {}
        for code in codes:
            m = market(code)
            if m.report not in names:
                rows = self.ask(m.report, {"$select": f"distinct {feeds.NAME}", "$limit": str(feeds.PAGE)})
                names[m.report] = [r[feeds.NAME] for r in rows if r.get(feeds.NAME)]
            out[code] = feeds.chosen_contract(names[m.report], m.match)
        return out

    def slices(self, codes: list[str], start: date, end: date) -> list[Slice]:
        found = self.contracts(codes)
        return [Slice(code, found[code], *year) for code in codes for year in years(start, end)]

    def newest(self) -> date | None:
        """The last date for which any of the markets' report families has reports."""
        dates = []
        for report in sorted({market(c).report for c in self.codes}):
            [row] = self.ask(report, {"$select": f"max({feeds.DATE}) as newest"}) or [{}]
            dates += [row["newest"][:10]] if row.get("newest") else []
        return date.fromisoformat(max(dates)) if dates else None

    def records(self, part: Slice) -> Iterator[list[dict]]:
        """Pages of a slice's reports, in order of their dates."""
        report, at = market(part.market).report, 0
        while True:
            page = self.ask(report, {"$where": feeds.predicate(part.contract, part.start, part.end), "$order": feeds.DATE, "$limit": str(self.page), "$offset": str(at)})
            feeds.check_fields(page, report, part.contract)
            if page:
                yield page
            if len(page) < self.page:
                return
            at += len(page)

    def read(self, part: Slice, participants: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
        """A row per report and participant, and one for what they leave of the open interest."""
        columns = feeds.COLUMNS[market(part.market).report]
        for page in self.records(part):
            rows = []
            for record in page:
                interest = whole(record.get(feeds.INTEREST))
                sides = {p: (whole(record.get(a)), whole(record.get(b))) for p, (a, b) in columns.items()}
                sides[REST] = tuple(max(interest - sum(s[i] for s in sides.values()), 0) for i in (0, 1))
                day = date.fromisoformat(record[feeds.DATE][:10])
                rows += [(part.market, day, interest, p, *s, "cftc") for p, s in sides.items() if participants is None or p in participants]
            if rows:
                kinds = (pa.string(), pa.date32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.service = Service(options)
        self.codes, self.start, self.end = self.service.codes, self.service.start, self.service.end
        self.participants: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over what the service or the slices can hold; the rest stays with Spark."""
        for f in filters:
            if not (self.service.pushdown and self._take(f)):
                yield f

    def _take(self, f: Filter) -> bool:
        column = f.attribute[0] if getattr(f, "attribute", None) else None
        wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if isinstance(f, IsNotNull):  # no column is ever null
            return True
        if column == "market" and wanted is not None:
            self.codes = [c for c in self.codes if c in wanted]
        elif column == "participant" and wanted is not None:
            self.participants = frozenset(wanted if self.participants is None else self.participants & wanted)
        elif column == "report_date" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
            day = timedelta(days=1)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, f.value + day * isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.end = min(self.end, f.value - day * isinstance(f, LessThan))
        else:
            return False
        return True

    def partitions(self) -> list[Slice]:
        return self.service.slices(self.codes, self.start, self.end) if self.codes and self.start <= self.end else []

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        # a plan without partitions reads None once
        return iter(()) if partition is None else self.service.read(partition, self.participants)


class Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.service = Service(options)

    def initialOffset(self) -> dict:
        return {"since": str(self.service.start)}

    def latestOffset(self) -> dict:
        newest = self.service.newest()
        last = min(newest, self.service.end) if newest else self.service.start - timedelta(days=1)
        return {"since": str(max(self.service.start, last + timedelta(days=1)))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        first, last = date.fromisoformat(start["since"]), date.fromisoformat(end["since"]) - timedelta(days=1)
        return self.service.slices(self.service.codes, first, last) if first <= last else []

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.service.read(partition)

    def commit(self, end: dict) -> None:
        """The service keeps its reports; nothing is let go."""


class Positions(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batch:
        return Batch(dict(self.options))

    def streamReader(self, schema) -> Stream:
        return Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; filters of Python sources are pushed only where this is set."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Positions)


def read_positions(spark: SparkSession, codes: Iterable[str], start: str, end: str, hosts: Iterable[str] = feeds.HOSTS) -> DataFrame:
    """The markets' reports with when each became public, as `feeds.fetch_positions` has them."""
    register(spark)
    rows = spark.read.format(NAME).options(markets=",".join(codes), start=start, end=end, hosts=",".join(hosts)).load()
    return with_availability(rows).drop("availability_warning")

"""The position source against a recorded server: pages, filters, hosts that fail, streams that restart."""

import json
import re
import threading
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds, reports_source

TUESDAYS = [date(2022, 11, 1) + timedelta(days=7 * k) for k in range(80)]
CONTRACTS = {"financial": ["EURO FX - EXCHANGE", "EURO FX/POUND XRATE", "BRITISH POUND - O'HARE"], "disaggregated": ["GOLD - COMMODITY EXCHANGE INC."]}


class Recorded:
    """Answers from fixed records; ``newest`` hides later ones, ``asked`` keeps the requests."""

    def __init__(self):
        self.newest, self.asked, self.down = TUESDAYS[-1], [], False
        self.records = {}
        for report, names in CONTRACTS.items():
            self.records[feeds.DATASETS[report]] = rows = []
            for n, name in enumerate(names):
                for k, day in enumerate(TUESDAYS):
                    row = {feeds.NAME: name, feeds.DATE: f"{day}T00:00:00.000", feeds.INTEREST: str(1000 + 10 * k + n)}
                    for i, (a, b) in enumerate(feeds.COLUMNS[report].values()):
                        row |= {a: f"{100 + k + i}.0", b: str(7 * k + i) if (k + i) % 5 else None}
                    rows.append(row)

    def answer(self, url):
        parts = urlparse(url)
        params = {k: v[0] for k, v in parse_qs(parts.query).items()}
        rows = [r for r in self.records[re.search(r"resource/(.*)\.json", parts.path)[1]] if r[feeds.DATE][:10] <= str(self.newest)]
        if "distinct" in params.get("$select", ""):
            return [{feeds.NAME: n} for n in dict.fromkeys(r[feeds.NAME] for r in rows)]
        if "max(" in params.get("$select", ""):
            return [{"newest": max(r[feeds.DATE] for r in rows)}]
        name, start, end = re.fullmatch(rf"{feeds.NAME} = '(.*)' AND {feeds.DATE} between '(.*)T00:00:00' and '(.*)T00:00:00'", params["$where"]).groups()
        self.asked.append((name, start, end))
        rows = [r for r in rows if r[feeds.NAME] == name.replace("''", "'") and start <= r[feeds.DATE][:10] <= end]
        at = int(params.get("$offset", 0))
        return rows[at : at + int(params["$limit"])]


@pytest.fixture(scope="module")
def served():
    recorded = Recorded()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path.startswith("/down") or recorded.down:
                self.send_error(503)
                return
            body = json.dumps(recorded.answer(self.path)).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    yield recorded, (f"{base}/down", base)
    server.shutdown()


def test_rows_equal_the_plain_feed(spark, served):
    recorded, hosts = served
    feeds._names.clear()
    got = reports_source.read_positions(spark, ["EUR", "GBP", "GOLD"], "2022-12-01", "2024-02-01", hosts)
    for code in ("EUR", "GBP", "GOLD"):
        want = feeds.fetch_positions(spark, code, "2022-12-01", "2024-02-01", lambda url: json.dumps(recorded.answer(url)).encode())
        own = got.where(F.col("market") == code).select(*want.columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, want.collect())) and want.count() > 200
    feeds._names.clear()


def test_filters_reach_the_service(spark, served):
    recorded, hosts = served
    reports_source.register(spark)
    load = lambda pushdown: spark.read.format("positions").options(markets="EUR,GBP,GOLD", start="2022-11-01", end="2024-06-01", hosts=",".join(hosts), page="3", pushdown=pushdown).load()
    recorded.asked.clear()
    condition = "market in ('EUR', 'GBP') and report_date >= date'2023-12-20' and report_date < date'2024-01-16' and participant = 'dealer' and long > 5"
    picked = load(True).where(condition)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    found = picked.collect()
    days = [d for d in TUESDAYS if date(2023, 12, 20) <= d < date(2024, 1, 16)]
    assert sorted((r.market, r.report_date) for r in found) == sorted((c, d) for c in ("EUR", "GBP") for d in days)
    asked = set(recorded.asked)
    assert {a[1:] for a in asked} == {("2023-12-20", "2023-12-31"), ("2024-01-01", "2024-01-15")} and len({a[0] for a in asked}) == 2
    # only what the service can't do is left to Spark
    assert re.findall(r"Filter \((\w+)#.*\)", plan) == ["long"], plan
    assert picked.rdd.getNumPartitions() == 4
    assert load(True).where("market = 'JPY'").count() == 0 and load(True).where("report_date > date'2030-01-01'").count() == 0
    # without pushdown a load serves any number of queries
    rows = load(False)
    assert sorted(rows.where(condition).collect()) == sorted(found) and rows.where("market = 'JPY'").count() == 0
    assert rows.count() == 3 * len([d for d in TUESDAYS if d <= date(2024, 6, 1)]) * 5


def test_no_host_and_no_contract(spark, served):
    recorded, hosts = served
    reports_source.register(spark)
    with pytest.raises(Exception, match="503"):
        spark.read.format("positions").options(markets="EUR", hosts=hosts[0]).load().count()
    with pytest.raises(Exception, match="no contract"):
        spark.read.format("positions").options(markets="JPY", hosts=",".join(hosts)).load().count()
    first = recorded.records[feeds.DATASETS["disaggregated"]]
    field = feeds.COLUMNS["disaggregated"]["swap_dealers"][0]
    kept = [r.pop(field) for r in first]
    with pytest.raises(Exception, match="missing"):
        spark.read.format("positions").options(markets="GOLD", start="2023-01-01", end="2023-03-01", hosts=",".join(hosts)).load().count()
    for r, v in zip(first, kept, strict=True):
        r[field] = v


def test_stream_goes_on_where_it_stopped(spark, served, tmp_path):
    recorded, hosts = served
    reports_source.register(spark)

    def drain():
        rows = spark.readStream.format("positions").options(markets="EUR,GOLD", start="2023-01-03", hosts=",".join(hosts)).load()
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).cache()

    try:
        for newest in (date(2023, 6, 1), date(2023, 6, 1), date(2023, 9, 30)):
            recorded.newest = newest
            recorded.asked.clear()
            got = drain()
            days = [d for d in TUESDAYS if date(2023, 1, 3) <= d <= newest]
            assert got.count() == got.distinct().count() == 2 * 5 * len(days)
            assert {r[0] for r in got.select("report_date").distinct().collect()} == set(days)
        assert {a[1] for a in recorded.asked} == {str(max(d for d in TUESDAYS if d <= date(2023, 6, 1)) + timedelta(days=1))}
    finally:
        recorded.newest = TUESDAYS[-1]


def test_failed_batch_is_read_again(spark, served, tmp_path):
    """A batch that was begun when the service went away is asked for again, each row once."""
    _, hosts = served
    reports_source.register(spark)

    def drain(lost):
        rows = spark.readStream.format("positions").options(markets="EUR", start="2024-01-02", hosts=",".join(hosts)).load()
        fail = F.when(F.lit(lost), F.raise_error(F.lit("lost"))).otherwise(F.col("long"))
        query = rows.withColumn("long", fail.cast("long")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        drain(True)
    drain(False)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == 5 * len([d for d in TUESDAYS if d >= date(2024, 1, 2)])

"""Sources, stores and streams."""

import csv
import json
import zipfile
from datetime import date, timedelta
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.sources import feeds, single_file, store, synthetic
from tidemark.streaming import incremental


def test_store_appends_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("EUR", date(2024, 1, d), float(d), "a") for d in (2, 3, 3)], "market string, date date, close double, source string").withColumn("ingested_at", F.current_timestamp())
    assert s.append("price_raw", rows) == 2 and s.append("price_raw", rows) == 0
    assert s.read("price_raw", "EUR").count() == 2 and s.read("price_raw", "GBP").count() == 0
    assert s.resume_date("price_raw", "2015-01-06", "date") == "2024-01-04" and s.resume_date("positions_raw", "2015-01-06") == "2015-01-06"
    with pytest.raises(ValueError):
        s.append("price_raw", rows.withColumn("extra", F.lit(1)))
    assert s.signature_changed("x", ["b", "a"]) == (False, None) and s.signature_changed("x", ["a", "b"]) == (False, "a,b")
    assert s.signature_changed("x", ["a"]) == (True, "a,b")
    s.log("hypotheses", condition_text="p < 10", market="EUR", horizon_weeks=8)
    assert s.newest("hypotheses").first().market == "EUR"
    assert store.migrate(rows, {"note": "string"}).columns[-1] == "note"


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    for kind in ("csv", "json", "parquet"):
        store.export(rows, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2 and spark.read.json(str(tmp_path / "json")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        store.export(rows, str(tmp_path / "x"), "doc")


ONE = "a int, b string, c double, d date, e boolean"


def test_one_file_out_of_many_tasks(spark, tmp_path):
    values = [(k, None if k % 5 == 0 else f"<{k}>, \"q\"\n\x01é", k / 4, date(2024, 1, 1 + k % 9), k % 2 == 0) for k in range(50)]
    rows = spark.createDataFrame(values, ONE).repartitionByRange(4, "a")
    for kind in ("csv", "json", "xlsx"):
        for _ in range(2):  # a file that is there is replaced
            store.export(rows, str(tmp_path / kind), kind, single=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["csv", "json", "xlsx"]
    with open(tmp_path / "csv", encoding="utf-8", newline="") as f:
        read = list(csv.reader(f))
    assert read[0] == ["a", "b", "c", "d", "e"] and [r[0] for r in read[1:]] == [str(k) for k in range(50)] and read[2][1] == values[1][1] and read[1][3] == "2024-01-01"
    lines = [json.loads(x) for x in (tmp_path / "json").read_text(encoding="utf-8").splitlines()]
    assert lines[7] == {"a": 7, "b": values[7][1], "c": 1.75, "d": "2024-01-08", "e": False}
    with zipfile.ZipFile(tmp_path / "xlsx") as book:
        assert book.testzip() is None and set(single_file.WORKBOOK) < set(book.namelist())
        sheet = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
    cells = [["".join(c.itertext()) for c in row] for row in sheet[0]]
    assert len(cells) == 51 and cells[0] == ["a", "b", "c", "d", "e"] and cells[2] == ["1", values[1][1].replace("\x01", ""), "0.25", "2024-01-02", "0"] and cells[1][1] == ""
    store.export(rows.limit(0), str(tmp_path / "none"), "csv", single=True)
    assert (tmp_path / "none").read_text() == "a,b,c,d,e\n"


def test_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).repartition(4).withColumn("x", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    for kind in ("csv", "xlsx"):
        with pytest.raises(Exception, match="lost"):
            store.export(rows, str(tmp_path / "out"), kind, single=True)
    assert list(tmp_path.iterdir()) == []


def fake_get(url):
    if "data.cftc.gov" not in url:
        raise OSError("down")
    if "distinct" in url:
        return json.dumps([{feeds.NAME: "EURO FX - EXCHANGE"}, {feeds.NAME: "EURO FX/BRITISH POUND XRATE"}]).encode()
    record = {feeds.DATE: "2024-01-02T00:00:00.000", feeds.INTEREST: "100"}
    for i, pair in enumerate(feeds.COLUMNS["financial"].values()):
        record |= dict(zip(pair, (str(10 + i), "20.0")))
    return json.dumps([record]).encode()


def test_positions_feed(spark):
    feeds._names.clear()
    rows = {r.participant: r for r in feeds.fetch_positions(spark, "EUR", "2024-01-01", "2024-02-01", fake_get).collect()}
    assert len(rows) == 5 and rows["dealer"].long == 10 and rows["nonreportables"].long == 100 - 46 and str(rows["dealer"].availability_date) == "2024-01-05"
    assert feeds.resolve_contract("financial", "NOPE|euro", fake_get) == "EURO FX - EXCHANGE"
    with pytest.raises(feeds.FeedSchemaError):
        feeds.resolve_contract("financial", "NOPE", fake_get)
    with pytest.raises(feeds.FeedError):
        feeds.from_any_host("/x", {}, lambda url: (_ for _ in ()).throw(OSError("down")))
    feeds._names.clear()


def test_price_feed(spark):
    days = [date(2023, 1, 1) + timedelta(days=i) for i in range(130)]
    first = "observation_date,DEXUSEU\n2023-01-01,.\n2023-01-02,1.1\n"
    second = "Date,Open,Close\n" + "\n".join(f"{d},1,{100 + i}" for i, d in enumerate(days))
    got = feeds.fetch_prices(spark, "EUR", "2023-02-01", lambda url: (first if "fred" in url else second).encode()).collect()
    assert len(got) == 99 and got[0].close == 131.0
    assert feeds.parse_prices(spark, first).count() == 1
    with pytest.raises(feeds.PriceError):
        feeds.fetch_prices(spark, "EUR", "2023-02-01", lambda url: first.encode())


def test_price_lines_keep_what_they_reject(spark):
    text = '\ufeffDate, Note ,CLOSE\n2024-01-02,"a, b",1.5\n\n2024-01-03,x\n2024-01-04,x,2.5,more\n2024-01-05,"open,3.5\n 2024-01-08 ,"say ""so""", 4.5 \n2024-01-09,x,.\nnever,x,1\n2024-01-10,x,NaN\n'
    lines = feeds.price_lines(spark, text).cache()
    assert [(str(r.date), r.close) for r in feeds.parse_prices(spark, text).collect()] == [("2024-01-02", 1.5), ("2024-01-08", 4.5)]
    assert feeds.faults(lines) == {"malformed": 3, "no number": 3} and lines.count() == 8
    assert [r.line for r in lines.where("fault = 'malformed'").collect()] == ["2024-01-03,x", "2024-01-04,x,2.5,more", '2024-01-05,"open,3.5']
    assert feeds.parse_prices(spark, "DATE,x\n2024-01-02,1\n").count() == 1 and feeds.parse_prices(spark, "a,b\n").count() == 0
    for bad in ("", "a,b,c\n1,2,3\n"):
        with pytest.raises(feeds.FeedSchemaError):
            feeds.parse_prices(spark, bad)


def test_synthetic_panel_adds_up(spark):
    rows = synthetic.panel(spark, ["EUR", "GOLD"], "2020-01-07", "2020-12-29").cache()
    sums = rows.groupBy("market", "report_date").agg(F.sum("long").alias("l"), F.sum("short").alias("s"), F.max("open_interest").alias("oi")).collect()
    assert len(sums) == 104 and all(r.l == r.oi == r.s for r in sums) and rows.filter("long < 0 or short < 0").count() == 0


def test_stream_keeps_rows_once(spark, tmp_path):
    schema = "market string, report_date date, arrived timestamp, v int"
    rows = spark.createDataFrame([("EUR", date(2024, 1, 2), "2024-01-05 00:00:00", 1), ("EUR", date(2024, 1, 2), "2024-01-06 00:00:00", 2), ("GBP", date(2024, 1, 2), "2024-01-05 00:00:00", 3)], "market string, report_date date, t string, v int")
    rows.select("market", "report_date", F.to_timestamp("t").alias("arrived"), "v").write.parquet(str(tmp_path / "in"))
    landed = incremental.read_landing(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    q = incremental.append_once(incremental.once_each(landed, ["market", "report_date"], "arrived"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def files_of(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_touched_markets_are_built_again(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    schema = "market string, v int"
    land = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    runs = []

    def build(rows):
        runs.append(sorted({r.market for r in rows.select("market").distinct().collect()}))
        return rows.groupBy("market").agg(F.count(F.lit(1)).alias("n"))

    def drain():
        landed = incremental.read_landing(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        incremental.rebuild_touched(landed, lambda: spark.read.parquet(str(tmp_path / "in")), build, s, "derived", str(tmp_path / "ck")).awaitTermination()
        return {r.market: (r.n, r.batch) for r in spark.read.parquet(s.path("derived")).collect()}

    land([("EUR", 1), ("GBP", 2)])
    assert drain() == {"EUR": (1, 0), "GBP": (1, 0)}
    before = files_of(tmp_path / "derived")
    land([("GBP", 3)])
    assert drain() == {"EUR": (1, 0), "GBP": (2, 1)} and runs[-1] == ["GBP"]
    after = files_of(tmp_path / "derived")
    assert {p: t for p, t in before.items() if "EUR" in str(p)} == {p: t for p, t in after.items() if "EUR" in str(p)}
    # the batch was written, but the driver was lost before it was committed: the replay writes nothing
    for p in (tmp_path / "ck/commits").iterdir():
        if p.name in ("1", ".1.crc"):
            p.unlink()
    n = len(runs)
    assert drain() == {"EUR": (1, 0), "GBP": (2, 1)} and files_of(tmp_path / "derived") == after and len(runs) == n


def test_write_that_fails_leaves_the_table(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("EUR", 1), ("GBP", 2)], "market string, v int")
    s.replace_touched("t", rows)
    before = files_of(tmp_path / "t")
    bad = rows.withColumn("v", F.when(F.col("market") == "GBP", F.raise_error(F.lit("lost"))).otherwise(F.col("v") + 1).cast("int"))
    with pytest.raises(Exception, match="lost"):
        s.replace_touched("t", bad)
    assert files_of(tmp_path / "t") == before and sorted(r.v for r in spark.read.parquet(s.path("t")).collect()) == [1, 2]
    # made from the table itself
    s.replace_touched("t", spark.read.parquet(s.path("t")).where("market = 'EUR'").withColumn("v", F.col("v") + 10))
    assert {r.market: r.v for r in spark.read.parquet(s.path("t")).collect()} == {"EUR": 11, "GBP": 2}


def test_crash_within_replace_is_put_right(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("EUR", 1)], "market string, v int")
    read = lambda: [r.v for r in spark.read.parquet(s.path("t")).collect()]
    s.replace("t", rows)
    # the old table has lost its name and the new one is complete
    s._write(rows.withColumn("v", F.lit(2)), "t__new", "overwrite")
    s._rename("t", "t__old")
    assert s.exists("t") and read() == [2] and not s._there("t__old")
    # the new one is not complete
    s._write(rows.withColumn("v", F.lit(3)), "t__new", "overwrite")
    (tmp_path / "t__new/_SUCCESS").unlink()
    s._rename("t", "t__old")
    assert s.exists("t") and read() == [2]
    # both have their names, the old one wasn't deleted yet
    s.replace("t", rows.withColumn("v", F.lit(4)))
    rows.write.parquet(s.path("t__old"))
    assert s.exists("t") and read() == [4] and not s._there("t__old")


def test_backlog_of_reports_loses_no_row(spark, tmp_path):
    """Reports of a shutdown come at once, months late; with the calendar's lag all meet their prices."""
    weeks = [date(2025, 8, 5) + timedelta(days=7 * k) for k in range(28)]
    known = {w: w + timedelta(days=3) for w in weeks}
    held = [w for w in weeks if date(2025, 9, 23) <= w <= date(2025, 12, 30)]
    reports = "market string, report_date date, availability_date date"
    prices = "market string, date date, close double"
    days = [date(2025, 8, 5) + timedelta(days=k) for k in range(7 * 28 + 10)]
    everything = [("EUR", w, known[w]) for w in weeks]
    late = incremental.LateRows()
    spark.streams.addListener(late)

    def run(name, lag):
        folder = tmp_path / name
        new = [w for w in weeks if w > date(2025, 12, 30)]
        for part in ([w for w in weeks if w < held[0]], new[:1], new[1:2], held, new[2:]):
            spark.createDataFrame([("EUR", w, known[w]) for w in part], reports).coalesce(1).write.mode("append").parquet(str(folder / "reports"))
        for k in range(5):
            spark.createDataFrame([("EUR", d, float(i)) for i, d in enumerate(days) if i * 5 // len(days) == k], prices).coalesce(1).write.mode("append").parquet(str(folder / "prices"))
        read = lambda n, s: incremental.read_landing(spark, str(folder / n), spark.createDataFrame([], s).schema, 1)
        query = incremental.append_once(incremental.priced_reports(read("reports", reports), read("prices", prices), lag=lag), str(folder / "out"), str(folder / "ck"))
        query.awaitTermination()
        rows = spark.read.parquet(str(folder / "out"))
        return query, sorted((r.report_date, r.date, r.close) for r in rows.collect()), sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)

    want = sorted((w, d, float(i)) for _, w, k in everything for i, d in enumerate(days) if k <= d <= k + timedelta(days=3))
    query, got, dropped = run("whole", None)
    assert got == want and dropped == 0
    query, got, dropped = run("short", "7 days")
    assert dropped > 0 and len(got) < len(want)
    spark.streams.removeListener(late)
    assert late.dropped.get(str(query.id)) == dropped
    from tidemark.functions.calendar import longest_delay

    assert longest_delay() >= max((date(2025, 12, 30) - w).days for w in held)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dossier_of_synthetic_markets(spark, tmp_path):
    from tidemark.plans import dossier

    s = store.Store(spark, str(tmp_path))
    dossier.load_synthetic(s, ["EUR", "GOLD"])
    rows = dossier.build(s, "2025-12-31").filter("report_date >= '2022-01-01'").cache()
    got = dossier.dossier(rows, draws=20)
    assert set(got) == {"EUR", "GOLD"} and len(got["EUR"]["contingency"]) == 54
    assert set(got["GOLD"]["evidence"]["positions"]) == {1, 2, 4, 8, 12, 26} and len(got["GOLD"]["analogs"]["positions_and_price"]) == 5
    assert got["EUR"]["text"].startswith("EUR: ") and len(got["EUR"]["table"]) == 80
    assert all(f"## {h}" in got["GOLD"]["report"] for h in ("State", "Price", "Analogs", "Validity", "Seen", "Against")) and "| spec |" in got["GOLD"]["report"]
    results, code = dossier.validate(s, ["EUR"], lambda url: (_ for _ in ()).throw(OSError("down")))
    assert results == {"EUR": "BLOCKED"} and code == 2
    assert dossier.load_live(s, ["EUR"], lambda url: (_ for _ in ()).throw(OSError("down"))) == ["EUR"]


def test_replace_may_read_what_it_overwrites(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("EUR", 1), ("GBP", 2)], "market string, v int")
    s.replace("states", rows)
    s.replace("states", spark.read.parquet(s.path("states")).withColumn("v", F.col("v") + 10))
    assert sorted(r.v for r in spark.read.parquet(s.path("states")).collect()) == [11, 12] and not s.exists("states__new")


def test_append_counts_its_own_rows(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("EUR", date(2024, 1, 1), 1.0, "web"), ("EUR", date(2024, 1, 2), 2.0, "web")], "market string, date date, close double, source string").withColumn("ingested_at", F.current_timestamp())
    assert s.append("price_raw", rows) == 2 and s.append("price_raw", rows) == 0 and s.read("price_raw").count() == 2
    s.log("hypotheses", condition_text="x > 1", market="EUR", horizon_weeks=8)
    assert s.count_hypotheses() == 1

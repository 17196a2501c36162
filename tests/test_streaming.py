"""Stateful streaks: weeks in any order, weeks that are too late, batches that run again, keys that fall silent."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import metrics
from tidemark.streaming import incremental, stateful

WEEKS = [date(2020, 1, 7) + timedelta(days=7 * k) for k in range(60)]
ROW = "market string, role string, report_date date, net double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(m, r, w, None if rng.random() < 0.05 else float(rng.randint(0, 3))) for m in ("A", "B") for r in ("s", "t") for w in WEEKS]


def landed(spark, path, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(path)


def drain(spark, folder, lag="56 days"):
    """All files in the folder, one a batch; the rows that Spark dropped as too late."""
    stream = incremental.read_landing(spark, f"{folder}/in", spark.createDataFrame([], ROW).schema, 1)
    with stateful.rocksdb(spark):
        query = stateful.write_versions(stateful.streak_changes(stream, lag), f"{folder}/out", f"{folder}/state")
        query.awaitTermination()
    return sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress if p.stateOperators)


def versions(spark, folder):
    rows = stateful.last_versions(spark.read.parquet(f"{folder}/out")).collect()
    return {(r.market, r.role, r.report_date): (r.streak_up_weeks, r.streak_down_weeks) for r in rows}


def batch(spark, rows):
    found = metrics.streaks(spark.createDataFrame(rows, ROW)).collect()
    return {(r.market, r.role, r.report_date): (r.streak_up_weeks, r.streak_down_weeks) for r in found}


def test_late_weeks_give_the_batch_streaks(spark, rows, tmp_path):
    rng, files = random.Random(3), [[] for _ in range(4)]
    for row in rows:
        files[min((WEEKS.index(row[2]) + rng.randint(0, 5)) // 16, 3)].append(row)
    for f in files[:2]:
        landed(spark, str(tmp_path / "in"), f)
    assert drain(spark, tmp_path) == 0
    for f in files[2:]:  # a new query goes on from the state that the first one left
        landed(spark, str(tmp_path / "in"), f)
    assert drain(spark, tmp_path) == 0
    assert versions(spark, tmp_path) == batch(spark, rows)


def test_too_late_weeks_are_counted_and_change_nothing(spark, tmp_path):
    own = [("A", "s", w, float(k)) for k, w in enumerate(WEEKS[:20])]
    landed(spark, str(tmp_path / "in"), own[:1] + own[2:])
    landed(spark, str(tmp_path / "in"), [("A", "s", WEEKS[20], 50.0)])  # the watermark moves on
    landed(spark, str(tmp_path / "in"), [own[1], ("A", "s", WEEKS[21], 51.0)])
    assert drain(spark, tmp_path, "14 days") == 1
    assert versions(spark, tmp_path) == batch(spark, own[:1] + own[2:] + [("A", "s", WEEKS[20], 50.0), ("A", "s", WEEKS[21], 51.0)])


def test_batch_that_runs_again_changes_nothing(spark, rows, tmp_path):
    landed(spark, str(tmp_path / "in"), rows[:100])
    drain(spark, tmp_path)
    before = versions(spark, tmp_path)
    commits = sorted((tmp_path / "state/commits").glob("[0-9]*"))
    commits[-1].unlink()  # as if the driver had been lost before the batch was committed
    for crc in (tmp_path / "state/commits").glob(".*.crc"):
        crc.unlink()
    drain(spark, tmp_path)
    assert versions(spark, tmp_path) == before == batch(spark, rows[:100])


def test_silent_keys_are_cleared(spark, tmp_path):
    landed(spark, str(tmp_path / "in"), [("A", "s", WEEKS[0], 1.0), ("A", "s", WEEKS[1], 2.0), ("B", "s", WEEKS[1], 1.0)])
    far = WEEKS[1] + timedelta(days=4 * 365)
    landed(spark, str(tmp_path / "in"), [("B", "s", far, 1.0)])
    landed(spark, str(tmp_path / "in"), [("B", "s", far + timedelta(days=7), 2.0)])
    landed(spark, str(tmp_path / "in"), [("A", "s", far + timedelta(days=14), 9.0), ("B", "s", far + timedelta(days=14), 3.0)])
    drain(spark, tmp_path)
    got = versions(spark, tmp_path)
    assert got["B", "s", far + timedelta(days=14)] == (2, 0) and got["A", "s", far + timedelta(days=14)] == (0, 0) and got["A", "s", WEEKS[1]] == (1, 0)

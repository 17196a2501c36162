"""The pivot index against a comparison of all pairs."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import analogs, neighbours

FEATURES = {"feat_a": 1.0, "feat_b": 0.5}
POOL = "market string, report_date date, availability_date date, feat_a double, feat_b double"


@pytest.fixture(scope="module")
def pool(spark):
    rng = random.Random(0)
    rows = []
    for market, n in (("A", 200), ("B", 60), ("C", 3), ("flat", 20)):
        for k in range(n):
            day = date(2015, 1, 6) + timedelta(days=7 * k)
            late = timedelta(days=3 if k % 9 else 30)
            a = 1.0 if market == "flat" else rng.gauss(0, 1)
            rows.append((market, day, None if k % 50 == 7 else day + late, None if k % 40 == 5 else a, round(rng.gauss(0, 1), 1)))
    rows += [("A", date(2030, 1, 1), date(2030, 1, 4), rows[3][3], rows[3][4]), ("A", date(2030, 1, 8), date(2030, 1, 11), rows[3][3], rows[3][4])]
    return spark.createDataFrame(rows, POOL).cache()


def all_pairs(pool, k):
    fitted = {r.market: r for r in analogs.fit(pool, FEATURES).collect()}
    found = {}
    rows = pool.collect()
    for q in rows:
        fit, near = fitted[q.market], []
        for p in rows:
            if p.market == q.market and p.report_date < q.report_date and p.availability_date and q.availability_date and p.availability_date <= q.availability_date:
                parts = [(w * (p[f] - q[f]) / fit[f"std_{f}"]) if None not in (p[f], q[f], fit[f"std_{f}"]) else None for f, w in FEATURES.items()]
                if None not in parts:
                    near.append((math.sqrt(sum(x * x for x in parts)), p.report_date))
        for place, (d, day) in enumerate(sorted(near)[:k], 1):
            found[q.market, q.report_date, place] = (day, round(d, 9))
    return found


@pytest.mark.parametrize("k,ring", [(5, 4), (40, 16)])
def test_every_week_finds_what_all_pairs_find(spark, pool, tmp_path, k, ring):
    neighbours.filed(neighbours.points(pool, FEATURES), ring=ring).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    want = all_pairs(pool, k)
    got = {(r.market, r.query_date, r.place): (r.report_date, round(r.distance, 9)) for r in neighbours.nearest(index, k).collect()}
    assert got.keys() == want.keys() and {key[0] for key in got} == {"A", "B", "C"}
    # equal distances may differ in the last bits, so only their weeks may change places
    assert all(got[key][1] == want[key][1] for key in want) and sum(got[key] != want[key] for key in want) <= 0.01 * len(want)
    share = neighbours.pruned(index, k).where("market = 'A'").first()
    assert share.computed <= share.in_reach <= share.pairs
    if k == 5:
        assert share.computed < 0.5 * share.pairs


def test_index_of_nothing_and_no_outcomes(spark, pool):
    assert neighbours.nearest(neighbours.build(pool.limit(0), FEATURES)).count() == 0
    with pytest.raises(ValueError):
        neighbours.build(pool.withColumn("fwd_return_4w", F.lit(1.0)), {"fwd_return_4w": 1.0})

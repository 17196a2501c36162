"""Nearest earlier weeks of every week, exactly, by a pivot index.

A market's weeks are points of standardised, weighted features.  A few of them are pivots;
each week is filed under its nearest pivot, in rings of ``RING`` weeks in order of their
distance to it, and keeps its distances to all pivots.  A query asks first the rings
around its own place, which bounds the distance of its k-th neighbour from above; then,
by the triangle inequality, only the rings that can reach into that bound, and in them
only weeks whose distance to every pivot differs by no more.  What is left is computed.

Joins are by market, pivot and ring, so no two weeks meet whose rings are too far apart.
The scaling is one per market (that of `analogs.fit`), as one index needs one metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANALOG_FEATURES, MAX_ANALOGS
from ..functions.guard import assert_not_outcomes
from . import analogs

PIVOTS = 8
#: Weeks in a ring, and rings on both sides of a query's own that give the first bound.
RING, AROUND = 16, 4
#: Bounds are widened by this share, so that rounding loses nothing.
SLACK = 1e-9


def points(pool: DataFrame, features: dict[str, float] = ANALOG_FEATURES, by: str = "market") -> DataFrame:
    """(by, report_date, known, z, rms): weeks whose features are all known, in the market's scale.

    A feature without spread leaves the market without points.
    """
    assert_not_outcomes(features)
    scaled = [(F.col(f) - F.col(f"mean_{f}")) / F.col(f"std_{f}") * wt for f, wt in features.items()]
    rows = pool.join(analogs.fit(pool, features, by), by)
    rows = rows.select(by, "report_date", F.col("availability_date").alias("known"), F.array(*scaled).alias("z"), "rms")
    return rows.where(F.forall("z", lambda x: x.isNotNull()))


def apart(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def filed(rows: DataFrame, by: str = "market", pivots: int = PIVOTS, ring: int = RING) -> DataFrame:
    """Adds ``d`` (distances to the pivots), ``cell`` (the nearest pivot's number from 0) and ``ring``.

    Pivots are the weeks whose digests are smallest, so they depend on the data alone.
    """
    mixed = F.md5(F.concat_ws("|", F.col(by).cast("string"), F.col("report_date").cast("string")))
    first = Window.partitionBy(by).orderBy("__h", "report_date")
    chosen = rows.select(by, "report_date", "z", mixed.alias("__h")).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= pivots)
    chosen = chosen.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "z"))), lambda p: p["z"]).alias("__p"))
    rows = rows.join(chosen, by).withColumn("d", F.transform("__p", lambda p: apart(p, F.col("z")))).drop("__p")
    rows = rows.withColumn("cell", (F.array_position("d", F.array_min("d")) - 1).cast("int"))
    order = Window.partitionBy(by, "cell").orderBy(F.get("d", F.col("cell")), "report_date")
    return rows.withColumn("ring", F.floor((F.row_number().over(order) - 1) / ring).cast("int"))


def directory(index: DataFrame, by: str = "market") -> DataFrame:
    """Each market's rings: pivot, number, least and largest distance to the pivot, first week."""
    own = F.get("d", F.col("cell"))
    rings = index.groupBy(by, "cell", "ring").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.min("report_date").alias("first"))
    return rings.groupBy(by).agg(F.collect_list(F.struct("cell", "ring", "lo", "hi", "first")).alias("rings"))


def _asked(index: DataFrame, by: str) -> DataFrame:
    return index.select(by, F.col("report_date").alias("query_date"), F.col("known").alias("query_known"), F.col("z").alias("qz"), F.col("d").alias("qd"), F.col("cell").alias("qcell"), F.col("ring").alias("qring"), "rms")


_PUBLIC = "report_date < query_date AND known <= query_known"


def bounds(index: DataFrame, k: int = MAX_ANALOGS, by: str = "market", around: int = AROUND) -> DataFrame:
    """Each week as a query with ``bound``: no neighbour that counts is farther; infinite where fewer than ``k`` were near."""
    asked = _asked(index, by)
    near = asked.withColumn("ring", F.explode(F.sequence(F.col("qring") - around, F.col("qring") + around))).withColumn("cell", F.col("qcell"))
    met = near.join(index.drop("rms"), [by, "cell", "ring"]).where(_PUBLIC)
    nth = F.get(F.sort_array(F.collect_list(apart(F.col("qz"), F.col("z")))), F.lit(k - 1))
    found = met.groupBy(by, "query_date").agg(nth.alias("bound"))
    return asked.join(found, [by, "query_date"], "left").withColumn("bound", F.coalesce(F.col("bound") * (1 + SLACK) + SLACK, F.lit(float("inf"))))


def candidates(index: DataFrame, queries: DataFrame, by: str = "market") -> DataFrame:
    """Pairs of query and earlier public week in rings within reach; ``open`` where no pivot excludes them either."""
    reach = lambda r: F.greatest(F.get("qd", r["cell"]) - r["hi"], r["lo"] - F.get("qd", r["cell"])) <= F.col("bound")
    asked = queries.join(directory(index, by), by)
    asked = asked.withColumn("__r", F.explode(F.filter("rings", lambda r: (r["first"] < F.col("query_date")) & reach(r)))).drop("rings")
    asked = asked.withColumns({"cell": F.col("__r.cell"), "ring": F.col("__r.ring")}).drop("__r", "qcell", "qring")
    met = asked.join(index.drop("rms"), [by, "cell", "ring"]).where(_PUBLIC)
    return met.withColumn("open", F.forall(F.zip_with("qd", "d", lambda a, b: F.abs(a - b)), lambda x: x <= F.col("bound")))


def build(pool: DataFrame, features: dict[str, float] = ANALOG_FEATURES, by: str = "market") -> DataFrame:
    """The index of a pool: a row per week, to be stored, as searches read it several times."""
    return filed(points(pool, features, by), by)


def nearest(index: DataFrame, k: int = MAX_ANALOGS, by: str = "market") -> DataFrame:
    """For every week of an index its ``k`` nearest earlier public weeks: distance, similarity and place."""
    pairs = candidates(index, bounds(index, k, by), by).where("open").withColumn("distance", apart(F.col("qz"), F.col("z")))
    order = Window.partitionBy(by, "query_date").orderBy("distance", "report_date")
    found = pairs.where("distance <= bound").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return found.select(by, "query_date", "report_date", "place", "distance", (100 * F.exp(-F.col("distance") / F.col("rms"))).alias("similarity"))


def pruned(index: DataFrame, k: int = MAX_ANALOGS, by: str = "market") -> DataFrame:
    """Per market: pairs that a full comparison has, those in rings within reach, and those computed."""
    met = candidates(index, bounds(index, k, by), by).groupBy(by).agg(F.count(F.lit(1)).alias("in_reach"), F.count_if("open").alias("computed"))
    place = Window.partitionBy(by).orderBy("report_date")
    every = index.withColumn("before", F.row_number().over(place) - 1).groupBy(by).agg(F.sum("before").alias("pairs"))
    return every.join(met, by, "left")

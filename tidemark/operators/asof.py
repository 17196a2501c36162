"""As-of and range joins of weekly rows with daily prices.

Rows and prices are put into one stream per market, ordered by date, and a
window carries the next (or last) price to each row: one shuffle and one sort,
linear in both sides, where a join by inequality would be quadratic. 
A key's stream is its weeks and days, thousands of rows a decade, however many
keys there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E


def _asof(rows: DataFrame, prices: DataFrame, at: str, forward: bool, value: str, by: str, tolerance_days: int | None) -> DataFrame:
    row_cols = rows.columns
    left = rows.select(F.struct(*row_cols).alias("__row"), F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(None).cast("date").alias("__date"), F.lit(None).cast("double").alias("__close"))
    right = prices.select(F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(by).alias("__by"), F.col("date").alias("__at"), F.col("date").alias("__date"), F.col("close").alias("__close"))
    point = F.when(F.col("__date").isNotNull(), F.struct("__date", "__close"))
    both = left.unionByName(right)
    # prices of a row's own day come before it in either direction; both frames only grow,
    # which Spark evaluates in one pass (a frame that shrinks costs a pass per row)
    order = F.col("__at").desc() if forward else F.col("__at").asc()
    w = Window.partitionBy("__by").orderBy(order, F.col("__date").desc_nulls_last())
    found = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__found", found)
    out = out.filter("__row is not null")
    near = F.lit(True) if tolerance_days is None else F.abs(F.datediff("__found.__date", "__at")) <= tolerance_days
    return out.select("__row.*", F.when(near, F.col("__found.__close")).alias(value))


def forward(rows: DataFrame, prices: DataFrame, at: str, value: str, by: str = "market", tolerance_days: int | None = None) -> DataFrame:
    """``rows`` with the first price on or after ``at``; NULL if there is none (within the tolerance)."""
    return _asof(rows, prices, at, True, value, by, tolerance_days)


def backward(rows: DataFrame, prices: DataFrame, at: str, value: str, by: str = "market", tolerance_days: int | None = None) -> DataFrame:
    """``rows`` with the last price on or before ``at``."""
    return _asof(rows, prices, at, False, value, by, tolerance_days)


def forward_returns(rows: DataFrame, prices: DataFrame, horizons, as_of, inverse=(), keys=("market", "report_date"), anchor: str = "availability_date") -> DataFrame:
    """``keys`` with fwd_return_{h}w: price after h weeks against the price at the anchor.

    NULL until anchor + h weeks has come (by ``as_of``), and where a price is missing
    or 0; the sign is turned for inversely quoted markets.  All points of all
    horizons go through one as-of join.
    """
    points = rows.select(*keys, F.col(anchor).alias("__anchor"), F.explode(F.array(*map(F.lit, (0, *horizons)))).alias("__h"))
    points = points.withColumn("__at", F.date_add("__anchor", F.col("__h") * 7))
    priced = forward(points, prices, "__at", "__price").filter((F.col("__h") == 0) | (F.col("__at") <= F.lit(as_of).cast("date")))
    wide = priced.groupBy(*keys).agg(*[F.max(F.when(F.col("__h") == h, F.col("__price"))).alias(f"__p{h}") for h in (0, *horizons)])
    sign = F.when(F.col("market").isin(*inverse), -1.0).otherwise(1.0) if inverse else F.lit(1.0)
    return wide.select(*keys, *[(sign * (E.ratio(F.col(f"__p{h}"), F.col("__p0")) - 1)).alias(f"fwd_return_{h}w") for h in horizons])


def excursions(rows: DataFrame, prices: DataFrame, weeks: int, keys=("market", "report_date"), anchor: str = "availability_date") -> DataFrame:
    """Best and worst move within ``weeks`` of the anchor, against the first price of the path.

    The path is a range join on market and period: prices are filed under their
    week, rows under each week of their path, so it is an equi-join.
    """
    week = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / 7)
    paths = rows.select(*keys, F.col(anchor).alias("__from"), F.date_add(anchor, 7 * weeks).alias("__to"))
    paths = paths.withColumn("__week", F.explode(F.sequence(week(F.col("__from")), week(F.col("__to")))))
    filed = prices.select("market", "date", "close", week(F.col("date")).alias("__week"))
    inside = paths.join(filed, ["market", "__week"]).filter(F.col("date").between(F.col("__from"), F.col("__to")))
    path = inside.groupBy(*keys).agg(F.min_by("close", "date").alias("p0"), F.max("close").alias("hi"), F.min("close").alias("lo"), F.count(F.lit(1)).alias("n_prices"))
    known = (F.col("n_prices") >= 2) & (F.col("p0") != 0)
    return path.select(*keys, "n_prices", F.when(known, E.ratio(F.col("hi"), F.col("p0")) - 1).alias("mfe"), F.when(known, E.ratio(F.col("lo"), F.col("p0")) - 1).alias("mae"))

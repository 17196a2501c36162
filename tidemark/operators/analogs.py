"""Nearest historical weeks by weighted standardised distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANALOG_FEATURES, MAX_ANALOGS
from ..functions import expressions as E
from ..functions.guard import assert_not_outcomes


def _complete(features) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])


def fit(pool: DataFrame, features: dict[str, float] = ANALOG_FEATURES, by: str = "market") -> DataFrame:
    """Per market: mean and deviation of each feature (each over its own known values; no
    spread is NULL) and the root mean square distance of complete rows from the means."""
    assert_not_outcomes(features)
    stats = pool.groupBy(by).agg(*[F.avg(f).alias(f"mean_{f}") for f in features], *[F.nullif(F.stddev_samp(f), F.lit(0.0)).alias(f"std_{f}") for f in features])
    square = sum((wt * (F.col(f) - F.col(f"mean_{f}")) / F.col(f"std_{f}")) ** 2 for f, wt in features.items())
    rms = pool.join(stats, by).filter(_complete(features)).groupBy(by).agg(F.sqrt(F.avg(square)).alias("rms"))
    scale = F.coalesce(F.nullif(F.col("rms"), F.lit(0.0)), F.lit(1.0))
    return stats.join(rms, by, "left").withColumn("rms", scale)


def search(queries: DataFrame, pool: DataFrame, features: dict[str, float] = ANALOG_FEATURES, k: int = MAX_ANALOGS, by: str = "market") -> DataFrame:
    """For each query row (one per market) the ``k`` nearest rows of the pool that were public before it.

    Distances, similarities and each feature's share.  A query with an unknown
    feature, or a feature without spread, has no analogs.
    """
    assert_not_outcomes(features)
    fitted = fit(pool, features, by)
    asked = queries.select(by, F.col("report_date").alias("query_date"), F.col("availability_date").alias("query_known"), *[F.col(f).alias(f"q_{f}") for f in features])
    pairs = pool.join(asked, by).join(fitted, by).filter((F.col("availability_date") <= F.col("query_known")) & (F.col("report_date") < F.col("query_date")))
    part = {f: F.abs(wt * (F.col(f) - F.col(f"q_{f}")) / F.col(f"std_{f}")) for f, wt in features.items()}
    distance = F.sqrt(sum(p * p for p in part.values()))
    found = pairs.withColumns({f"part_{f}": p for f, p in part.items()}).withColumn("distance", distance).filter("distance is not null")
    found = found.withColumn("similarity", 100 * F.exp(-F.col("distance") / F.col("rms")))
    nearest = Window.partitionBy(by).orderBy("distance", "report_date")
    return found.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k)


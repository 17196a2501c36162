"""Weekly positions and daily prices: the panel that everything else works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ROLES

INVERSE = ("ASIA", "EUROPE")


def tuesday(d: Column) -> Column:
    return F.date_add(F.date_trunc("week", d).cast("date"), 1)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their market: the columns of the panel only, joined to three dimensions."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    market = (
        read("supplier").select("s_suppkey", "s_nationkey")
        .join(read("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("market"))
    )
    role = F.when(F.col("l_returnflag") == "A", "spec").when(F.col("l_returnflag") == "N", "slow").otherwise("other")
    return read("lineitem").join(market, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "market",
        role.alias("role"),
        F.col("l_shipdate").cast("date").alias("date"),
        tuesday(F.col("l_shipdate")).alias("report_date"),
        (F.col("l_linestatus") == "O").alias("is_long"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def daily(rows: DataFrame) -> DataFrame:
    """Line items summed by market, role and day: all that positions and prices need of them."""
    side = lambda long: F.coalesce(F.sum(F.when(F.col("is_long") == long, F.col("quantity"))), F.lit(0.0))
    return rows.groupBy("market", "role", "date", "report_date").agg(
        side(True).alias("long"), side(False).alias("short"), F.sum("price").alias("price_sum"), F.count("price").alias("n_prices")
    )


def positions(days: DataFrame) -> DataFrame:
    """(market, role, report_date, long, short, open_interest); interest is the larger side of the week."""
    cells = days.groupBy("market", "role", "report_date").agg(F.sum("long").alias("long"), F.sum("short").alias("short"))
    week = cells.groupBy("market", "report_date").agg(F.greatest(F.sum("long"), F.sum("short")).alias("open_interest"))
    return cells.join(week, ["market", "report_date"]).select("market", "role", "report_date", "long", "short", "open_interest")


def with_residual(rows: DataFrame) -> DataFrame:
    """Adds the residual role: what the others leave of the open interest on each side, not below 0."""
    left = rows.groupBy("market", "report_date").agg(
        F.sum("long").alias("l"), F.sum("short").alias("s"), F.max("open_interest").alias("open_interest")
    )
    residual = left.select(
        "market",
        F.lit("residual").alias("role"),
        "report_date",
        F.greatest(F.col("open_interest") - F.col("l"), F.lit(0.0)).alias("long"),
        F.greatest(F.col("open_interest") - F.col("s"), F.lit(0.0)).alias("short"),
        "open_interest",
    )
    return rows.unionByName(residual)


def unpivot_participants(wide: DataFrame, participants: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Pairs of long and short columns as one row per participant; a missing position is 0."""
    pairs = [
        F.struct(F.lit(p).alias("participant"), F.coalesce(F.col(a).cast("long"), F.lit(0)).alias("long"), F.coalesce(F.col(b).cast("long"), F.lit(0)).alias("short"))
        for p, (a, b) in participants.items()
    ]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def prices(days: DataFrame) -> DataFrame:
    """(market, date, close): the day's mean price."""
    return days.groupBy("market", "date").agg(F.try_divide(F.sum("price_sum"), F.sum("n_prices")).alias("close"))


def roles_of(positions: DataFrame) -> DataFrame:
    """Participants as roles; of several sources of a week the first by name counts."""
    known = {p: r for report in ROLES.values() for p, r in report.items()}
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    rows = positions.withColumn("role", F.element_at(F.create_map(*pairs), F.col("participant")))
    one = F.min_by(F.struct(*[F.col(c).cast("double").alias(c) for c in ("long", "short", "open_interest")]), "source")
    return rows.groupBy("market", "role", "report_date").agg(one.alias("p")).select("market", "role", "report_date", "p.*")

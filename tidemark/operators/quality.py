"""Data quality checks and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("market", "role")


def missing_weeks(rows: DataFrame, keys=KEYS, date_col: str = "report_date") -> DataFrame:
    """Gaps of more than one and less than three weeks between distinct dates."""
    days = rows.select(*keys, date_col).distinct()
    gap = F.datediff(date_col, F.lag(date_col).over(Window.partitionBy(*keys).orderBy(date_col)))
    return days.withColumn("gap_days", gap).filter("gap_days > 7 and gap_days < 21")


def duplicates(rows: DataFrame, keys) -> DataFrame:
    """All rows of keys that repeat."""
    return rows.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("copies > 1")


def jumps(rows: DataFrame, column: str = "open_interest", keys=KEYS, date_col: str = "report_date", limit: float = 3.5, least: int = 10) -> DataFrame:
    """Weekly changes far from the median in median deviations; without deviation, all that differ."""
    d = F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy(date_col))
    moved = rows.select(*keys, date_col, d.alias("diff")).filter("diff is not null")
    middle = moved.groupBy(*keys).agg(F.median("diff").alias("med"), F.count(F.lit(1)).alias("n"))
    away = moved.join(middle.filter(F.col("n") >= least), list(keys)).withColumn("off", F.abs(F.col("diff") - F.col("med")))
    spread = away.groupBy(*keys).agg(F.median("off").alias("mad"))
    scored = away.join(spread, list(keys)).withColumn("score", 0.6745 * (F.col("diff") - F.col("med")) / F.nullif(F.col("mad"), F.lit(0.0)))
    odd = F.when(F.col("mad") == 0, F.col("diff") != F.col("med")).otherwise(F.abs("score") > limit)
    return scored.filter(odd).select(*keys, date_col, "diff", "score")


def freshness(rows: DataFrame, as_of, keys=("market",), date_col: str = "availability_date", days: int = 14) -> DataFrame:
    age = F.datediff(F.lit(as_of).cast("date"), F.max(date_col))
    return rows.groupBy(*keys).agg(F.max(date_col).alias("newest"), age.alias("age_days")).withColumn("stale", F.col("age_days") > days)


def accounting_identity(rows: DataFrame, date_col: str = "report_date") -> DataFrame:
    """Weeks whose long or short sides don't add up to the open interest."""
    week = rows.groupBy("market", date_col).agg(F.sum("long").alias("long"), F.sum("short").alias("short"), F.max("open_interest").alias("open_interest"))
    return week.filter("long <> open_interest or short <> open_interest")


def signature(rows: DataFrame) -> str:
    return ",".join(sorted(rows.columns))


def findings(rows: DataFrame, as_of, role: str = "spec") -> DataFrame:
    """One row per market and check with the number of findings; jumps of the spec role."""
    checks = {
        "missing_weeks": missing_weeks(rows),
        "duplicates": duplicates(rows, (*KEYS, "report_date")),
        "jumps": jumps(rows.filter(F.col("role") == role)),
        "identity": accounting_identity(rows),
        "stale": freshness(rows, as_of).filter("stale"),
    }
    parts = [d.groupBy("market").agg(F.count(F.lit(1)).alias("n")).select("market", F.lit(name).alias("check"), "n") for name, d in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Both sides field by field: value of each, and ok, differs or missing."""
    a = left.select(*keys, F.struct(*fields).alias("__a"))
    b = right.select(*keys, F.struct(*fields).alias("__b"))
    both = a.join(b, keys, "full_outer")
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"__a.{f}").cast("double").alias("left_value"), F.col(f"__b.{f}").cast("double").alias("right_value")) for f in fields]
    status = (
        F.when(F.col("__a").isNull(), "missing_left").when(F.col("__b").isNull(), "missing_right")
        .when(F.col("left_value").eqNullSafe(F.col("right_value")), "ok").otherwise("differs")
    )
    return both.select(*keys, "__a", "__b", F.inline(F.array(*cells))).withColumn("status", status).drop("__a", "__b")


def reconcile_status(cells: DataFrame, by=("market",)) -> DataFrame:
    """BLOCKED without any common row, else FAIL with a difference, else PASS."""
    common = F.count_if(F.col("status").isin("ok", "differs"))
    bad = F.count_if(F.col("status") != "ok")
    return cells.groupBy(*by).agg(F.when(common == 0, "BLOCKED").when(bad > 0, "FAIL").otherwise("PASS").alias("result"), bad.alias("n_bad"))


def nearest_date(rows: DataFrame, wanted, date_col: str = "report_date", by: str = "market") -> DataFrame:
    d = F.abs(F.datediff(date_col, F.lit(wanted).cast("date")))
    return rows.groupBy(by).agg(F.min_by(date_col, F.struct(d, F.col(date_col))).alias("nearest"), F.min(d).alias("days"))


def resolve_contracts(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (code, match): the shortest contract name that holds the first alternative that is found at all.

    ``wanted`` is the registry, a fixed list, so the join by ``contains`` runs
    against a broadcast of it.
    """
    each = wanted.select("code", F.posexplode(F.split("match", r"\|")).alias("pos", "variant"))
    hits = names.select("name").distinct().join(F.broadcast(each), F.upper("name").contains(F.upper("variant")))
    best = Window.partitionBy("code").orderBy("pos", F.length("name"), "name")
    return hits.withColumn("place", F.row_number().over(best)).filter("place = 1").select("code", "name", "variant")


def loaded(rows: DataFrame, made_up: str = "synthetic") -> DataFrame:
    """One row on everything stored: how many sources and markets, and whether anything is made up."""
    return rows.agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("market").alias("n_markets"), F.coalesce(F.bool_or(F.col("source").startswith(made_up)), F.lit(False)).alias("any_made_up"))

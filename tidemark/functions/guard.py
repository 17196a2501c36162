"""Refusal of anything that looks ahead: it raises, it never filters silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME_PREFIX = "fwd_return_"


class LookaheadError(ValueError):
    """A row or feature wasn't known at the time of the analysis."""


def to_date_or_null(text: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(text.cast("string")), 1, 10), "yyyy-MM-dd")


def available(rows: DataFrame, as_of, date_col: str = "availability_date") -> DataFrame:
    """Explicit filter: rows public by ``as_of``; unknown dates go."""
    return rows.filter(F.col(date_col) <= F.lit(as_of).cast("date"))


def known_at(available_at: Column, as_of, confidence: Column | None = None) -> Column:
    """Whether a value was known: never without a date or with an unknown confidence."""
    known = F.coalesce(available_at <= F.lit(as_of).cast("date"), F.lit(False))
    return known if confidence is None else known & F.coalesce(F.upper(confidence) != "UNKNOWN", F.lit(False))


def violations(rows: DataFrame, as_of, date_col: str = "availability_date") -> DataFrame:
    """One row: rows in all, in the future, and of unknown date."""
    d = to_date_or_null(F.col(date_col))
    limit = F.lit(as_of).cast("date")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(d > limit).alias("n_future"),
        F.count_if(d.isNull()).alias("n_unknown"),
    )


def report(rows: DataFrame, as_of, date_col: str = "availability_date") -> dict:
    """The counts of ``violations`` for a log, and whether there are any."""
    found = violations(rows, as_of, date_col).first().asDict()
    return {"as_of": str(as_of), **found, "ok": not (found["n_future"] or found["n_unknown"])}


def assert_available(rows: DataFrame, as_of, date_col: str = "availability_date", allow_unknown: bool = False) -> DataFrame:
    """``rows``, or LookaheadError if one is in the future or (unless allowed) of unknown date."""
    if date_col not in rows.columns:
        return rows
    found = violations(rows, as_of, date_col).first()
    if found.n_future or (found.n_unknown and not allow_unknown):
        raise LookaheadError(f"{found.n_future} rows after {as_of}, {found.n_unknown} of unknown date in {date_col}")
    return rows


def checked(rows: DataFrame, as_of, date_col: str = "availability_date") -> DataFrame:
    """Lazy form: the query itself fails on the first row from the future."""
    late = F.col(date_col).isNull() | (F.col(date_col) > F.lit(as_of).cast("date"))
    return rows.filter(F.when(late, F.raise_error(F.lit(f"row not public by {as_of}")).cast("boolean")).otherwise(F.lit(True)))


def assert_not_outcomes(features) -> None:
    bad = [f for f in features if f.startswith(OUTCOME_PREFIX)]
    if bad:
        raise LookaheadError(f"outcomes used as features: {bad}")

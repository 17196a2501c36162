"""When a weekly report becomes public."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published schedule covers the Fridays of this year; these were moved.
SCHEDULE_YEAR = 2026
MOVED = {
    date(2026, 1, 2): date(2026, 1, 5),
    date(2026, 6, 19): date(2026, 6, 22),
    date(2026, 7, 3): date(2026, 7, 6),
    date(2026, 11, 13): date(2026, 11, 16),
    date(2026, 11, 27): date(2026, 11, 30),
    date(2026, 12, 25): date(2026, 12, 28),
}


def published() -> dict[date, date]:
    """Release date by report date (the Tuesday before the Friday that is scheduled)."""
    first = date(SCHEDULE_YEAR, 1, 1)
    fridays = [d for d in (first + timedelta(days=k) for k in range(366)) if d.weekday() == 4 and d.year == SCHEDULE_YEAR]
    return {d - timedelta(days=3): MOVED.get(d, d) for d in fridays}


#: Report dates whose release was delayed by a lapse.
LAPSE = ("2025-09-23", "2025-12-30")


def longest_delay() -> int:
    """Days from a report's date to when it may have come at the latest: the whole lapse and a usual wait."""
    first, last = map(date.fromisoformat, LAPSE)
    return (last - first).days + 7


def friday_on_or_after(d: Column) -> Column:
    return F.next_day(F.date_sub(d, 1), "FRI")


def is_holiday(d: Column) -> Column:
    """US holidays of fixed date and of fixed weekday; no shifts for weekends."""
    month, day, monday, thursday = F.month(d), F.dayofmonth(d), F.weekday(d) == 0, F.weekday(d) == 3
    fixed = F.date_format(d, "MM-dd").isin("01-01", "06-19", "07-04", "11-11", "12-25")
    third = monday & month.isin(1, 2) & day.between(15, 21)
    last_may = monday & (month == 5) & (day >= 25)
    first_september = monday & (month == 9) & (day <= 7)
    fourth_november = thursday & (month == 11) & day.between(22, 28)
    return fixed | third | last_may | first_september | fourth_november


def derived_availability(report_date: Column) -> Column:
    """Friday on or after the third day, a calendar day later on a holiday."""
    friday = friday_on_or_after(F.date_add(report_date, 3))
    return F.when(is_holiday(friday), F.date_add(friday, 1)).otherwise(friday)


def with_availability(rows: DataFrame, date_col: str = "report_date") -> DataFrame:
    """Adds availability_date, availability_source and availability_warning.

    The schedule is a fixed list of a few dozen dates, so it is a constant map.
    """
    pairs = [F.lit(x) for pair in published().items() for x in pair]
    d = F.col(date_col)
    known = F.element_at(F.create_map(*pairs), d)
    return rows.withColumns(
        {
            "availability_date": F.coalesce(known, derived_availability(d)),
            "availability_source": F.when(known.isNotNull(), "published_schedule").otherwise("derived_rule"),
            "availability_warning": known.isNull() & d.between(F.lit(LAPSE[0]).cast("date"), F.lit(LAPSE[1]).cast("date")),
        }
    )

"""Date arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(_c(end), _c(start))


def years_between(start: Column | str, end: Column | str) -> Column:
    return days_between(start, end) / F.lit(DAYS_PER_YEAR)


def age_at(year_of_birth: Column | str, on: str) -> Column:
    """Whole years of 365.25 days since 1 January of the birth year."""
    birthday = F.make_date(_c(year_of_birth), F.lit(1), F.lit(1))
    return F.floor(years_between(birthday, F.to_date(F.lit(on))))


def age_in_year(year_of_birth: Column | str, year: int) -> Column:
    return F.lit(year) - _c(year_of_birth)


def lookback_window(days_before: Column, open_ended: bool) -> Column:
    """Window label of an event ``days_before`` the index date, null outside all windows."""
    label = F.when(days_before.between(1, 30), "1to30").when(
        days_before.between(31, 180), "31to180"
    )
    return label.when(days_before > 180, "+181") if open_ended else label


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x

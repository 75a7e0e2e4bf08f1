"""Calendar parts, look-back windows and leap days. The as-of date is always an argument, never today."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_label(d: Column) -> Column:
    """Three-letter month name."""
    return F.date_format(d, "MMM")


def month_floor(d: Column) -> Column:
    return F.trunc(d, "month").cast("date")


def months_old(d: Column, as_of: Column) -> Column:
    """Whole months between two month starts, as a double."""
    return F.months_between(month_floor(as_of), month_floor(d)).cast("double")


def within_years(d: Column, as_of: Column, years: int) -> Column:
    """True for dates on or after the as-of month, ``years`` back."""
    return d >= F.add_months(month_floor(as_of), F.lit(-12 * years))


def is_leap_day(d: Column) -> Column:
    return (F.month(d) == 2) & (F.dayofmonth(d) == 29)


def is_leap_year(d: Column) -> Column:
    y = F.year(d)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def merge_leap_day(d: Column) -> Column:
    """29 February becomes 28 February."""
    return F.when(is_leap_day(d), F.date_sub(d, 1)).otherwise(d)


def leap_yday(d: Column, first_shifted: int = 61) -> Column:
    """Day of year with the leap day folded in: in leap years days from ``first_shifted`` on move back by one.

    61 keeps 29 February as day 60; 60 moves it onto day 59.
    """
    y = F.dayofyear(d)
    return F.when(is_leap_year(d) & (y >= first_shifted), y - 1).otherwise(y)

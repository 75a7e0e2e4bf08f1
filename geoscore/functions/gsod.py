"""Fields of the daily-summary text format: flags, precipitation periods, indicators, sentinels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values of the format.
FLAG_LETTERS = "ABCDEFGHI*"
PRECIP_HOURS = {"A": 6, "B": 12, "C": 18, "D": 24, "E": 12, "F": 24, "G": 24, "H": 1, "I": 1}
WEATHER_BITS = ("fog", "rain", "snow", "hail", "thunder", "tornado")


def strip_flags(c: Column) -> Column:
    """Number without its flag letters; NULL when nothing numeric is left."""
    return F.translate(c, FLAG_LETTERS, "").try_cast("double")


def precip_hours(c: Column, default: int | None = 1) -> Column:
    """Hours covered by a precipitation report, from its letter (first letter of the list wins)."""
    hours = F.when(F.contains(c, F.lit("A")), PRECIP_HOURS["A"])
    for letter, value in PRECIP_HOURS.items():
        hours = hours.when(F.contains(c, F.lit(letter)), value)
    return hours.otherwise(F.lit(default).cast("int"))


def weather_bits(c: Column, prefix: str = "is_") -> dict[str, Column]:
    """Six one-character indicators as 0/1 columns."""
    return {prefix + bit: F.substring(c, i + 1, 1).try_cast("int") for i, bit in enumerate(WEATHER_BITS)}


def sentinel_to_null(c: Column, missing: float | Sequence[float]) -> Column:
    """NULL for a field's own missing-value codes."""
    for value in [missing] if isinstance(missing, (int, float)) else missing:
        c = F.nullif(c, F.lit(float(value)))
    return c


def zero_if_dry(amount: Column, bit: Column) -> Column:
    """A missing amount is 0 only where its indicator says there was none."""
    return F.when(amount.isNull() & (bit == 0), F.lit(0.0)).otherwise(amount)


def hourly_rate(amount: Column, hours: Column) -> Column:
    return F.try_divide(amount, hours)

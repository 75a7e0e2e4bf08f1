"""Thresholds and classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def labelled(c: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower limit the value reaches; NULL falls to ``otherwise``."""
    out = F.when(c >= F.lit(steps[0][0]), F.lit(steps[0][1]))
    for limit, label in steps[1:]:
        out = out.when(c >= F.lit(limit), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def fixed_breaks(c: Column, breaks: Sequence[float]) -> Column:
    """Number of the half-open class [b(i), b(i+1)) a value falls in, from 1; the last class is closed.

    NULL outside the breaks.
    """
    inside = (c >= F.lit(float(breaks[0]))) & (c <= F.lit(float(breaks[-1])))
    passed = F.lit(1)
    for b in breaks[1:-1]:
        passed = passed + F.when(c >= F.lit(float(b)), 1).otherwise(0)
    return F.when(inside, passed)


def flag(condition: Column) -> Column:
    """1/0, NULL where the condition is unknown."""
    return condition.cast("int")


def round_even(c: Column, digits: int = 0) -> Column:
    """Halves to even, on the scaled double itself."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale) if digits else F.rint(c)


def ordinal(c: Column, levels: Sequence[str], reverse: bool = False) -> Column:
    """Position of a category in its ordered levels, from 1; NULL for any other value."""
    ordered = list(reversed(levels)) if reverse else list(levels)
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in ordered]), c), F.lit(0)).cast("int")


def adjusted_price(price: Column, days: Column, year: int = 365) -> Column:
    """Price per pleasant day, scaled to a year."""
    return F.try_divide(price * F.lit(year), days)

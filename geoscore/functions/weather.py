"""Felt temperature, daily temperature curve and degree days."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from geoscore.functions.binning import round_even


def to_fahrenheit(c: Column) -> Column:
    return round_even(F.lit(1.8) * c + F.lit(32.0), 2)


def to_celsius(f: Column) -> Column:
    return round_even((f - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0), 2)


def heat_index(temp: Column, rh: Column) -> Column:
    """Heat index in Celsius by the published National Weather Service formula; NULL for humidity outside 0-100."""
    t = to_fahrenheit(temp)
    simple = F.lit(0.5) * (F.lit(61.0) + (t - 68.0) * 1.2 + rh * 0.094 + t)
    # Fixed values of the published regression and its two adjustments, gathered by powers of the temperature.
    constant = F.lit(-42.379) + rh * (F.lit(10.14333127) - 5.481717e-2 * rh)
    linear = F.lit(2.04901523) + rh * (F.lit(-0.22475541) + 8.5282e-4 * rh)
    square = F.lit(-6.83783e-3) + rh * (F.lit(1.22874e-3) - 1.99e-6 * rh)
    full = constant + t * (linear + t * square)
    dry = (13.0 - rh) / 4.0 * F.sqrt(F.greatest((17.0 - F.abs(t - 95.0)) / 17.0, F.lit(0.0)))
    damp = (rh - 85.0) / 10.0 * ((87.0 - t) / 5.0)
    adjustment = F.when((rh <= 13) & t.between(80, 112), -dry).when((rh > 85) & t.between(80, 87), damp).otherwise(0.0)
    index = F.when(t <= 40, t).when(simple > 79, full + adjustment).otherwise(simple)
    return F.when(rh.between(0, 100), to_celsius(index))


def wind_chill(temp: Column, wind: Column) -> Column:
    """Wind chill in Celsius; the published formula, wind taken in the unit it comes in."""
    t, w = to_fahrenheit(temp), F.pow(wind, F.lit(0.16))
    return to_celsius(F.lit(35.74) + 0.6215 * t - 35.75 * w + 0.4275 * t * w)


def feels_like(temp: Column, rh: Column, wind: Column) -> Column:
    """Chill below 10 with wind over 3, heat index above 27, else the temperature itself."""
    return (
        F.when((temp < 10) & (wind > 3), wind_chill(temp, wind))
        .when(temp > 27, F.when(rh.isNull(), temp).otherwise(heat_index(temp, rh)))
        .otherwise(temp)
    )


def day_curve(low: Column, high: Column, hour: Column) -> Column:
    """Temperature at an hour of a day that swings from its low at midnight to its high at noon."""
    amplitude = (high - low) / 2
    return low + amplitude - amplitude * F.cos(hour * F.lit(2 * math.pi) / 24)


def _excess(low: Column, high: Column, base: float) -> tuple[Column, Column]:
    """Mean excess over and shortfall under the base: the closed form of the integral of the day curve."""
    b = F.lit(float(base))
    a = (high - low) / 2
    mid = low + a - b
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(mid, a)))
    theta = F.acos(ratio)
    crossing_hot = (mid * (F.lit(math.pi) - theta) + a * F.sin(theta)) / math.pi
    none = F.lit(None).cast("double")
    unknown = low.isNull() | high.isNull()
    hot = F.when(unknown, none).when(low >= b, mid).when(high <= b, F.lit(0.0)).otherwise(crossing_hot)
    cold = F.when(unknown, none).when(low >= b, F.lit(0.0)).when(high <= b, -mid).otherwise(crossing_hot - mid)
    return hot, cold


def excess_degree_days(low: Column, high: Column, base: float = 18.0) -> Column:
    """Mean daily excess over (hot) and shortfall under (cold) a base temperature, as a struct.

    Each figure is rounded on its own, so the total may differ from the sum by a hundredth.
    """
    hot, cold = _excess(low, high, base)
    return F.struct(
        round_even(hot, 2).alias("edd_hot"), round_even(cold, 2).alias("edd_cold"),
        round_even(hot + cold, 2).alias("edd_total"),
    )


def excess_degree_hours(low: Column, high: Column, base: float = 18.0) -> Column:
    """Area between the day curve and the base over the 24 hours (the older, total-only figure)."""
    hot, cold = _excess(low, high, base)
    return round_even((hot + cold) * 24, 2)

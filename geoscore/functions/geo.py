"""Coordinates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6378.137  # fixed value: the equatorial radius


def _between_minus_one_and_one(c: Column) -> Column:
    # greatest and least pass over NULL.
    return F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance; NULL where a coordinate is unknown, NaN or infinite."""
    lat1, lon1, lat2, lon2 = (finite(c) for c in (lat1, lon1, lat2, lon2))
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * radius) * F.asin(_between_minus_one_and_one(F.sqrt(h)))


def unit_vector(lat: Column, lon: Column) -> dict[str, Column]:
    """Point on the unit sphere; straight-line order there is great-circle order, date line and poles included."""
    phi, lam = F.radians(lat), F.radians(lon)
    return {"_x": F.cos(phi) * F.cos(lam), "_y": F.cos(phi) * F.sin(lam), "_z": F.sin(phi)}


def snap(c: Column, step: float = 1.0) -> Column:
    """Nearest multiple of ``step``, halves to even."""
    return F.rint(c / F.lit(step)) * F.lit(step)


def shifted(lat: Column, lon: Column, condition: Column, dlat: float, dlon: float) -> tuple[Column, Column]:
    """Move the points that meet a condition, for display."""
    return (
        F.when(condition, lat + F.lit(dlat)).otherwise(lat),
        F.when(condition, lon + F.lit(dlon)).otherwise(lon),
    )


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (xmin, ymin, xmax, ymax), edges included."""
    xmin, ymin, xmax, ymax = box
    return lon.between(xmin, xmax) & lat.between(ymin, ymax)

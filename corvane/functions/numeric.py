"""Numeric functions of the ranking features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def log_share(count: Column, most: Column) -> Column:
    """log1p(count) over log1p of the largest count; 0 without any."""
    return F.when(most > 0, F.log1p(count.cast("double")) / F.log1p(most.cast("double"))).otherwise(0.0)


def smoothed(hits: Column, n: Column, mean: Column, weight: float) -> Column:
    return (hits + weight * mean) / (n + weight)


def clipped_log(c: Column, most: float | None = None) -> Column:
    """log1p of a value held to at least 0 and at most `most`; null stays null."""
    low = F.greatest(c.cast("double"), F.lit(0.0))
    return F.when(c.isNotNull(), F.log1p(low if most is None else F.least(low, F.lit(most))))


def number(c: Column) -> Column:
    """What is no number becomes null."""
    return c.try_cast("double")


def log_distance_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """log1p of the great-circle distance of two places in degrees."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(b) * F.cos(a) * F.pow(F.sin((F.radians(lon_a) - F.radians(lon_b)) / 2), 2)
    clipped = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return F.when(h.isNotNull(), F.log1p(EARTH_KM * 2 * F.asin(F.sqrt(clipped))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))

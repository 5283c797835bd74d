"""Coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth.
EARTH_M = 6_371_008.8


def valid(lat: Column, lon: Column) -> Column:
    """Finite, in range and not the origin; null is not valid."""
    there = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(there & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

"""Coordinates and distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def valid(lat: Column, lon: Column) -> Column:
    """Whether both are present and within ±90 and ±180."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is missing or invalid."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    km = 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    return F.when(valid(lat1, lon1) & valid(lat2, lon2), km)

"""Column functions on positions in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = EARTH_KM * 3.141592653589793 / 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; null if any coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def usable(lat: Column, lon: Column, lat_range: tuple[float, float] = (33.0, 43.0), lon_range: tuple[float, float] = (124.0, 132.0)) -> Column:
    """True where both coordinates are present and inside the ranges; never null (NaN is not inside)."""
    ok = lat.between(*lat_range) & lon.between(*lon_range)
    return F.coalesce(ok, F.lit(False))

"""Column functions on coordinates (degrees) and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE = 111320.0
LEAST_RADIUS_M, RADIUS_SHARE = 1500.0, 0.75


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is null, NaN or infinite. The inner value is held to 1, so that
    antipodes give no NaN."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    # a null stays null, as least() would not let it; NaN counts as larger than all numbers and goes first
    a = F.when(F.isnan(a), None).when(a > 1, 1.0).otherwise(a)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def destination(lat: Column, lon: Column, bearing_deg: Column, distance_m: Column) -> tuple[Column, Column]:
    """(lat, lon) at a bearing (0 north, 90 east) and distance, on a flat approximation."""
    turn = F.radians(bearing_deg)
    return (
        lat + distance_m * F.cos(turn) / METRES_PER_DEGREE,
        lon + distance_m * F.sin(turn) / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))),
    )


def search_bounds(target_km: Column, tolerance: float = 0.3) -> dict[str, Column]:
    """radius_m of the network to look at, and the least and largest accepted length."""
    return {
        "radius_m": F.greatest(target_km * 1000 * RADIUS_SHARE, F.lit(LEAST_RADIUS_M)),
        "min_km": target_km * (1 - tolerance),
        "max_km": target_km * (1 + tolerance),
    }


def grade_pct(gain_m: Column, km: Column) -> Column:
    """Average grade; null where the distance is 0."""
    return F.try_divide(gain_m, km * 1000) * 100


def grade_band(grade: Column) -> Column:
    return F.when(grade < 2, "flat").when(grade < 5, "rolling").when(grade < 8, "hilly").otherwise(F.when(grade.isNotNull(), "challenging"))

"""Column expressions on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
#: Coefficients of the law between spacing in km and number of points on the sphere.
LAW_LOG, LAW_POWER = 20.0165958, 2.01155176


def wrap_lon(lon: Column) -> Column:
    return F.expr("0") + F.pmod(lon + 180, F.lit(360.0)) - 180


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 1.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def to_xyz(lon: Column, lat: Column, r: float = 1.0) -> tuple[Column, Column, Column]:
    lo, la = F.radians(lon), F.radians(lat)
    return r * F.cos(lo) * F.cos(la), r * F.sin(lo) * F.cos(la), r * F.sin(la)


def to_lon_lat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(z))


def in_box(lon: Column, lat: Column, lons: tuple[float, float], lats: tuple[float, float], dateline: bool = False) -> Column:
    across = (lon >= lons[0]) | (lon <= lons[1]) if dateline else lon.between(*lons)
    return across & lat.between(*lats)


def num_points(spacing_km: float) -> int:
    return int(math.exp(LAW_LOG) * spacing_km**-LAW_POWER)


def spacing_km(n: int) -> float:
    return (math.exp(LAW_LOG) / n) ** (1 / LAW_POWER)


def degree_km(step: float, radius: float = RADIUS_KM) -> float:
    return 2 * radius * math.asin(math.sin(math.radians(step) / 2))


def kernel_width(step: float, neighbours: int = 1, radius: float = RADIUS_KM) -> float:
    """Kernel width of a grid of `step` degrees in radians: so many times its spacing at the equator."""
    return neighbours * degree_km(step, radius) / radius

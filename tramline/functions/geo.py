"""Positions on the globe as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees; the root's argument is held at 1 for antipodes."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, 0 to 360 degrees from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_difference(a: Column, b: Column) -> Column:
    """b - a in degrees, wrapped to -180 .. 180."""
    return F.pmod(b - a + 540, F.lit(360.0)) - 180


def plausible_fix(lat: Column, lon: Column, accuracy: Column, max_accuracy: float = 75.0) -> Column:
    """Whether a fix lies on the globe with a known accuracy that is good enough."""
    return lat.between(-90, 90) & lon.between(-180, 180) & accuracy.between(0, max_accuracy)


def to_kmh(mps: Column) -> Column:
    return mps * 3.6


def deg_per_metre() -> float:
    return 180.0 / (math.pi * EARTH_M)


def frame_widths_per_second(px_per_second: Column, width: Column) -> Column:
    return F.when(width > 0, px_per_second / width)

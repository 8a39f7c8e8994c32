"""Great-circle geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0  # fixed value


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres; the root is clamped so antipodes never leave asin's domain."""
    half_lat = F.radians(lat2 - lat1) / F.lit(2.0)
    half_lon = F.radians(lon2 - lon1) / F.lit(2.0)
    chord = (F.pow(F.sin(half_lat), F.lit(2.0))
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2.0)))
    root = F.sqrt(chord)  # a null stays null, which least() would not allow
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.when(root > 1.0, F.lit(1.0)).otherwise(root))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                signed: bool = False) -> Column:
    """Initial bearing: [0, 360) by default, (-180, 180] when ``signed``."""
    p1, p2, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(turn)
    angle = F.degrees(F.atan2(east, north))
    return angle if signed else F.pmod(angle + F.lit(360.0), F.lit(360.0))

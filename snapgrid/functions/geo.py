"""Distances on the sphere as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180.0
FOOT_M = 0.3048

# Two distances that differ by less than this are the same distance. It absorbs
# the last-bit differences between math libraries, so ties do not depend on them.
DISTANCE_DIGITS = 6


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between two points given in degrees."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def segment_distance_m(
    lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column
) -> Column:
    """Distance in metres from a point to the segment a-b.

    The segment is laid out in metres around the point and the point is projected
    on it; the foot is clamped to the segment. A zero-length segment is its end.
    """
    per_lon = F.cos(F.radians(lat)) * METRES_PER_DEGREE
    ax, ay = (a_lon - lon) * per_lon, (a_lat - lat) * METRES_PER_DEGREE
    dx, dy = (b_lon - a_lon) * per_lon, (b_lat - a_lat) * METRES_PER_DEGREE
    along = F.try_divide(-(ax * dx + ay * dy), F.pow(dx, 2) + F.pow(dy, 2))
    along = F.coalesce(along, F.lit(0.0))
    along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(ax + along * dx, 2) + F.pow(ay + along * dy, 2))

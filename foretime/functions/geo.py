"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretime.functions.scalar import col

EARTH_RADIUS_KM = 6371.0088


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = (b - a) / 2
    half_lon = (F.radians(col(lon2)) - F.radians(col(lon1))) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_KM)

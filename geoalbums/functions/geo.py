"""Positions: validity, distance, boxes and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371  # fixed value


def is_valid_position(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def has_geo_both(lat: Column, lon: Column) -> Column:
    """Both axes known: what album breaks and place lookup ask for."""
    return (lat != 0) & (lon != 0)


def has_geo_any(lat: Column, lon: Column) -> Column:
    """At least one axis known: what imputation and the gazetteer prefilter ask for."""
    return (lat != 0) | (lon != 0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def cell(coordinate: Column, size: float | Column) -> Column:
    return F.floor(coordinate / (size if isinstance(size, Column) else F.lit(size)))


def cells_in_reach(coordinate: Column, size: float | Column) -> Column:
    """Cells whose points may have `coordinate` in their box of `size`, as an array.

    The reach is a hair wider than the box: the box is computed around the point and these
    cells around the place, and the two may round differently at the very edge.
    """
    reach = size * 1.000001
    return F.sequence(cell(coordinate - reach, size), cell(coordinate + reach, size))


def within_box(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column, size: float) -> Column:
    """Inclusive degree box around the centre; no wrap at the date line, no cosine correction."""
    return lat.between(centre_lat - size, centre_lat + size) & lon.between(
        centre_lon - size, centre_lon + size
    )

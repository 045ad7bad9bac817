"""Distances, boxes and grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres.
EARTH_RADIUS, KM_PER_LAT, KM_PER_LON = 6371.0, 110.574, 111.320
CELL_WIDTH, CELL_HEIGHT, OVERLAP, ZOOM = 17.0, 14.0, 0.1, 12
DEFAULT_BOX = (48.8566, 2.2522, 48.9566, 2.4522)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def lat_degrees(km: float) -> float:
    return km / KM_PER_LAT


def lon_degrees(km: float, lat: Column) -> Column:
    return F.lit(km) / (F.cos(F.radians(lat)) * KM_PER_LON)


def box_around(lat: Column, lon: Column, bbox: Column) -> Column:
    """The given struct(min_lat, min_lon, max_lat, max_lon), or a square that reaches 1 km each way."""
    dlat, dlon = F.lit(lat_degrees(1.0)), lon_degrees(1.0, lat)
    own = F.struct((lat - dlat).alias("min_lat"), (lon - dlon).alias("min_lon"), (lat + dlat).alias("max_lat"), (lon + dlon).alias("max_lon"))
    return F.coalesce(bbox, own)


def geojson_point(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))))

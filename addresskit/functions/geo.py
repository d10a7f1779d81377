"""Coordinate functions: bounds, projection, distance, bearing, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
MERCATOR_R = 6378137.0

# The national bounding boxes used by the reference, by name
# (lat_min, lat_max, lon_min, lon_max).
BOUNDS = {
    "load": (-55.0, -5.0, 95.0, 170.0),
    "parser": (-45.0, -8.0, 110.0, 155.0),
    "quality": (-45.0, -10.0, 110.0, 155.0),
    "ddl": (-55.0, -9.0, 96.0, 169.0),
    "migration": (-45.0, -10.0, 110.0, 155.0),
    "api": (-43.7, -9.0, 112.0, 154.0),
}


def in_bounds(lat: Column, lon: Column, preset: str = "load") -> Column:
    """inclusive box test; null or NaN coordinates fail."""
    a, b, c, d = BOUNDS[preset]
    return (
        lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
        & lat.between(a, b) & lon.between(c, d)
    )


def in_world(lat: Column, lon: Column) -> Column:
    """finite and inside +-90 / +-180."""
    return (
        lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
        & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    )


def mercator_x(lon: Column) -> Column:
    """EPSG:3857 easting in metres."""
    return F.lit(MERCATOR_R) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    """EPSG:3857 northing in metres."""
    return F.lit(MERCATOR_R) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, R = 6 371 000."""
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0..360."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def round_half_up(x: Column, digits: int) -> Column:
    """JavaScript Math.round semantics at ``digits`` decimals: floor(x*10^d + 0.5)/10^d."""
    m = 10.0**digits
    return F.floor(x * m + 0.5) / m


def grid_cell(v: Column, side: float | Column) -> Column:
    """Integer cell index of a planar coordinate."""
    return F.floor(v / side).cast("long")


def snap_cell(deg: Column, step: float = 0.01) -> Column:
    """Integer index of the nearest multiple of ``step`` degrees."""
    return F.round(deg / F.lit(step)).cast("long")

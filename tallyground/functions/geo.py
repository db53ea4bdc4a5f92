"""Spherical geometry on Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0


def angles(lat: str, lon: str) -> dict[str, Column]:
    """``phi`` and ``lam``: a position in degrees as radians."""
    return {"phi": F.radians(lat), "lam": F.radians(lon)}


def haversine(phi1: Column, lam1: Column, phi2: Column, lam2: Column) -> Column:
    """Great-circle distance in radians between two points given in radians."""
    h = F.pow(F.sin((phi2 - phi1) / 2), F.lit(2.0)) + F.cos(phi1) * F.cos(phi2) * F.pow(
        F.sin((lam2 - lam1) / 2), F.lit(2.0)
    )
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def coordinates_ok(lat: Column, lon: Column) -> Column:
    """Present, finite and on the globe. BETWEEN is false for NaN and infinities, NULL counts as false."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def web_mercator_x(lon: Column) -> Column:
    return EARTH_RADIUS_M * F.radians(lon)


def web_mercator_y(lat: Column) -> Column:
    return EARTH_RADIUS_M * F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2))

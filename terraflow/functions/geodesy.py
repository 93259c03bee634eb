"""Map projections and local metric frames as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the UTM grid constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
SCALE_ON_MERIDIAN = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

# Third flattening, and the transverse Mercator series in it up to n**4
# (Krueger's formulas, coefficients as published).
N = FLATTENING / (2.0 - FLATTENING)
RECTIFYING_RADIUS = SEMI_MAJOR / (1.0 + N) * (1.0 + N**2 / 4.0 + N**4 / 64.0)
ECCENTRICITY = 2.0 * math.sqrt(N) / (1.0 + N)
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)

# Metres per degree used for cell sizes, kilometres per degree used for path
# lengths, and the sphere radius of the local metric frame.
METRES_PER_DEGREE_X = 111320.0
METRES_PER_DEGREE_Y = 110540.0
KM_PER_DEGREE = 111.32
SPHERE_RADIUS = 6371000.0


def utm_zone(lon: Column) -> Column:
    """Zone number 1..60 of a longitude, null for none."""
    return F.when(lon.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(60), (F.floor((lon + 180.0) / 6.0) + 1).cast("int"))))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the local UTM grid."""
    return utm_zone(lon) + F.when(lat >= 0, F.lit(32600)).when(lat < 0, F.lit(32700))


def _central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6 - 183)


def utm_forward(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Degrees to (easting, northing) on the grid ``epsg`` (326zz or 327zz)."""
    zone = epsg % 100
    phi = F.radians(lat)
    lam = F.radians(lon) - _central_meridian(zone)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = SCALE_ON_MERIDIAN * RECTIFYING_RADIUS
    shift = F.when(epsg >= 32700, F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    return east * k + FALSE_EASTING, north * k + shift


def utm_inverse(easting: Column, northing: Column, epsg: Column) -> tuple[Column, Column]:
    """(easting, northing) on the grid ``epsg`` back to (lon, lat) degrees."""
    k = SCALE_ON_MERIDIAN * RECTIFYING_RADIUS
    shift = F.when(epsg >= 32700, F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    xi = (northing - shift) / k
    eta = (easting - FALSE_EASTING) / k
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lam + _central_meridian(epsg % 100)), F.degrees(phi)


def equirect_xy(lon: Column, lat: Column, lat0: Column) -> tuple[Column, Column]:
    """Degrees to local metres around latitude ``lat0``."""
    return (
        SPHERE_RADIUS * F.cos(F.radians(lat0)) * F.radians(lon),
        SPHERE_RADIUS * F.radians(lat),
    )


def equirect_lonlat(x: Column, y: Column, lat0: Column) -> tuple[Column, Column]:
    """Local metres around latitude ``lat0`` back to degrees."""
    return (
        F.degrees(x / (SPHERE_RADIUS * F.cos(F.radians(lat0)))),
        F.degrees(y / SPHERE_RADIUS),
    )


def mid_latitude(north: Column, height: Column, res_y: Column) -> Column:
    """Latitude half way down a raster."""
    return north - height * res_y / 2.0


def cell_metres(res_x: Column, res_y: Column, mid_lat: Column) -> tuple[Column, Column]:
    """Metres per cell, both ways."""
    return (
        F.abs(res_x) * METRES_PER_DEGREE_X * F.cos(F.radians(mid_lat)),
        F.abs(res_y) * METRES_PER_DEGREE_Y,
    )


def cell_km(res_x: Column, res_y: Column, mid_lat: Column) -> tuple[Column, Column]:
    """Kilometres per cell as used for path lengths."""
    return (
        F.abs(res_x) * KM_PER_DEGREE * F.cos(F.radians(mid_lat)),
        F.abs(res_y) * KM_PER_DEGREE,
    )

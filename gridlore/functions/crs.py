"""Transverse Mercator on WGS84 by Krüger's series to the fourth order, as column expressions.

Null coordinates give null; the error stays far under a millimetre within a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM grid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
#: The length of the grid's unit of arc.
ARC = SCALE * SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)
FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
BACKWARD = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def central_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """East and north in metres of the zone's grid (north counted from 10,000 km on the southern half)."""
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(FORWARD, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + ARC * east, F.when(lat < 0, FALSE_NORTH).otherwise(0.0) + ARC * north


def local_frame(lat: Column, lon: Column, zone: Column, south: Column, west: Column) -> tuple[Column, Column]:
    """Metres east and north of a window's south-west corner in the zone's grid."""
    east, north = to_utm(lat, lon, zone)
    east0, north0 = to_utm(south, west, zone)
    return east - east0, north - north0


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    x, y = (north - F.when(south, FALSE_NORTH).otherwise(0.0)) / ARC, (east - FALSE_EAST) / ARC
    xi, eta = x, y
    for j, b in enumerate(BACKWARD, 1):
        xi = xi - b * F.sin(2 * j * x) * F.cosh(2 * j * y)
        eta = eta - b * F.cos(2 * j * x) * F.sinh(2 * j * y)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(LATITUDE, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), central_meridian(zone) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))

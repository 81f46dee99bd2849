"""Coordinates and distances as Column expressions; they stay inside whole-stage code generation."""

from __future__ import annotations

from math import pi, radians, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The GRS80 ellipsoid and the parameters of SWEREF 99 TM.
_A, _F = 6378137.0, 1 / 298.257222101
_K0, _FALSE_EASTING, _LON0 = 0.9996, 500000.0, 15.0
#: Fixed value: mean Earth radius in metres.
EARTH_RADIUS = 6371008.8
#: Metres for a degree of longitude at the equator, and of latitude.
DEGREE_LON, DEGREE_LAT = 111320.0, 110540.0

_N = _F / (2 - _F)
_E2 = _F * (2 - _F)
_E = sqrt(_E2)
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Series of Krueger to the fourth order.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def to_sweref(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in SWEREF 99 TM of a position in degrees."""
    phi, away = F.radians(lat), F.radians(lon) - radians(_LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    scale = _K0 * _RECTIFYING
    return F.lit(_FALSE_EASTING) + east * scale, north * scale


def with_wgs84(df: DataFrame, x: str, y: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with longitude and latitude in degrees of a position in SWEREF 99 TM.

    Newton's steps use each value several times, so they are columns of their own: as one expression they would
    multiply with every step.
    """
    scale = _K0 * _RECTIFYING
    xi0, eta0 = F.col(y) / scale, (F.col(x) - _FALSE_EASTING) / scale
    df = df.withColumns({"_xi0": xi0, "_eta0": eta0})
    xi, eta = F.col("_xi0"), F.col("_eta0")
    for j, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(F.col("_xi0") * (2 * j)) * F.cosh(F.col("_eta0") * (2 * j))
        eta = eta - F.lit(b) * F.cos(F.col("_xi0") * (2 * j)) * F.sinh(F.col("_eta0") * (2 * j))
    df = df.withColumns({"_xi": xi, "_eta": eta})
    goal = F.sin("_xi") / F.sqrt(F.sinh("_eta") * F.sinh("_eta") + F.cos("_xi") * F.cos("_xi"))
    df = df.withColumn("_goal", goal).withColumn("_tau0", F.col("_goal"))
    for i in range(3):  # Newton's method for the tangent of the latitude
        tau = F.col(f"_tau{i}")
        df = df.withColumn(f"_root{i}", F.sqrt(1 + tau * tau))
        root = F.col(f"_root{i}")
        df = df.withColumn(f"_sigma{i}", F.sinh(F.lit(_E) * F.atanh(F.lit(_E) * tau / root)))
        sigma = F.col(f"_sigma{i}")
        df = df.withColumn(f"_here{i}", tau * F.sqrt(1 + sigma * sigma) - sigma * root)
        here = F.col(f"_here{i}")
        step = (F.col("_goal") - here) / F.sqrt(1 + here * here) * (1 + (1 - _E2) * tau * tau) / ((1 - _E2) * root)
        df = df.withColumn(f"_tau{i + 1}", tau + step)
    found = {lon: F.lit(_LON0) + F.degrees(F.atan2(F.sinh("_eta"), F.cos("_xi"))), lat: F.degrees(F.atan(F.col("_tau3")))}
    used = ["_xi0", "_eta0", "_xi", "_eta", "_goal", "_tau3", *[f"_{n}{i}" for i in range(3) for n in ("tau", "root", "sigma", "here")]]
    return df.withColumns(found).drop(*used)


def meridian_quarter() -> float:
    """Length of a quarter of a meridian, a check of the series."""
    return _RECTIFYING * pi / 2


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres on the WGS 84 ellipsoid by Lambert's formula: within a few parts in a million for street lengths."""
    a, f = 6378137.0, 1 / 298.257223563
    b1, b2 = (F.atan((1 - f) * F.tan(F.radians(v))) for v in (lat1, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    s = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    half = s / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q), 2) / F.nullif(F.pow(F.cos(half), 2), F.lit(0.0))
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q), 2) / F.nullif(F.pow(F.sin(half), 2), F.lit(0.0))
    return F.when(h == 0, F.lit(0.0)).otherwise(a * (s - f / 2 * (x + y)))


def equirectangular(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres on a plane that is right near the first position."""
    return F.hypot((lon2 - lon1) * DEGREE_LON * F.cos(F.radians(lat1)), (lat2 - lat1) * DEGREE_LAT)


def hypot(dx: Column, dy: Column) -> Column:
    """sqrt(dx² + dy²), written out so that other engines round alike."""
    return F.sqrt(dx * dx + dy * dy)


def position_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where, from 0 to 1, the nearest point of segment ab to p lies; 0 for a segment without length."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    along = F.try_divide((px - ax) * dx + (py - ay) * dy, F.nullif(square, F.lit(0.0)))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of point p from segment ab."""
    t = position_on_segment(px, py, ax, ay, bx, by)
    return hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))

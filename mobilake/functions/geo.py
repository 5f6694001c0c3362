"""Geodesy on columns. [M7-M10]"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilake.operators.spatial import haversine_m, in_box

__all__ = ["haversine_m", "in_box", "utm_to_lat", "utm_to_lon", "inside_polygons", "simplify"]

# GRS80 ellipsoid and the transverse Mercator scale of UTM.
_A, _F, _K0 = 6_378_137.0, 1 / 298.257222101, 0.9996


def _footpoint(x: Column, y: Column) -> dict[str, Column]:
    """Terms shared by latitude and longitude of the inverse transverse Mercator series."""
    e2 = _F * (2 - _F)
    n = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = y / _K0 / (_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = mu
    for k, c in enumerate((3 * n / 2 - 27 * n**3 / 32, 21 * n**2 / 16 - 55 * n**4 / 32, 151 * n**3 / 96, 1097 * n**4 / 512), 1):
        phi = phi + c * F.sin(2 * k * mu)
    s = 1 - e2 * F.pow(F.sin(phi), 2)
    return {
        "phi": phi,
        "ep": F.lit(e2 / (1 - e2)),
        "c": e2 / (1 - e2) * F.pow(F.cos(phi), 2),
        "t": F.pow(F.tan(phi), 2),
        "nu": _A / F.sqrt(s),
        "rho": _A * (1 - e2) / F.pow(s, 1.5),
        "d": (x - 500_000.0) / _K0 / (_A / F.sqrt(s)),
    }


def utm_to_lat(x: Column, y: Column) -> Column:
    """Latitude in degrees of a UTM position on the northern half. [M7]"""
    q = _footpoint(x, y)
    c, t, d, ep = q["c"], q["t"], q["d"], q["ep"]
    series = F.pow(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * F.pow(d, 6) / 720
    return F.degrees(q["phi"] - q["nu"] * F.tan(q["phi"]) / q["rho"] * series)


def utm_to_lon(x: Column, y: Column, zone: int = 30) -> Column:
    """Longitude in degrees of a UTM position. [M7]"""
    q = _footpoint(x, y)
    c, t, d, ep = q["c"], q["t"], q["d"], q["ep"]
    series = d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * F.pow(d, 5) / 120
    return F.degrees(series / F.cos(q["phi"])) + (zone * 6 - 183)


def inside_polygons(lat: Column, lon: Column, coordinates: Column) -> Column:
    """Even-odd test of a point against polygons > rings > [lon, lat], holes left out. [M9]

    For a handful of regions per row; for many points against many regions use
    operators.spatial.within.
    """

    def crossings(ring: Column) -> Column:
        n = F.size(ring)
        hits = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.when(
                (F.get(F.get(ring, i), F.lit(1)) > lat).eqNullSafe(F.get(F.get(ring, F.pmod(i + 1, n)), F.lit(1)) > lat),
                F.lit(0),
            ).when(
                lon < (F.get(F.get(ring, F.pmod(i + 1, n)), F.lit(0)) - F.get(F.get(ring, i), F.lit(0))) * F.try_divide(lat - F.get(F.get(ring, i), F.lit(1)), F.get(F.get(ring, F.pmod(i + 1, n)), F.lit(1)) - F.get(F.get(ring, i), F.lit(1))) + F.get(F.get(ring, i), F.lit(0)),
                F.lit(1),
            ).otherwise(F.lit(0)),
        )
        return F.when(n >= 3, F.aggregate(hits, F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0))

    inside = F.exists(coordinates, lambda rings: F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, b: a + b) % 2 == 1)
    return F.coalesce(inside, F.lit(False))


def simplify_line(points: list[list[float]], tolerance: float) -> list[list[float]]:
    """Points kept by the farthest-point rule: what lies within tolerance of a chord goes. No recursion."""
    n = len(points)
    if n < 3:
        return points
    keep = [False] * n
    keep[0] = keep[-1] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        (ax, ay), (bx, by) = points[a][:2], points[b][:2]
        dx, dy = bx - ax, by - ay
        norm = math.hypot(dx, dy)
        far, best = -1, tolerance
        for i in range(a + 1, b):
            x, y = points[i][0] - ax, points[i][1] - ay
            d = abs(dx * y - dy * x) / norm if norm else math.hypot(x, y)
            if d > best:
                far, best = i, d
        if far >= 0:
            keep[far] = True
            spans += [(a, far), (far, b)]
    return [p for p, k in zip(points, keep) if k]


def simplify(tolerance: float):  # noqa: ANN201
    """A Column function: array of points -> simplified array of points, in the points' own units. [M10]"""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def run(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else simplify_line(x, tolerance) for x in lines.to_pylist()], pa.list_(pa.list_(pa.float64())))

    return run

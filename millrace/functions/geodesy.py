"""Longitude and latitude on WGS84 to metres on the British National Grid, as column expressions.

Three steps, none of which looks anything up: to cartesian coordinates on one ellipsoid,
a seven-parameter shift to the other datum, and back to latitude and longitude there; then
a transverse Mercator projection by Krüger's series in the third flattening, which is
accurate to well under a millimetre over the grid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    """Half of the major axis in metres, and the flattening."""

    a: float
    flattening: float

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    @property
    def b(self) -> float:
        return self.a * (1 - self.flattening)

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)


@dataclass(frozen=True)
class Shift:
    """Metres, arc seconds and parts per million by which coordinates on the grid's datum become WGS84 (position vectors, small angles)."""

    x: float
    y: float
    z: float
    rx: float
    ry: float
    rz: float
    scale: float


@dataclass(frozen=True)
class Mercator:
    """The true origin in degrees, the scale there, and its false easting and northing."""

    lat: float
    lon: float
    scale: float
    east: float
    north: float


# The ellipsoids, the datum shift and the projection of the grid.
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
AIRY = Ellipsoid(6377563.396, 1 / 299.3249646)
SHIFT = Shift(446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
GRID = Mercator(49.0, -2.0, 0.9996012717, 400000.0, -100000.0)


def kruger(n: float) -> tuple[float, list[float]]:
    """The radius factor of the rectifying sphere, and the coefficients of the series, to the fourth power of n."""
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    terms = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return radius, terms


def cartesian(lon: Column, lat: Column, on: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    """x, y and z in metres of a point on the ellipsoid's surface, from degrees."""
    phi, lam = F.radians(lat), F.radians(lon)
    nu = on.a / F.sqrt(1 - on.e2 * F.sin(phi) * F.sin(phi))
    return nu * F.cos(phi) * F.cos(lam), nu * F.cos(phi) * F.sin(lam), nu * (1 - on.e2) * F.sin(phi)


def shifted_back(x: Column, y: Column, z: Column, by: Shift = SHIFT) -> tuple[Column, Column, Column]:
    """Undoes a shift: offset and scale are taken off, then the transposed rotation is applied."""
    second = math.pi / (180 * 3600)
    rx, ry, rz, m = by.rx * second, by.ry * second, by.rz * second, 1 + by.scale * 1e-6
    x, y, z = (x - by.x) / m, (y - by.y) / m, (z - by.z) / m
    return x + rz * y - ry * z, y - rz * x + rx * z, z + ry * x - rx * y


def geodetic(x: Column, y: Column, z: Column, on: Ellipsoid = AIRY) -> tuple[Column, Column]:
    """Longitude and latitude in radians by Bowring's formula."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * on.a, p * on.b)
    second = on.e2 / (1 - on.e2)
    lat = F.atan2(z + second * on.b * F.pow(F.sin(theta), 3), p - on.e2 * on.a * F.pow(F.cos(theta), 3))
    return F.atan2(y, x), lat


def transverse_mercator(lon: Column, lat: Column, on: Ellipsoid = AIRY, to: Mercator = GRID) -> tuple[Column, Column]:
    """East and north in metres from radians."""
    radius, terms = kruger(on.n)
    e = math.sqrt(on.e2)
    s0 = math.sin(math.radians(to.lat))
    xi0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    origin = xi0 + sum(t * math.sin(2 * j * xi0) for j, t in enumerate(terms, 1))
    lam = lon - math.radians(to.lon)
    t = F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    along = sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(terms, 1)), xi)
    across = sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(terms, 1)), eta)
    k = to.scale * on.a * radius
    return to.east + k * across, to.north + k * (along - origin)


def national_grid(df: DataFrame, lon: str = "lon", lat: str = "lat", east: str = "east", north: str = "north") -> DataFrame:
    """Adds `east` and `north` (metres) of points in degrees on WGS84; null where a coordinate is null, not finite, or no place on the globe."""
    a, b = F.col(lon).cast("double"), F.col(lat).cast("double")
    real = (F.abs(a) <= 180) & (F.abs(b) < 90)
    step = df.withColumns(dict(zip(("_x", "_y", "_z"), cartesian(F.when(real, a), F.when(real, b)), strict=True)))
    step = step.withColumns(dict(zip(("_x", "_y", "_z"), shifted_back(F.col("_x"), F.col("_y"), F.col("_z")), strict=True)))
    step = step.withColumns(dict(zip(("_lon", "_lat"), geodetic(F.col("_x"), F.col("_y"), F.col("_z")), strict=True)))
    made = dict(zip((east, north), transverse_mercator(F.col("_lon"), F.col("_lat")), strict=True))
    kept = [c for c in df.columns if c not in made]
    return step.select(*kept, *[c.alias(name) for name, c in made.items()])


def national_grid_sql(source: str, keys: str) -> str:
    """The same as SQL over a table expression with columns `keys`, lon and lat; east and north are rounded to millimetres."""
    second = math.pi / (180 * 3600)
    m, rx, ry, rz = 1 + SHIFT.scale * 1e-6, SHIFT.rx * second, SHIFT.ry * second, SHIFT.rz * second
    radius, terms = kruger(AIRY.n)
    e, k = math.sqrt(AIRY.e2), GRID.scale * AIRY.a * radius
    s0 = math.sin(math.radians(GRID.lat))
    xi0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    origin = xi0 + sum(t * math.sin(2 * j * xi0) for j, t in enumerate(terms, 1))
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    series = lambda f, g: " + ".join(f"{d(t)} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, t in enumerate(terms, 1))
    return f"""
        WITH a AS (SELECT {keys}, radians(lon) AS l, radians(lat) AS p FROM ({source})),
        b AS (SELECT {keys}, l, p, {d(WGS84.a)} / sqrt(1 - {d(WGS84.e2)} * sin(p) * sin(p)) AS nu FROM a),
        c AS (
            SELECT {keys}, (nu * cos(p) * cos(l) - {d(SHIFT.x)}) / {d(m)} AS x, (nu * cos(p) * sin(l) - {d(SHIFT.y)}) / {d(m)} AS y,
                   (nu * (1 - {d(WGS84.e2)}) * sin(p) - {d(SHIFT.z)}) / {d(m)} AS z
            FROM b),
        f AS (SELECT {keys}, x + {d(rz)} * y - {d(ry)} * z AS x, y - {d(rz)} * x + {d(rx)} * z AS y, z + {d(ry)} * x - {d(rx)} * y AS z FROM c),
        g AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z * {d(AIRY.a)}, sqrt(x * x + y * y) * {d(AIRY.b)}) AS theta FROM f),
        h AS (
            SELECT {keys}, atan2(y, x) - {d(math.radians(GRID.lon))} AS l,
                   atan2(z + {d(AIRY.e2 / (1 - AIRY.e2) * AIRY.b)} * pow(sin(theta), 3), r - {d(AIRY.e2 * AIRY.a)} * pow(cos(theta), 3)) AS p
            FROM g),
        i AS (SELECT {keys}, l, sinh(atanh(sin(p)) - {d(e)} * atanh({d(e)} * sin(p))) AS t FROM h),
        j AS (SELECT {keys}, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM i)
        SELECT {keys}, round({d(GRID.east)} + {d(k)} * (eta + {series("cos", "sinh")}), 3) AS east,
               round({d(GRID.north)} + {d(k)} * (xi - {d(origin)} + {series("sin", "cosh")}), 3) AS north
        FROM j
    """

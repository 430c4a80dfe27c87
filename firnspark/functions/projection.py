"""Polar stereographic coordinates (north, WGS84, true scale at 70 N, 45 W down) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid and the projection: fixed values.
A, INV_F, LAT_TS, LON_0 = 6378137.0, 298.257223563, 70.0, -45.0
E = math.sqrt(2 / INV_F - 1 / INV_F**2)


def _t(lat: Column) -> Column:
    s = F.sin(lat)
    return F.tan(F.lit(math.pi / 4) - lat / 2) / F.pow((1 - E * s) / (1 + E * s), F.lit(E / 2))


def _scale() -> float:
    p = math.radians(LAT_TS)
    s = math.sin(p)
    t = math.tan(math.pi / 4 - p / 2) / ((1 - E * s) / (1 + E * s)) ** (E / 2)
    return A * math.cos(p) / math.sqrt(1 - E * E * s * s) / t


SCALE = _scale()


def forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Degrees to metres."""
    rho = F.lit(SCALE) * _t(F.radians(lat))
    turn = F.radians(lon - LON_0)
    return rho * F.sin(turn), -rho * F.cos(turn)


def inverse(x: Column, y: Column, terms: int = 6) -> tuple[Column, Column]:
    """Metres to degrees, by fixed-point steps on the conformal latitude."""
    t = F.hypot(x, y) / F.lit(SCALE)
    lat = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(terms):
        s = F.sin(lat)
        lat = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - E * s) / (1 + E * s), F.lit(E / 2)))
    return F.degrees(lat), F.degrees(F.atan2(x, -y)) + LON_0


#: The same in SQL that Spark and DuckDB both run: {lat} and {lon} in degrees.
_SQL_T = f"(tan({math.pi / 4!r} - radians({{lat}}) / 2) / pow((1 - {E!r} * sin(radians({{lat}}))) / (1 + {E!r} * sin(radians({{lat}}))), {E / 2!r}))"
SQL_X = f"({SCALE!r} * {_SQL_T} * sin(radians({{lon}} + 45.0)))"
SQL_Y = f"(-{SCALE!r} * {_SQL_T} * cos(radians({{lon}} + 45.0)))"

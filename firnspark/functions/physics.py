"""Column expressions on single samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnspark.constants import EARTH, LIGHT, MARGIN_PERMITTIVITY, PhysicalConstants


def clean(c: Column) -> Column:
    """Missing is NULL: NaN becomes NULL."""
    return F.nanvl(c, F.lit(None).cast("double"))


def thickness() -> Column:
    return F.col("h_surf") - F.col("h_bed")


def above_geoid(height: str) -> Column:
    return F.col(height) - F.col("geoid_m")


def flotation_residual(k: PhysicalConstants = EARTH) -> Column:
    """Metres above flotation at the surface: positive where grounded."""
    return above_geoid("h_surf") - thickness() * F.lit(k.flotation_factor)


def height_above_buoyancy(k: PhysicalConstants = EARTH) -> Column:
    return thickness() - F.lit(k.density_ratio) * -above_geoid("h_bed")


def buoyancy_of_layers(surface: Column, bottom: Column, geoid_m: Column, sea_water: float = EARTH.sea_water, ice: float = EARTH.ice) -> Column:
    """Height above buoyancy of two picked layers; the geoid has no default, since leaving it out biases the result."""
    return (surface - bottom) - F.lit(sea_water / ice) * (geoid_m - bottom)


def with_physics(profile: DataFrame, k: PhysicalConstants = EARTH, floor_m: float = 25.0) -> DataFrame:
    """profile with thickness, heights, residual, buoyancy and the two-valued masks of its samples.

    A missing thickness is neither ice nor water; a bottom pick on the surface pick is no water either.
    """
    out = profile.withColumns({
        "thickness": thickness(), "h_surf_msl": above_geoid("h_surf"), "h_bed_msl": above_geoid("h_bed"),
        "residual": flotation_residual(k), "hab": height_above_buoyancy(k),
        "nan": F.col("amp").isNull(), "degenerate": F.coalesce(F.col("h_surf") == F.col("h_bed"), F.lit(False)),
    })
    out = out.withColumn("ice", F.coalesce(F.col("thickness") >= floor_m, F.lit(False)))
    return out.withColumn("water", F.col("thickness").isNotNull() & ~F.col("ice") & ~F.col("degenerate"))


def decibels(amplitude: Column) -> Column:
    """10 log10 |a|; NULL for zero."""
    a = F.abs(amplitude)
    return F.when(a > 0, 10 * F.log10(a))


def pick_margin(metres: float = 50.0) -> float:
    """Two-way time on either side of a pick."""
    return metres / (LIGHT / math.sqrt(MARGIN_PERMITTIVITY))


def bed_elevation(surface_elevation: Column, surface_twtt: Column, bottom_twtt: Column, k: PhysicalConstants = EARTH) -> Column:
    return surface_elevation - (bottom_twtt - surface_twtt) * F.lit(LIGHT / math.sqrt(k.permittivity) / 2)


def surface_elevation(aircraft: Column, surface_twtt: Column) -> Column:
    return aircraft - surface_twtt * F.lit(LIGHT / 2)


def draft(surface: Column, geoid: Column, k: PhysicalConstants = EARTH) -> Column:
    """Depth of the base of floating ice by its freeboard, negative below the geoid."""
    return (surface - geoid) * F.lit(1.0 - 1.0 / k.flotation_factor)


def flotation_class(residual: Column) -> Column:
    return F.when(residual > 30, "grounded").when(residual >= 0, "near").when(residual < 0, "floating")


def erf_model_derivatives(x: Column, a: float, b: float, x0: float) -> tuple[Column, Column, Column]:
    """First three derivatives of a * erf(b * (x - x0))."""
    u = F.lit(b) * (x - F.lit(x0))
    g = F.exp(-u * u) * F.lit(2 * a / math.sqrt(math.pi))
    return g * b, g * u * (-2 * b * b), g * (u * u * 2 - 1) * (2 * b**3)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of a whole array: a series of positive terms inside, a continued fraction beyond 3."""
    u = np.minimum(np.abs(x), 27.0)
    near, far = np.where(u < 3, u, 0.0), np.where(u < 3, 3.0, u)
    term, total = near.copy(), near.copy()
    for n in range(1, 60):
        term = term * (2 * near * near) / (2 * n + 1)
        total += term
    tail = np.zeros_like(far)
    for n in range(60, 0, -1):
        tail = (n / 2) / (far + tail)
    inside = total * np.exp(-near * near) * (2 / math.sqrt(math.pi))
    outside = 1 - np.exp(-far * far) / (math.sqrt(math.pi) * (far + tail))
    return np.where(np.isnan(x), np.nan, np.sign(x) * np.where(u < 3, inside, outside))


def erf_model(x: Column, a: float, b: float, x0: float, c: float) -> Column:
    @F.pandas_udf("double")
    def of(u: pd.Series) -> pd.Series:
        return pd.Series(erf(u.to_numpy(float)))

    return F.lit(a) * clean(of(F.lit(b) * (x - F.lit(x0)))) + F.lit(c)


def cutoff(wavelength_km: float, dx_km: float) -> float:
    """Cutoff as a share of the Nyquist frequency."""
    w = 2 * dx_km / wavelength_km
    if not 0 < w < 1:
        raise ValueError(f"wavelength {wavelength_km} km can't be filtered at a spacing of {dx_km} km")
    return w


def cutoff_column(wavelength_km: float, dx: str = "dx") -> Column:
    """The same for each segment's spacing; NULL where that is too wide for the wavelength."""
    w = 2 * F.col(dx) / F.lit(wavelength_km)
    return F.when((w > 0) & (w < 1), w)


def geoid_column(spec: float | int | str | None) -> Column | None:
    """A constant geoid as a column; None means it has to be sampled from the raster named by spec."""
    if isinstance(spec, bool):
        raise TypeError("a geoid is a number, a path or None")
    if spec is None:
        return F.lit(0.0)
    return F.lit(float(spec)) if isinstance(spec, (int, float)) else None

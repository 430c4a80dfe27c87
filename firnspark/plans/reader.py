"""From radar frames, layer picks and tracks to profiles: all segments of a catalog in one plan.

frames: by, frame, slow_time, twtt, data, lat, lon. layers: by, layer, slow_time, twtt, elev. track: by, slow_time, lat, lon.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnspark.functions.physics import geoid_column
from firnspark.functions.projection import forward
from firnspark.operators import joins, radar, series
from firnspark.sources.profiles import raster

KEY = series.KEY


def along_track(df: DataFrame, by: list[str]) -> DataFrame:
    """df (by, slow_time, lat, lon) with x_km, the distance from its first sample in the order of time."""
    px, py = forward(F.col("lat"), F.col("lon"))
    w = Window.partitionBy(*by).orderBy("slow_time")
    step = F.hypot(F.col("_px") - F.lag("_px").over(w), F.col("_py") - F.lag("_py").over(w))
    out = df.withColumns({"_px": px, "_py": py}).withColumn("_d", F.coalesce(step, F.lit(0.0)))
    return out.withColumn("x_km", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 1000).drop("_px", "_py", "_d")


def increasing(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with an x_km, of equal ones the first in time."""
    first = F.row_number().over(Window.partitionBy(*by, "x_km").orderBy("slow_time"))
    return df.where("x_km IS NOT NULL").withColumn("_k", first).where("_k = 1").drop("_k")


def elevations(layers: DataFrame, track: DataFrame, by: list[str]) -> DataFrame:
    """(by, slow_time, x_km, lat, lon, h_surf, h_bed) at the times of surface picks.

    Position and distance come from the track's nearest sample in time. Picks (rows with both heights) and
    path (rows with a position) are two views of it: a stretch without picks still has a path.
    """
    heights = radar.layer_elevations(layers, tuple(by)).where("surface IS NOT NULL")
    placed = joins.nearest(heights, along_track(track, by), "slow_time", ["x_km", "lat", "lon"], by)
    return increasing(placed, by).withColumnsRenamed({"surface": "h_surf", "bed": "h_bed"})


def bed_power(frames: DataFrame, layers: DataFrame, interval: str, by: list[str]) -> DataFrame:
    """(by, slow_time, x_km, amp): bed power in dB along the averaged traces' own track.

    Traces are averaged frame by frame; frames of segments without layers have none. Of traces at the same
    time in two frames the earlier frame's counts.
    """
    power = radar.reflection_power(frames, layers, interval, (*by, "frame"), tuple(by))
    where = radar.tumbling_mean(frames.groupBy(*by, "frame", "slow_time").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")), "slow_time", interval, ["lat", "lon"], [*by, "frame"])
    traces = where.join(power, [*by, "frame", "slow_time"], "inner")
    traces = radar.first_of_each(traces, [*by, "slow_time"], ["frame"])
    return increasing(along_track(traces, by), by).select(*by, "slow_time", "x_km", F.col("bed_power_db").alias("amp"))


def with_geoid(profile: DataFrame, spec: float | str | None, origin: tuple[float, float] | None = None, cell_m: float = 150.0) -> DataFrame:
    """profile (lat, lon) with geoid_m: zero, a number, or the values of the raster table at a path."""
    if (constant := geoid_column(spec)) is not None:
        return profile.withColumn("geoid_m", constant)
    return sampled_at(profile, spec, "geoid", "geoid_m", origin, cell_m)


def sampled_at(profile: DataFrame, path: str, variable: str, out: str, origin: tuple[float, float] | None, cell_m: float = 150.0) -> DataFrame:
    """profile with a variable of the raster table at `path` in the nearest cell, NULL outside; origin is its first cell's centre."""
    if origin is None:
        raise ValueError("the raster's origin is needed to place its cells")
    px, py = forward(F.col("lat"), F.col("lon"))
    cells = joins.raster_cells(profile.withColumns({"_px": px, "_py": py}), "_px", "_py", *origin, cell_m, cell_m)
    found = joins.sampled(cells, raster(profile.sparkSession, path, [variable]), [variable])
    return found.withColumnRenamed(variable, out).drop("_px", "_py", "col", "row", "tile_col", "tile_row")


def bathymetry(profile: DataFrame, path: str, origin: tuple[float, float], cell_m: float = 150.0) -> DataFrame:
    """profile with seabed_m: the bed of the raster table, brought from the geoid to the ellipsoid."""
    return sampled_at(profile, path, "bed", "seabed_m", origin, cell_m).withColumn("seabed_m", F.col("seabed_m") + F.col("geoid_m"))


def profiles_from_radar(frames: DataFrame, layers: DataFrame, track: DataFrame, interval: str = "2 seconds", dx_km: Column | None = None, geoid: float | str | None = None, origin: tuple[float, float] | None = None, by: list[str] | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Profiles (by, i, x_km, amp, h_surf, h_bed, geoid_m, lat, lon) on uniform grids.

    The grid runs over what power and picks both cover, in steps of dx_km, or of the median step of the
    power's traces. Values farther than two steps from a sample stay NULL. Segments that lack layers,
    power or a common stretch have no rows (``faults`` says why). keep: writes a table and reads it again
    (``catalog.kept``); with it elevations and power are worked out once and not for each of their uses.
    """
    by, keep = by or [KEY], keep or (lambda df, name: df)
    high, amp = keep(elevations(layers, track, by), "elevations"), keep(bed_power(frames, layers, interval, by), "bed-power")
    w = Window.partitionBy(*by).orderBy("x_km")
    step = amp.withColumn("_d", F.col("x_km") - F.lag("x_km").over(w)).groupBy(*by).agg(F.median("_d").alias("dx"))
    picks = high.where("h_surf IS NOT NULL AND h_bed IS NOT NULL")
    both = joins.overlap(picks, amp, by).where("reason = ''").join(step, by)
    both = both if dx_km is None else both.withColumn("dx", dx_km)
    grid = joins.uniform_grid(both.where("dx > 0"), by).select(*by, "i", "x_km", "dx")
    out = joins.regridded_all(grid, [
        (amp, ["amp"], 2 * F.col("dx")), (picks, ["h_surf", "h_bed"], 2 * F.col("dx")), (high.where("lat IS NOT NULL AND lon IS NOT NULL"), ["lat", "lon"], None),
    ], by).drop("dx")
    return with_geoid(out, geoid, origin).select(*by, "i", "x_km", "amp", "h_surf", "h_bed", "geoid_m", "lat", "lon")


def faults(frames: DataFrame, layers: DataFrame, track: DataFrame, interval: str = "2 seconds", by: list[str] | None = None) -> DataFrame:
    """(by, reason) of segments in frames that profiles_from_radar leaves out."""
    by = by or [KEY]
    known = frames.select(*by).distinct()
    has = lambda df, name: df.select(*by, F.lit(True).alias(name)).distinct()
    high, amp = elevations(layers, track, by), bed_power(frames, layers, interval, by)
    picks = high.where("h_surf IS NOT NULL AND h_bed IS NOT NULL")
    out = known.join(has(picks, "_p"), by, "left").join(has(amp.where("amp IS NOT NULL"), "_a"), by, "left").join(joins.overlap(picks, amp, by).select(*by, F.col("reason").alias("_o")), by, "left")
    reason = F.when(F.col("_p").isNull(), "no surface and bottom picks").when(F.col("_a").isNull(), "no bed power").when(F.col("_o") != "", F.col("_o"))
    return out.select(*by, reason.alias("reason")).where("reason IS NOT NULL")

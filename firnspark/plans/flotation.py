"""Where ice goes afloat: orientation, termini and the search window of each segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnspark.functions.physics import with_physics
from firnspark.operators import series

KEY = series.KEY


def smoothed(profile: DataFrame, km: float = 5.0, *keys: str) -> DataFrame:
    """profile (with physics) with dx, n and smooth, the residual filled and averaged over km."""
    keys = keys or (KEY,)
    out = series.filled(series.spacing(profile, *keys), "residual", "_filled", *keys)
    size = F.greatest(F.lit(3), series.half_even(F.lit(km) / F.col("dx")).cast("int"))
    return series.boxcar(out, "_filled", size, "smooth", *keys).drop("_filled")


def with_termini(profile: DataFrame, least_open_km: float = 1.0, *keys: str) -> DataFrame:
    """profile with t_before and t_after: on the first and last sample of a stretch of open water of least_open_km or
    more, the x of the ice next to it, else NULL."""
    keys = keys or (KEY,)
    w = series.along(*keys)
    out = profile.withColumn("_run", F.col(series.ORDER) - F.row_number().over(Window.partitionBy(*keys, "water").orderBy(series.ORDER)))
    run = Window.partitionBy(*keys, "water", "_run")
    open_ = F.col("water") & (F.max("x_km").over(run) - F.min("x_km").over(run) >= least_open_km)
    out = out.withColumn("_open", open_).withColumns({"_l": F.lag(F.struct("ice", "x_km")).over(w), "_r": F.lead(F.struct("ice", "x_km")).over(w)})
    side = lambda c: F.when(F.col("_open") & F.col(f"{c}.ice"), F.col(f"{c}.x_km"))
    return out.withColumns({"t_before": side("_l"), "t_after": side("_r")}).drop("_run", "_open", "_l", "_r")


def termini(profile: DataFrame, least_open_km: float = 1.0, *keys: str) -> DataFrame:
    """(keys, x_km): the ice next to stretches of open water of least_open_km or more, each side that has ice."""
    keys = keys or (KEY,)
    both = F.array_compact(F.array("t_before", "t_after"))
    return with_termini(profile, least_open_km, *keys).select(*keys, F.explode(both).alias("x_km"))


def _sign(*keys: str):
    w = series.whole(*keys)
    slope = F.regr_slope("smooth", "x_km").over(w)
    return F.when(F.count("smooth").over(w) >= 2, F.when(slope >= 0, 1).otherwise(-1)).cast("int")


def orientation(smooth: DataFrame, *keys: str) -> DataFrame:
    """(keys, sign): +1 if x grows landward, by the trend of the smoothed residual; NULL where it has no two values."""
    keys = keys or (KEY,)
    return smooth.withColumn("sign", _sign(*keys)).groupBy(*keys).agg(F.first("sign").alias("sign"))


def with_window(smooth: DataFrame, margin_km: float = 12.0, threshold_m: float = 30.0, *keys: str) -> DataFrame:
    """smooth with sign, x_cross, wlo, whi and wreason of its group, by windows alone: no join, no further shuffle.

    Scanned landward. The seaward edge is cut at a terminus within twice the margin; of several the one of greatest
    x counts. Without a window wlo and whi are NULL and wreason says why.
    """
    keys = keys or (KEY,)
    w = series.whole(*keys)
    out = with_termini(smooth, 1.0, *keys).withColumn("sign", _sign(*keys))
    at = F.col("x_km") * F.col("sign")
    out = out.withColumns({"_c": F.min(F.when(F.col("smooth") > threshold_m, at)).over(w), "_s": F.min(at).over(w), "_x0": F.min("x_km").over(w), "_x1": F.max("x_km").over(w)})
    out = out.withColumn("x_cross", F.col("_c") * F.col("sign"))
    cut = lambda t: F.when((F.abs(F.col(t) - F.col("x_cross")) <= 2 * margin_km) & (F.col(t) * F.col("sign") <= F.col("_c")), F.col(t))
    out = out.withColumn("_t", F.max(F.greatest(cut("t_before"), cut("t_after"))).over(w))
    lo, hi = F.greatest("_x0", F.col("x_cross") - margin_km), F.least("_x1", F.col("x_cross") + margin_km)
    out = out.withColumns({"_lo": F.when(F.col("sign") > 0, F.coalesce("_t", lo)).otherwise(lo), "_hi": F.when(F.col("sign") < 0, F.coalesce("_t", hi)).otherwise(hi)})
    reason = (
        F.when(F.col("sign").isNull(), "flotation residual is undefined").when(F.col("x_cross").isNull(), "never grounded")
        .when(F.col("_c") == F.col("_s"), "starts grounded").when(~(F.col("_hi") > F.col("_lo")), "window collapses at the terminus").otherwise("")
    )
    out = out.withColumn("wreason", reason)
    ok = F.col("wreason") == ""
    return out.withColumns({"wlo": F.when(ok, F.col("_lo")), "whi": F.when(ok, F.col("_hi"))}).drop("_c", "_s", "_x0", "_x1", "_t", "_lo", "_hi")


def windows(smooth: DataFrame, margin_km: float = 12.0, threshold_m: float = 30.0, *keys: str) -> DataFrame:
    """(keys, sign, x_cross, lo, hi, reason): the search window around the first rise above the threshold."""
    keys = keys or (KEY,)
    one = lambda c, name: F.first(c).alias(name)
    return with_window(smooth, margin_km, threshold_m, *keys).groupBy(*keys).agg(one("sign", "sign"), one("x_cross", "x_cross"), one("wlo", "lo"), one("whi", "hi"), one("wreason", "reason"))


def cropped(profile: DataFrame, bounds: DataFrame, *keys: str) -> DataFrame:
    """Samples with lo <= x <= hi; groups with fewer than two of them have none."""
    keys = keys or (KEY,)
    out = profile.join(bounds.select(*keys, "lo", "hi").where("lo IS NOT NULL"), [*keys]).where("x_km BETWEEN lo AND hi").drop("lo", "hi")
    return out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n >= 2").drop("_n")


def cropped_to(profile: DataFrame, lo, hi, *keys: str) -> DataFrame:
    """Samples within the bounds (columns, or None for an open end), numbered anew; groups with fewer than two have none."""
    keys = keys or (KEY,)
    kept = profile if lo is None else profile.where(F.col("x_km") >= lo)
    kept = kept if hi is None else kept.where(F.col("x_km") <= hi)
    kept = kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n >= 2").drop("_n")
    return kept.withColumn(series.ORDER, (F.row_number().over(series.along(*keys)) - 1).cast("long"))


def analysed(profile: DataFrame) -> DataFrame:
    """The profile with physics, spacing and smoothed residual: what most plans start from."""
    return smoothed(with_physics(profile))


def summary(profile: DataFrame) -> DataFrame:
    """Per segment: ice fraction, least distance to buoyancy over ice, and whether buoyancy changes sign there."""
    hab = F.when(F.col("ice"), F.col("hab"))
    return with_physics(profile).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ice").cast("double")).alias("ice_fraction"), F.min(F.abs(hab)).alias("min_hab"),
        F.coalesce((F.min(hab) < 0) & (F.max(hab) > 0), F.lit(False)).alias("hab_crosses_zero"),
    )

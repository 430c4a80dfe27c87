"""Fits and tables made from profiles and results: the erf model, plot-ready layers, reports."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnspark.constants import EARTH
from firnspark.functions.physics import draft, erf
from firnspark.operators import series
from firnspark.plans import flotation

KEY = series.KEY


def fitted_erf(df: DataFrame, x: str, y: str, by: str = KEY, steps: int = 60) -> DataFrame:
    """(by, a, b, x0, c, rmse): least squares of a * erf(b * (x - x0)) + c, damped Gauss-Newton within bounds.

    Starts from the spread, the middle and the mean of the samples; groups with fewer than four have no row.
    """
    def each(one: pd.DataFrame) -> pd.DataFrame:
        one = one.dropna().sort_values("x")
        u, v = one["x"].to_numpy(float), one["y"].to_numpy(float)
        if len(u) < 4 or u.max() == u.min():
            return pd.DataFrame({k: pd.Series(dtype=float) for k in ("a", "b", "x0", "c", "rmse")}).assign(key=pd.Series(dtype="int64"))[["key", "a", "b", "x0", "c", "rmse"]]
        span, rise = u.max() - u.min(), v.max() - v.min()
        low = np.array([-2 * rise - 1e-9, 1 / span / 10, u.min(), v.min() - rise - 1e-9])
        high = np.array([2 * rise + 1e-9, 100 / span, u.max(), v.max() + rise + 1e-9])
        half = len(v) // 2
        p = np.array([math.copysign(rise / 2, v[half:].mean() - v[:half].mean()), 4 / span, float(np.median(u)), v.mean()])
        model = lambda q: q[0] * erf(q[1] * (u - q[2])) + q[3]
        damp, err = 1e-2, ((v - model(p)) ** 2).sum()
        for _ in range(steps):
            w = p[1] * (u - p[2])
            bell = 2 / math.sqrt(math.pi) * np.exp(-w * w)
            j = np.stack([erf(w), p[0] * bell * (u - p[2]), -p[0] * bell * p[1], np.ones_like(u)], axis=1)
            h, g = j.T @ j, j.T @ (v - model(p))
            q = np.clip(p + np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), g), low, high)
            new = ((v - model(q)) ** 2).sum()
            if new < err:
                p, err, damp = q, new, max(damp / 3, 1e-12)
            else:
                damp = min(damp * 4, 1e12)
        return pd.DataFrame({"key": [one["key"].iloc[0]], "a": [p[0]], "b": [p[1]], "x0": [p[2]], "c": [p[3]], "rmse": [math.sqrt(err / len(u))]})

    out = df.select(F.col(by).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return out.groupBy("key").applyInPandas(each, "key long, a double, b double, x0 double, c double, rmse double").withColumnRenamed("key", by)


def bridged(df: DataFrame, c: str, out: str) -> DataFrame:
    """df with gaps of c between picks filled along x, and out_gap telling which samples those are."""
    n = F.count(c).over(series.whole())
    df = series.filled(df, c, f"_{out}", at="x_km", ends=False)
    value = F.when(n >= 2, F.col(f"_{out}")).otherwise(F.col(c))
    return df.withColumn(out, value).withColumn(f"{out}_gap", F.col(c).isNull() & F.col(out).isNotNull()).drop(f"_{out}")


def sea_level(profile: DataFrame) -> DataFrame:
    return profile.groupBy(KEY).agg(F.avg("geoid_m").alias("sea_level"), F.min("geoid_m").alias("geoid_min"), F.max("geoid_m").alias("geoid_max"))


def projected_seabed(layers: DataFrame, out: str = "seabed", floor: float = -2000.0, window_km: float = 2.0, clearance_m: float = 20.0) -> DataFrame:
    """layers with a level below their floating ice: the bed near the grounding point, or below the deepest keel.

    layers: x_km, bed, thick_ice, grounded and the segment's map_km. Without either there is no seabed. The bed
    counts within window_km of the point, the keel wherever floating ice is; the lower of them holds, down to the floor.
    """
    w = series.whole()
    near = F.col("grounded") & F.col("bed").isNotNull() & (F.abs(F.col("x_km") - F.col("map_km")) <= window_km)
    depth = F.median(F.when(near, F.col("bed"))).over(w)
    keel = F.min(F.when(~F.col("grounded") & F.col("thick_ice"), F.col("bed"))).over(w) - clearance_m
    own = layers.withColumns({"_d": depth, "_k": keel})
    # least skips what is missing.
    level = F.when(F.col("_d").isNotNull() | F.col("_k").isNotNull(), F.greatest(F.least("_d", "_k"), F.lit(floor)))
    return own.withColumn(out, level).drop("_d", "_k")


def data_extent(profile: DataFrame, windows: DataFrame, pad_km: float = 25.0) -> DataFrame:
    """(segment_id, x0, x1): from the first to the last sample with any pick, at most pad_km beyond the window."""
    valid = F.col("h_surf").isNotNull() | F.col("h_bed").isNotNull() | F.col("amp").isNotNull()
    ext = profile.groupBy(KEY).agg(F.min(F.when(valid, F.col("x_km"))).alias("a"), F.max(F.when(valid, F.col("x_km"))).alias("b"))
    out = ext.join(windows.where("lo IS NOT NULL").select(KEY, "lo", "hi"), KEY)
    x0, x1 = F.greatest(F.col("a"), F.col("lo") - pad_km), F.least(F.col("b"), F.col("hi") + pad_km)
    ok = F.col("a").isNotNull() & (x1 > x0)
    return out.select(KEY, F.when(ok, x0).otherwise(F.col("lo") - pad_km).alias("x0"), F.when(ok, x1).otherwise(F.col("hi") + pad_km).alias("x1"))


def collapsed(surface: Column, bed: Column, geoid: Column, grounded: Column, tolerance: float = 0.5) -> Column:
    """Floating bottom picks shallower than `tolerance` of the draft that the freeboard asks for."""
    free = surface - geoid
    return F.coalesce(~grounded & bed.isNotNull() & (free > 0) & (bed - geoid > tolerance * draft(surface, geoid, EARTH)), F.lit(False))


def held_front(df: DataFrame, bed: str, flag: str, out: str) -> DataFrame:
    """Ice bottom held out to the front: from the first collapsed pick seaward, back to where it stopped shoaling.

    df has sign. The anchor is the first flagged sample on the way to the sea, moved back landward for as long as the
    sample before it is deeper. Samples seaward of the anchor take its depth; out_held tells which. Without a flagged
    sample, or a pick at the anchor, nothing is held.
    """
    seaward = F.col("i") * -F.col("sign")
    w = Window.partitionBy(KEY).orderBy("_s")
    own = df.withColumn("_s", seaward)
    own = own.withColumn("_first", F.min(F.when(F.col(flag), F.col("_s"))).over(series.whole()))
    # A sample still shoaling is deeper-neighboured landward: the anchor is the last that isn't, up to the first collapsed one.
    shoals = F.coalesce(F.lag(bed).over(w) < F.col(bed), F.lit(False))
    own = own.withColumn("_stop", F.max(F.when(~shoals & (F.col("_s") <= F.col("_first")), F.col("_s"))).over(series.whole()))
    own = own.withColumn("_depth", F.max(F.when(F.col("_s") == F.col("_stop"), F.col(bed))).over(series.whole()))
    held = F.coalesce((F.col("_s") > F.col("_stop")) & F.col("_depth").isNotNull(), F.lit(False))
    return own.withColumn(f"{out}_held", held).withColumn(out, F.when(held, F.col("_depth")).otherwise(F.col(bed))).drop("_s", "_first", "_stop", "_depth")


def ahead_of_terminus(own: DataFrame) -> DataFrame:
    """own with ahead: whether a sample is seaward of the calving front.

    own has ice, the columns of ``flotation.with_window`` and the segment's map_km. The front is the terminus seaward
    of the grounding point that is nearest to it, else the seaward end of the ice run the point is in or nearest to.
    Windows over one order by segment; nothing is joined.
    """
    w, x, sign = series.whole(), F.col("x_km"), F.col("sign")
    point = F.col("map_km") * sign
    front = F.greatest(*[F.when(F.col(t) * sign < point, F.col(t) * sign) for t in ("t_before", "t_after")])
    out = own.withColumns({"_f": F.max(front).over(w), "_gp": F.min_by("i", F.struct(F.abs(x - F.col("map_km")), "i")).over(w)})
    out = out.withColumn("_run", F.col("i") - F.row_number().over(Window.partitionBy(KEY, "ice").orderBy("i")))
    run = Window.partitionBy(KEY, "ice", "_run")
    out = out.withColumns({"_a": F.min("i").over(run), "_z": F.max("i").over(run), "_xa": F.min("x_km").over(run), "_xz": F.max("x_km").over(run)})
    gp = F.col("_gp")
    away = F.when(gp.between(F.col("_a"), F.col("_z")), 0).otherwise(F.least(F.abs(F.col("_a") - gp), F.abs(F.col("_z") - gp)))
    best = F.min(F.when(F.col("ice"), F.struct(away.alias("away"), F.col("_a").alias("a"), F.col("_xa").alias("xa"), F.col("_xz").alias("xz")))).over(w)
    out = out.withColumn("_r", best)
    edge = F.coalesce(F.col("_f") * sign, F.when(sign > 0, F.col("_r.xa")).otherwise(F.col("_r.xz")))
    ahead = F.when(F.col("map_km").isNotNull(), F.when(sign > 0, x < edge).otherwise(x > edge))
    return out.withColumn("ahead", F.coalesce(ahead, F.lit(False))).drop("_f", "_gp", "_run", "_a", "_z", "_xa", "_xz", "_r")


def plot_layers(own: DataFrame) -> DataFrame:
    """Everything a section needs, as columns: bridged picks, ice, water and seabed masks, held bottom, projected seabed.

    own has the columns of ``flotation.with_window`` and the segment's map_km; segments without one are left out.
    """
    out = bridged(bridged(own.where("map_km IS NOT NULL"), "h_surf", "surface"), "h_bed", "bed_raw")
    out = out.withColumn("grounded", F.col("x_km") * F.col("sign") >= F.col("map_km") * F.col("sign"))
    out = out.withColumn("collapsed", collapsed(F.col("surface"), F.col("bed_raw"), F.col("geoid_m"), F.col("grounded")))
    out = held_front(out, "bed_raw", "collapsed", "bed")
    out = out.withColumn("thick_ice", F.coalesce(F.col("surface") - F.col("bed") >= 25.0, F.lit(False)))
    return projected_seabed(out).withColumn("joined_gap", series.dilated("bed_raw_gap"))


def plateaus(df: DataFrame, c: str = "amp", head: float = 0.3, tail: float = 0.3) -> DataFrame:
    """(segment_id, bright, dark): means of c over the first and last shares of x."""
    w = series.whole()
    lo, hi = F.min("x_km").over(w), F.max("x_km").over(w)
    own = df.withColumns({"_lo": lo, "_hi": hi}).withColumn("_r", (F.col("x_km") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return own.groupBy(KEY).agg(F.avg(F.when(F.col("_r") <= head, F.col(c))).alias("bright"), F.avg(F.when(F.col("_r") >= 1 - tail, F.col(c))).alias("dark"))


def windows_of(own: DataFrame) -> DataFrame:
    """(segment_id, sign, x_cross, lo, hi, reason) of samples that have the columns of ``flotation.with_window``."""
    one = lambda c, name: F.first(c).alias(name)
    return own.groupBy(KEY).agg(one("sign", "sign"), one("x_cross", "x_cross"), one("wlo", "lo"), one("whi", "hi"), one("wreason", "reason"))


def report(own: DataFrame, results: list[DataFrame], least_km: float = 0.3) -> DataFrame:
    """One row per segment and detector: extent, spacing, gaps, window and answer.

    own has dx, geoid_m and the columns of ``flotation.with_window``. Its summary is one aggregation; gaps are counted
    as runs of missing power in the same order.
    """
    w = series.along()
    gap = F.col("amp").isNull()
    marked = own.withColumns({"_nan": gap, "_next": F.coalesce(F.lead("x_km").over(w), F.col("x_km"))})
    marked = marked.withColumn("_run", F.col("i") - F.row_number().over(Window.partitionBy(KEY, "_nan").orderBy("i")))
    run = Window.partitionBy(KEY, "_nan", "_run")
    # A gap is counted at its first sample.
    counted = F.col("_nan") & (F.col("i") == F.min("i").over(run)) & (F.max("_next").over(run) - F.min("x_km").over(run) > least_km)
    marked = marked.withColumn("_gap", counted)
    one = lambda c, name: F.first(c).alias(name)
    ext = marked.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("x_km").alias("x0"), F.max("x_km").alias("x1"), one("dx", "dx"), F.avg("geoid_m").alias("geoid"),
        F.count_if("_gap").alias("n_gaps"), one("sign", "sign"), one("wlo", "wlo"), one("whi", "whi"),
    )
    out = results[0].select(KEY, "detector", "map_km", "reason")
    for r in results[1:]:
        out = out.unionByName(r.select(KEY, "detector", "map_km", "reason"))
    out = ext.join(out, KEY)
    line = F.format_string("%s: %.2f km", "detector", "map_km")
    return out.withColumn("summary", F.when(F.col("map_km").isNull(), F.concat_ws(": ", "detector", "reason")).otherwise(line))

"""Detectors of the grounding point: changepoint, onset and steepest gradient, for all segments at once.

They take samples with features and with the columns of ``flotation.with_window`` (sign, wlo, whi,
wreason), so one exchange by segment serves them all and nothing is joined. ``windowed`` puts other
windows there. Every segment gets an answer: map_km, or NULL and a reason.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnspark.operators import series
from firnspark.plans import changepoint, features

KEY = series.KEY
RESULT = (KEY, "detector", "map_km", "lo", "hi", "value", "reason")
RUNS = {"raw": False, "normalised": True}
POSTERIOR = f"{KEY} long, run string, model string, x_km double, p double, reason string"


def windowed(own: DataFrame, windows: DataFrame) -> DataFrame:
    """own with the windows (segment_id, sign, lo, hi) in place of those it has; segments without one have a reason."""
    own = own.drop("sign", "wlo", "whi", "wreason", "x_cross")
    out = own.join(windows.select(KEY, "sign", F.col("lo").alias("wlo"), F.col("hi").alias("whi")), KEY, "left")
    return out.withColumn("wreason", F.when(F.col("wlo").isNull() | F.col("whi").isNull(), "no search window").otherwise(""))


def inside() -> Column:
    return F.coalesce(F.col("x_km").between(F.col("wlo"), F.col("whi")), F.lit(False))


def gradient(own: DataFrame, feature: str = "dA", trim: int = 3) -> DataFrame:
    """Steepest gradient within the window, not among its first and last `trim` samples; the first of equal ones."""
    by = Window.partitionBy(KEY, "_in")
    own = own.withColumn("_in", inside())
    at, n = F.row_number().over(by.orderBy("i")), F.count(F.lit(1)).over(by)
    own = own.withColumns({"_at": at, "_n": n})
    kept = F.col("_in") & F.col(feature).isNotNull()
    free = kept & ((F.col("_n") <= 2 * trim) | ((F.col("_at") > trim) & (F.col("_at") <= F.col("_n") - trim)))
    best = F.max(F.when(free, F.struct(F.abs(feature).alias("s"), (-F.col("i")).alias("k"), "x_km", F.col(feature).alias("g")))).alias("_b")
    out = own.groupBy(KEY).agg(best, F.first("wlo").alias("lo"), F.first("whi").alias("hi"), F.first("wreason").alias("_w"))
    reason = F.when(F.col("_w") != "", F.col("_w")).when(F.col("_b").isNull(), "gradient is missing in the search window").otherwise("")
    return out.select(KEY, F.lit("gradient").alias("detector"), F.col("_b.x_km").alias("map_km"), "lo", "hi", F.col("_b.g").alias("value"), reason.alias("reason"))


def gradient_clipped(own: DataFrame, feature: str = "dA", steepest: float = features.STEEPEST) -> DataFrame:
    """As gradient, without trimming, and what is steeper than `steepest` counts as no gradient at all."""
    clipped = F.when(F.abs(feature) > steepest, F.lit(0.0)).otherwise(F.col(feature))
    return gradient(own.withColumn("_clipped", clipped), "_clipped", 0).withColumn("detector", F.lit("gradient-clipped"))


def rise(own: DataFrame, power: str = "amp", where: Column | None = None) -> DataFrame:
    """(segment_id, detector, i, map_km, value): where power rises most from sample to sample, at unit spacing.

    The signed gradient counts, not its size; of equal ones the first. where: samples that may be it,
    such as those between the first and the last one of thick ice.
    """
    own = own.withColumn("_g", series.gradient_unit(power))
    ok = F.col("_g").isNotNull() if where is None else F.col("_g").isNotNull() & F.coalesce(where, F.lit(False))
    best = F.max(F.when(ok, F.struct(F.col("_g").alias("g"), (-F.col("i")).alias("k"), "x_km"))).alias("_b")
    out = own.groupBy(KEY).agg(best)
    return out.select(KEY, F.lit("rise").alias("detector"), (-F.col("_b.k")).alias("i"), F.col("_b.x_km").alias("map_km"), F.col("_b.g").alias("value"))


def between_thick_ice(own: DataFrame, least_m: float = 50.0) -> DataFrame:
    """own with on_ice: from the first to the last sample of ice thicker than least_m."""
    w, thick = series.whole(), F.col("thickness") > least_m
    span = F.col("i").between(F.min(F.when(thick, F.col("i"))).over(w), F.max(F.when(thick, F.col("i"))).over(w))
    return own.withColumn("on_ice", F.coalesce(span, F.lit(False)))


def onset(own: DataFrame, feature: str = "amp_f", sigmas: float = 3.0, persist_km: float = 2.0, float_m: float = 10.0, baseline_km: float = 20.0, least_km: float = 8.0) -> DataFrame:
    """Where power first stays below the level of the floating stretch seaward of the window, scanned landward.

    own has smooth, dx, amp and the feature. reason tells of a reference too short or a drop never found.
    """
    x, lo, hi = F.col("x_km"), F.col("wlo"), F.col("whi")
    seaward = F.when(F.col("sign") > 0, (x < lo) & (x >= lo - baseline_km)).otherwise((x > hi) & (x <= hi + baseline_km))
    ref = F.coalesce((F.col("smooth") < float_m) & seaward & F.col(feature).isNotNull(), F.lit(False))
    w = series.whole()
    own = own.withColumns({"_f": F.col(feature), "_ref": ref})
    only = lambda c: F.when(F.col("_ref"), c)
    own = own.withColumns({
        "_a": F.min(only(x)).over(w), "_z": F.max(only(x)).over(w),
        "_base": F.median(only(F.col("_f"))).over(w), "_sigma": F.stddev_pop(only(F.col("amp") - F.col("_f"))).over(w),
        "_persist": F.greatest(F.lit(3), series.half_even(F.lit(persist_km) / F.col("dx")).cast("int")),
    })
    own = own.withColumn("_below", inside() & F.coalesce(F.col("_f") < F.col("_base") - sigmas * F.col("_sigma"), F.lit(False)))
    # Runs of samples below by islands in the same order: a sample's place among those below moves with it.
    own = own.withColumn("_run", F.col("i") - F.sum(F.col("_below").cast("int")).over(series.along()))
    run = Window.partitionBy(KEY, "_below", "_run")
    own = own.withColumns({"_len": F.count(F.lit(1)).over(run), "_from": F.when(F.col("sign") > 0, F.min("x_km").over(run)).otherwise(F.max("x_km").over(run))})
    start = F.when(F.col("_below") & (F.col("_len") >= F.col("_persist")), F.col("_from"))
    out = own.groupBy(KEY).agg(
        F.min_by(start, F.when(start.isNotNull(), start * F.col("sign"))).alias("map_km"),
        *[F.first(c).alias(n) for c, n in (("wlo", "lo"), ("whi", "hi"), ("wreason", "_w"), ("_base", "baseline"), ("_sigma", "sigma"), ("_a", "_a"), ("_z", "_z"))],
    )
    span = F.coalesce(F.col("_z") - F.col("_a"), F.lit(0.0))
    reason = F.when(F.col("_w") != "", F.col("_w")).when(span < least_km, "floating reference is too short").when(F.col("map_km").isNull(), "power never drops").otherwise("")
    out = out.withColumn("reason", reason)
    ok = F.col("reason") == ""
    return out.select(KEY, F.lit("onset").alias("detector"), F.when(ok, F.col("map_km")).alias("map_km"), "lo", "hi", F.when(ok, F.col("baseline") - sigmas * F.col("sigma")).alias("value"), "reason")


def bayesian(own: DataFrame, columns: tuple[str, ...] = features.DEFAULT, primary: str = "dfree", models: tuple[str, ...] = ("ifm", "fullcov"), truncate: float = -50.0, smooth: int = 3, runs: tuple[str, ...] = ("raw",), trim: int | None = None, reference: Column | None = None) -> DataFrame:
    """(segment_id, run, model, x_km, p, reason): posterior of the changepoint by model and, as model `mean`, of all of them.

    Features come from the whole profile and are cut to the window; the run `normalised` standardises them
    before that, by the statistics of the samples `reference`, or of all. trim places at either end of
    the posterior are no answer (by default two more than there are channels, at least three). Runs share
    one pass over the samples. A run without a posterior has one row, of model `mean`, with the reason.
    """
    if primary not in columns:
        raise ValueError(f"the primary feature {primary} is not among {columns}")
    if unknown := (set(models) - set(changepoint.MODELS)) | (set(runs) - set(RUNS)):
        raise ValueError(f"unknown models or runs {sorted(unknown)}")
    names = [primary, *(c for c in columns if c != primary)]
    own = own.select(KEY, "i", "x_km", "wlo", "whi", "wreason", *names, *([reference.alias("_ref")] if reference is not None else []))
    norm = {c: f"_n_{c}" for c in names}
    if "normalised" in runs:
        own = features.standardised(own.withColumns({to: F.col(c) for c, to in norm.items()}), list(norm.values()), None if reference is None else F.col("_ref"))
    trim = max(len(names) + 2, 3) if trim is None else trim
    # A segment without a window keeps its first sample, which brings the reason along.
    cut = own.where(inside() | ((F.col("wreason") != "") & (F.col("i") == 0)))

    def each(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("i")
        x, key, why = one["x_km"].to_numpy(), one[KEY].iloc[0], one["wreason"].iloc[0]
        out: list[pd.DataFrame] = []

        def add(run: str, model: str, x_km, p, reason: str) -> None:
            out.append(pd.DataFrame({KEY: key, "run": run, "model": model, "x_km": x_km, "p": p, "reason": reason}))

        for run in runs:
            data = one[list(norm.values()) if RUNS[run] else names].to_numpy(float)
            try:
                if why or len(x) < 3 or not np.isfinite(data).all():
                    raise ValueError(why or ("fewer than three samples in the search window" if len(x) < 3 else "features are missing in the search window"))
                each_p = {m: changepoint.posterior(data, m, truncate, trim) for m in models}
            except ValueError as e:
                add(run, "mean", [np.nan], [np.nan], str(e))
                continue
            mean = changepoint.boxcar(changepoint.geometric_mean(list(each_p.values())), smooth)
            for model, p in (each_p | {"mean": mean / mean.sum()}).items():
                add(run, model, x[:-1], p, "")
        return pd.concat(out)

    found = cut.groupBy(KEY).applyInPandas(each, POSTERIOR)
    return found.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("x_km", "p")})


def most_likely(posterior: DataFrame) -> DataFrame:
    """(segment_id, run, model, map_km, reason), the first of equal maxima."""
    best = F.max(F.when(F.col("p").isNotNull(), F.struct("p", (-F.col("x_km")).alias("x")))).alias("_b")
    return posterior.groupBy(KEY, "run", "model").agg(best, F.max("reason").alias("reason")).select(KEY, "run", "model", (-F.col("_b.x")).alias("map_km"), "reason")


def intervals(posterior: DataFrame, masses: tuple[float, ...] = (0.68, 0.95)) -> DataFrame:
    """(segment_id, run, model, mass, lo, hi): where the cumulative posterior passes the tails."""
    by = Window.partitionBy(KEY, "run", "model")
    cdf = F.sum("p").over(by.orderBy("x_km").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("p").over(by)
    own = posterior.withColumn("_cdf", cdf)
    at = lambda t: F.coalesce(F.min(F.when(F.col("_cdf") >= t, F.col("x_km"))), F.max("x_km"))
    each = [F.struct(F.lit(m).cast("double").alias("mass"), at((1 - m) / 2).alias("lo"), at(1 - (1 - m) / 2).alias("hi")) for m in masses]
    return own.groupBy(KEY, "run", "model").agg(F.array(*each).alias("_r")).select(KEY, "run", "model", F.inline("_r"))


def changepoint_result(posterior: DataFrame, windows: DataFrame) -> DataFrame:
    """The changepoint in the shape of the other detectors' answers: the mean of the models, by run; value is its p."""
    best = F.max(F.when(F.col("p").isNotNull(), F.struct("p", (-F.col("x_km")).alias("x")))).alias("_b")
    found = posterior.where("model = 'mean'").groupBy(KEY, "run").agg(best, F.max("reason").alias("reason"))
    name = F.when(F.col("run") == "raw", "bocpd").otherwise("bocpd-normalised")
    out = found.join(windows.select(KEY, "lo", "hi"), KEY)
    return out.select(KEY, name.alias("detector"), (-F.col("_b.x")).alias("map_km"), "lo", "hi", F.col("_b.p").alias("value"), "reason")


def transition_width(results: DataFrame, first: str = "onset", second: str = "bocpd") -> DataFrame:
    """(segment_id, width_km): from one detector's answer to the other's, landward; negative is unreliable.

    results has sign, detector and map_km, a row for each detector of a segment.
    """
    at = lambda d: F.max(F.when(F.col("detector") == d, F.col("map_km")))
    return results.groupBy(KEY).agg((F.first("sign") * (at(second) - at(first))).alias("width_km"))


def discordant(found: DataFrame, most_km: float = 3.0) -> DataFrame:
    """(segment_id, map_raw, map_normalised, discordant): the two runs' answers, and whether they are farther apart.

    found: segment_id, run, map_km. A run without an answer leaves the flag NULL.
    """
    at = lambda r: F.max(F.when(F.col("run") == r, F.col("map_km"))).alias(f"map_{r}")
    out = found.groupBy(KEY).agg(at("raw"), at("normalised"))
    return out.withColumn("discordant", F.abs(F.col("map_raw") - F.col("map_normalised")) > most_km)


def zone_offset(found: DataFrame, zone_lo: str) -> DataFrame:
    """found (with map_km) with its offset to the seaward edge of a known grounding zone, and in words."""
    off = F.col("map_km") - F.col(zone_lo)
    return found.withColumn("offset_km", off).withColumn("note", F.when(off < 0, "downflow").when(off >= 0, "upflow of the zone's seaward edge"))

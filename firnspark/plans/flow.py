"""How a track lies to the ice flow, and its along-flow legs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnspark.functions.projection import forward
from firnspark.operators import series
from firnspark.plans import flotation

KEY = series.KEY


@dataclass(frozen=True)
class Alignment:
    """Bounds of an along-flow track."""

    angle: float = 30.0
    sinuosity: float = 1.10
    monotonic: float = 0.95
    valid: float = 0.5


def headed(track: DataFrame, smooth: int = 5) -> DataFrame:
    """track with projected px, py and the unit tangent ex, ey of the smoothed track."""
    px, py = forward(F.col("lat"), F.col("lon"))
    out = track.withColumns({"px": px, "py": py})
    for c in ("px", "py"):
        out = series.boxcar(out, c, F.lit(smooth), f"_{c}", mode="nearest")
    out = out.withColumns({"_gx": series.gradient_unit("_px"), "_gy": series.gradient_unit("_py")})
    long = F.hypot("_gx", "_gy")
    return out.withColumns({"ex": F.try_divide(F.col("_gx"), long), "ey": F.try_divide(F.col("_gy"), long)}).drop("_px", "_py", "_gx", "_gy")


def angled(track: DataFrame, slowest: float = 50.0) -> DataFrame:
    """headed track with speed, cos (signed, NULL on ice slower than `slowest`) and the folded angle in degrees."""
    out = track.withColumn("speed", F.hypot("vx", "vy"))
    cos = F.try_divide(F.col("ex") * F.col("vx") + F.col("ey") * F.col("vy"), F.col("speed"))
    cos = F.when((F.col("speed") >= slowest) & cos.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    return out.withColumn("cos", cos).withColumn("angle", F.degrees(F.acos(F.abs("cos"))))


def alignment_columns() -> list:
    """Aggregates of a track (with _step, the distance to the sample before): angles, sinuosity, main direction, speed, validity."""
    first, last = (lambda c: F.min_by(c, "i")), (lambda c: F.max_by(c, "i"))
    chord = F.hypot(last("px") - first("px"), last("py") - first("py"))
    share = lambda s: F.avg(F.when(F.col("cos") != 0, (F.signum("cos") == s).cast("double")))
    return [
        F.percentile("angle", F.lit(0.5)).alias("median_angle"), F.percentile("angle", F.lit(0.9)).alias("p90_angle"),
        F.when(chord > 0, F.sum("_step") / chord).otherwise(F.lit(float("inf"))).alias("sinuosity"),
        F.greatest(share(1), share(-1)).alias("monotonic"), F.median("speed").alias("median_speed"), F.avg(F.col("cos").isNotNull().cast("double")).alias("valid"),
    ]


def stepped(track: DataFrame) -> DataFrame:
    return track.withColumn("_step", F.hypot(series.difference("px"), series.difference("py")))


def alignment(track: DataFrame, bounds: Alignment = Alignment()) -> DataFrame:
    """One row per segment: angles, sinuosity, share in the main direction, speed, share of valid samples."""
    out = stepped(track).groupBy(KEY).agg(*alignment_columns())
    ok = (F.col("median_angle") <= bounds.angle) & (F.col("sinuosity") <= bounds.sinuosity) & (F.col("monotonic") >= bounds.monotonic) & (F.col("valid") >= bounds.valid)
    return out.withColumn("along_flow", F.coalesce(ok, F.lit(False)))


def on_legs(track: DataFrame, angle: float = 30.0, least_km: float = 10.0) -> DataFrame:
    """The samples of the track's legs, with direction, leg (a number within segment and direction), leg_lo and leg_hi.

    A leg is a run of samples within `angle` of the flow in one direction, least_km long or more. Its samples are the
    run's, so no join is needed to cut them out.
    """
    aligned = F.coalesce(F.col("angle") <= angle, F.lit(False))
    way = track.withColumn("direction", F.when(aligned & (F.col("cos") > 0), 1).when(aligned & (F.col("cos") < 0), -1)).where("direction IS NOT NULL")
    out = way.withColumn("leg", F.col("i") - F.row_number().over(Window.partitionBy(KEY, "direction").orderBy("i")))
    run = Window.partitionBy(KEY, "direction", "leg")
    return out.withColumns({"leg_lo": F.min("x_km").over(run), "leg_hi": F.max("x_km").over(run)}).where(F.col("leg_hi") - F.col("leg_lo") >= least_km)


def legs(track: DataFrame, angle: float = 30.0, least_km: float = 10.0) -> DataFrame:
    """(segment_id, lo, hi, direction) of the legs."""
    return on_legs(track, angle, least_km).groupBy(KEY, "direction", "leg").agg(F.first("leg_lo").alias("lo"), F.first("leg_hi").alias("hi")).drop("leg")


def longest_leg(found: DataFrame) -> DataFrame:
    """The longest leg of each segment, the first of equally long ones."""
    best = F.min(F.struct((F.col("lo") - F.col("hi")).alias("length"), "lo", "hi")).alias("_b")
    return found.groupBy(KEY).agg(best).select(KEY, F.col("_b.lo").alias("lo"), F.col("_b.hi").alias("hi"))


def best_legs(track: DataFrame, angle: float = 30.0, margin_km: float = 3.5, *more) -> DataFrame:
    """(segment_id, lo, hi, score, wlo, whi, ...): of the legs whose own search window resolves, that with most power samples in it.

    track has physics. The window is worked out on each leg alone, for all legs at once; the earliest of equal legs
    counts, and a score of 0 is none. more: further aggregates of the leg's samples, which have their windows.
    """
    keys = (KEY, "direction", "leg")
    smooth = flotation.smoothed(on_legs(track, angle).drop("dx", "n", "smooth"), 5.0, *keys)
    own = flotation.with_window(smooth, margin_km, 30.0, *keys).where("wreason = ''")
    score = F.count(F.when(F.col("x_km").between(F.col("wlo"), F.col("whi")), F.col("amp"))).alias("score")
    each = own.groupBy(*keys).agg(*[F.first(c).alias(n) for c, n in (("leg_lo", "lo"), ("leg_hi", "hi"), ("wlo", "wlo"), ("whi", "whi"))], score, *more)
    ranked = each.where("score > 0").withColumn("_k", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("score"), "lo", "hi", "direction")))
    return ranked.where("_k = 1").drop("_k", "direction", "leg")


def on_best_leg(track: DataFrame, angle: float = 30.0, margin_km: float = 3.5) -> DataFrame:
    """The samples of each segment's best leg, numbered anew, with leg_lo and leg_hi; segments without one have none."""
    best = best_legs(track, angle, margin_km).select(KEY, F.col("lo").alias("leg_lo"), F.col("hi").alias("leg_hi"))
    own = track.join(best, KEY).where(F.col("x_km").between(F.col("leg_lo"), F.col("leg_hi")))
    return own.withColumn("i", (F.row_number().over(series.along()) - 1).cast("long"))


def flotation_leg(track: DataFrame, angle: float = 30.0, margin_km: float = 3.5) -> DataFrame:
    """(segment_id, lo, hi, score) of the best legs."""
    return best_legs(track, angle, margin_km).select(KEY, "lo", "hi", F.col("score").cast("long").alias("score"))

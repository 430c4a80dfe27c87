"""The verdict on each segment: whether a detector should be run on it, and if not why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnspark.functions.physics import with_physics
from firnspark.operators import series
from firnspark.plans import flotation, flow

KEY = series.KEY

#: The words of the verdicts, which are results: fixed values. {} is a rounded number.
NO_LEG = "no along-flow leg crossing flotation"
NO_DIRECTION = "flow direction undefined (ice too slow)"
ACROSS = "across flow ({} deg)"
NO_TERMINUS = "no terminus in range"
NO_ICE = "no ice on the leg"
NEVER_NEAR = "never near flotation (min HAB {} m)"
TOO_FAR = "terminus {} km from the transition"


def screened(profile: DataFrame, margin_km: float = 3.5, angle: float = 30.0, terminus_km: float | None = None, hab_m: float = 50.0) -> DataFrame:
    """One row per segment. Angles come from the whole track, all else from the chosen leg; reason is the first that fails, empty if usable."""
    track = flow.angled(flow.headed(with_physics(profile)))
    hab = F.when(F.col("ice"), F.col("hab"))
    scope = [
        F.min(F.abs(hab)).alias("min_hab"), F.coalesce((F.min(hab) < 0) & (F.max(hab) > 0), F.lit(False)).alias("hab_crosses_zero"),
        F.max(F.greatest("t_before", "t_after")).alias("terminus"),
    ]
    # Two passes over the track, each one aggregation by segment: as a whole, and leg by leg.
    of_all = flow.stepped(flotation.with_termini(track)).groupBy(KEY).agg(F.avg(F.col("ice").cast("double")).alias("ice_fraction"), *flow.alignment_columns(), *scope)
    of_leg = flow.best_legs(track, angle, margin_km, *scope)
    leg = of_leg.select(KEY, F.struct("lo", "hi", "wlo", "whi", "min_hab", "hab_crosses_zero", "terminus").alias("leg"))
    out = of_all.join(leg, KEY, "left").withColumns({"has_leg": F.col("leg").isNotNull(), "leg_lo": F.col("leg.lo"), "leg_hi": F.col("leg.hi")})
    out = out.withColumns({c: F.when(F.col("has_leg"), F.col(f"leg.{c}")).otherwise(F.col(c)) for c in ("min_hab", "hab_crosses_zero", "terminus")})
    far = F.least(F.abs(F.col("terminus") - F.col("leg.wlo")), F.abs(F.col("terminus") - F.col("leg.whi")))
    out = out.withColumn("distance", F.when(F.col("has_leg") & F.col("terminus").isNotNull(), far))
    said = lambda text, c: F.format_string(text.replace("{}", "%.0f"), series.half_even(F.col(c)))
    reason = (
        F.when(~F.col("has_leg"), NO_LEG).when(F.col("median_angle").isNull(), NO_DIRECTION).when(F.col("median_angle") > angle, said(ACROSS, "median_angle"))
        .when(F.col("terminus").isNull(), NO_TERMINUS).when(F.col("min_hab").isNull(), NO_ICE).when(F.col("min_hab") > hab_m, said(NEVER_NEAR, "min_hab"))
    )
    if terminus_km is not None:
        reason = reason.when(F.col("distance") > terminus_km, said(TOO_FAR, "distance"))
    return out.withColumn("reason", reason.otherwise("")).select(
        KEY, "leg_lo", "leg_hi", "terminus", "min_hab", "hab_crosses_zero", "distance", "median_angle", "monotonic", "ice_fraction", (F.col("reason") == "").alias("usable"), "reason"
    )

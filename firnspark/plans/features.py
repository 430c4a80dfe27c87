"""Features of a profile for the detectors; each is computed on the whole profile, cut later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnspark.constants import EARTH, PhysicalConstants
from firnspark.functions.physics import clean
from firnspark.operators import filtering, series

#: Cutoff wavelengths in km: power, geometry. The steepest credible gradient of power in dB/km.
POWER_KM, GEOMETRY_KM, STEEPEST = 9.55, 71.6, 5.0
DEFAULT = ("amp_f", "dA", "dfree", "dsurf")


def power_gradient(filtered: DataFrame, column: str = "amp_f", out: str = "dA", steepest: float = STEEPEST, gap_km: float = 0.3) -> DataFrame:
    """Gradient of the filtered power, masked in and next to gaps and where too steep, then filled."""
    w = series.along()
    marked = filtered.withColumns({"_nan": F.col("amp").isNull(), "_g": series.gradient(column), "_next": F.coalesce(F.lead("x_km").over(w), F.col("x_km"))})
    # Runs of missing power by islands, in the same window order as everything else.
    marked = marked.withColumn("_run", F.sum(F.when(F.col("_nan") & ~F.coalesce(F.lag("_nan").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    in_run = series.whole(series.KEY, "_run", "_nan")
    wide = F.col("_nan") & (F.max("_next").over(in_run) - F.min("x_km").over(in_run) > gap_km)
    marked = marked.withColumn("_wide", wide)
    # A gap ends at the first sample after it, which is masked too.
    hidden = F.col("_wide") | F.coalesce(F.lag("_wide").over(w) & ~F.col("_nan"), F.lit(False))
    marked = marked.withColumn("_m", F.when(~hidden & (F.abs("_g") <= steepest), F.col("_g")))
    return series.filled(marked, "_m", out).drop("_nan", "_g", "_next", "_run", "_wide", "_m")


def computed(profile: DataFrame, k: PhysicalConstants = EARTH) -> DataFrame:
    """profile with amp_f, dA, dfree, dsurf, and dfree_msl.

    dfree leaves the geoid out, like the rule it follows; dfree_msl takes it off first.
    """
    out = series.spacing(profile) if "dx" not in profile.columns else profile
    out = filtering.low_passed(out, {"amp_f": ("amp", POWER_KM), "_hs": ("h_surf", GEOMETRY_KM), "_hb": ("h_bed", GEOMETRY_KM)})
    for c in ("amp_f", "_hs", "_hb"):
        out = out.withColumn(c, clean(F.col(c)))
    out = power_gradient(out)
    free = F.col("_hs") - (F.col("_hs") - F.col("_hb")) * F.lit(k.flotation_factor)
    return out.withColumns({"dfree": free, "dfree_msl": free - F.col("geoid_m"), "dsurf": series.gradient("_hs")}).drop("_hs", "_hb")


def early(profile: DataFrame, power_wn: float = 0.15, slope_wn: float = 0.02, order: tuple[int, int] = (5, 5), hidden: tuple[float, float] | None = None, steepest: float = STEEPEST, k: PhysicalConstants = EARTH) -> DataFrame:
    """profile (with dx) with amp_e, amp_shown, dA_e, dfree_e and dsurf_e, the features before wavelengths had units.

    Cutoffs are shares of Nyquist, whatever the spacing. The gradient is masked in the stretch `hidden` (a band of
    artefacts, its ends not included) and where too steep; five samples of a gap are interpolated, and what is left is
    carried on. amp_shown is the filtered power where power was measured. Picks are on the power's grid here.
    """
    spaced = profile.withColumns({"_dx": F.col("dx"), "_nan": F.col("amp").isNull()})
    for c in ("h_surf", "h_bed"):
        spaced = series.filled(spaced, c, f"_i{c}", at="x_km")
    # A share w of Nyquist is the wavelength 2 dx / w: with dx = 1 it is 2 / w.
    unit = spaced.withColumn("dx", F.lit(1.0))
    out = filtering.low_passed(unit, {"amp_e": ("amp", 2 / power_wn)}, order[0])
    out = filtering.low_passed(out, {"_hs": ("_ih_surf", 2 / slope_wn), "_hb": ("_ih_bed", 2 / slope_wn)}, order[1])
    out = out.withColumn("dx", F.col("_dx")).withColumn("_g", series.gradient("amp_e"))
    free = F.lit(True) if hidden is None else ~((F.col("x_km") > hidden[0]) & (F.col("x_km") < hidden[1]))
    out = series.filled(out.withColumn("_m", F.when(free & (F.abs("_g") <= steepest), F.col("_g"))), "_m", "dA_e", most=5)
    out = out.withColumns({
        "amp_shown": F.when(~F.col("_nan"), F.col("amp_e")), "dfree_e": F.col("_hs") - (F.col("_hs") - F.col("_hb")) * F.lit(k.flotation_factor), "dsurf_e": series.gradient("_hs"),
    })
    return out.drop("_dx", "_nan", "_ih_surf", "_ih_bed", "_hs", "_hb", "_g", "_m")


def standardised(df: DataFrame, columns: list[str], where=None) -> DataFrame:
    """columns less their mean, over their deviation, by segment; statistics of the rows `where` only, if given."""
    own = lambda c: F.col(c) if where is None else F.when(where, F.col(c))
    w = series.whole()
    return df.withColumns({c: (F.col(c) - F.avg(own(c)).over(w)) / (F.stddev_pop(own(c)).over(w) + 1e-9) for c in columns})

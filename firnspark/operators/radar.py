"""From radar frames and layer picks to power and elevation series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnspark.functions.physics import bed_elevation, decibels, pick_margin
from firnspark.operators.joins import nearest, outer_aligned


def tumbling_mean(df: DataFrame, time: str, interval: str, values: list[str], by: list[str], keep_empty: bool = False) -> DataFrame:
    """Mean of the values in windows of `interval`, named by their start; empty ones as NULL rows on request."""
    out = df.groupBy(*by, F.window(time, interval).alias("_w")).agg(*[F.avg(v).alias(v) for v in values])
    out = out.select(*by, F.col("_w.start").alias(time), *values)
    if not keep_empty:
        return out
    span = out.groupBy(*by).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    bins = span.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {interval}"))).alias(time))
    return bins.join(out, [*by, time], "left")


def peak_power(radar: DataFrame, layer: DataFrame, by: list[str], margin: float | None = None, near: list[str] | None = None) -> DataFrame:
    """(by, slow_time, peak_twtt, peak_power): the strongest sample within the margin of the layer's pick.

    Times take the nearest pick within a second. Of equal powers the earliest two-way time counts;
    traces without any sample in the margin have no row. near: the keys of `by` that the layer has.
    """
    margin = pick_margin() if margin is None else margin
    times = radar.select(*by, "slow_time").distinct()
    picks = nearest(times, layer, "slow_time", ["twtt"], near or by, F.expr("INTERVAL '1' SECOND")).withColumnRenamed("twtt", "_pick")
    near = radar.join(picks.where("_pick IS NOT NULL"), [*by, "slow_time"]).where(F.col("twtt").between(F.col("_pick") - margin, F.col("_pick") + margin))
    near = near.withColumn("_db", decibels(F.col("data"))).where("_db IS NOT NULL")
    best = F.max(F.struct(F.col("_db").alias("db"), (-F.col("twtt")).alias("t"))).alias("_m")
    return near.groupBy(*by, "slow_time").agg(best).select(*by, "slow_time", (-F.col("_m.t")).alias("peak_twtt"), F.col("_m.db").alias("peak_power"))


def reflection_power(frames: DataFrame, layers: DataFrame, interval: str = "5 seconds", by: tuple[str, ...] = ("segment_id",), of_layers: tuple[str, ...] | None = None) -> DataFrame:
    """Surface and bottom power per averaged trace; a segment without layers has no rows.

    frames: by, slow_time, twtt, data. layers: of_layers (by unless given, and among it), layer, slow_time, twtt.
    """
    by, own = list(by), list(of_layers or by)
    with_layers = frames.join(layers.select(*own).distinct(), own, "left_semi")
    mean = tumbling_mean(with_layers, "slow_time", interval, ["data"], [*by, "twtt"])
    one = lambda name: layers.where(F.col("layer") == f"standard:{name}").select(*own, "slow_time", "twtt")
    peak = lambda name, k: peak_power(mean, one(name), by, near=own).select(*by, "slow_time", F.col("peak_twtt").alias(f"{k}_twtt"), F.col("peak_power").alias(f"{k}_power_db"))
    return outer_aligned([peak("surface", "surface"), peak("bottom", "bed")], [*by, "slow_time"])


def layer_elevations(layers: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """(by, slow_time, surface, bed) in metres above the ellipsoid; layers has elev, the aircraft's height."""
    two = layers.groupBy(*by, "slow_time").agg(
        F.max(F.when(F.col("layer") == "standard:surface", F.col("twtt"))).alias("ts"),
        F.max(F.when(F.col("layer") == "standard:bottom", F.col("twtt"))).alias("tb"),
        F.max(F.when(F.col("layer") == "standard:surface", F.col("elev"))).alias("elev"),
    )
    from firnspark.functions.physics import surface_elevation

    out = two.withColumn("surface", surface_elevation(F.col("elev"), F.col("ts")))
    return out.select(*by, "slow_time", "surface", bed_elevation(F.col("surface"), F.col("ts"), F.col("tb")).alias("bed"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")

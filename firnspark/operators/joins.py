"""Joins of ordered series: nearest in time, regridding, raster cells, outer alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, on: str, values: list[str], by: list[str], tolerance: Column | None = None) -> DataFrame:
    """left with the `values` of the right row of the same `by` that is nearest in `on`.

    Of two equally near rows the earlier one counts. Beyond the tolerance (in the unit of the
    difference of two `on`) the values are NULL, as without any right row. Both sides are put into
    one order by one shuffle, so no interval is exploded and nothing is broadcast.
    """
    own = left.withColumns({"_side": F.lit(1), **{f"_{v}": F.lit(None).cast(dict(right.dtypes)[v]) for v in values}})
    other = right.select(*by, on, F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    both = other.unionByName(own, allowMissingColumns=True)
    pack = F.when(F.col("_side") == 0, F.struct(F.col(on).alias("at"), *[F.col(f"_{v}").alias(v) for v in values]))
    both = both.withColumn("_p", pack)
    w = Window.partitionBy(*by).orderBy(on, "_side")
    both = both.withColumns({
        "_b": F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_a": F.first("_p", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col(on), F.col("_side").desc()).rowsBetween(0, Window.unboundedFollowing)),
    }).where("_side = 1")
    back, ahead = F.col(on) - F.col("_b.at"), F.col("_a.at") - F.col(on)
    use_back = F.col("_a").isNull() | (F.col("_b").isNotNull() & (back <= ahead))
    chosen = both.withColumn("_m", F.when(use_back, F.col("_b")).otherwise(F.col("_a")))
    far = F.when(use_back, back).otherwise(ahead)
    ok = F.lit(True) if tolerance is None else far <= tolerance
    return chosen.select(*left.columns, *[F.when(ok, F.col(f"_m.{v}")).alias(v) for v in values])


def nearest_row(df: DataFrame, at: str, probe: Column, by: list[str], values: list[str]) -> DataFrame:
    """The values of the row nearest to one probe, the first of equally near ones."""
    order = F.struct(F.abs(F.col(at) - probe), F.col(at))
    return df.groupBy(*by).agg(*[F.min_by(v, order).alias(v) for v in values])


def uniform_grid(extents: DataFrame, by: list[str], dx: str = "dx") -> DataFrame:
    """(by, i, x_km) from lo up to hi in steps of dx: one row per grid point."""
    steps = F.floor((F.col("hi") - F.col("lo")) / F.col(dx) + 1e-9).cast("long")
    out = extents.where("hi > lo").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
    return out.withColumn("x_km", F.col("lo") + F.col("i") * F.col(dx))


def regridded_all(grid: DataFrame, sources: list[tuple[DataFrame, list[str], Column | None]], by: list[str]) -> DataFrame:
    """grid (by, x_km, ...) with values of several sources interpolated linearly over x_km, ends held.

    sources: (rows with by and x_km, their value columns, tolerance). A grid point farther than the
    tolerance (which may name columns of the grid) from any finite sample is NULL; a group with fewer than
    two finite samples is NULL everywhere. All sides go into one order by one shuffle; the bracketing
    samples of every value come from windows over it.
    """
    values = [(v, k) for k, (_, names, _) in enumerate(sources) for v in names]
    both = grid.withColumn("_side", F.lit(1)).withColumns({f"_t{k}": F.lit(None).cast("double") if t is None else t for k, (_, _, t) in enumerate(sources)})
    for source, names, _ in sources:
        some = F.coalesce(*[F.col(v) for v in names]).isNotNull() & F.col("x_km").isNotNull()
        known = source.where(some).groupBy(*by, "x_km").agg(*[F.min(v).alias(v) for v in names])
        points = [F.when(F.col(v).isNotNull(), F.struct("x_km", F.col(v).cast("double").alias("v"))).alias(f"_p_{v}") for v in names]
        both = both.unionByName(known.select(*by, "x_km", F.lit(0).alias("_side"), *points), allowMissingColumns=True)
    whole = Window.partitionBy(*by)
    back = whole.orderBy("x_km", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = whole.orderBy("x_km", F.col("_side").desc()).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({f"_b_{v}": F.last(f"_p_{v}", ignorenulls=True).over(back) for v, _ in values} | {f"_n_{v}": F.count(f"_p_{v}").over(whole) for v, _ in values})
    both = both.withColumns({f"_a_{v}": F.first(f"_p_{v}", ignorenulls=True).over(ahead) for v, _ in values}).where("_side = 1")

    def value(name: str, k: int) -> Column:
        x, b, a, t = F.col("x_km"), F.col(f"_b_{name}"), F.col(f"_a_{name}"), F.col(f"_t{k}")
        inner = b["v"] + (a["v"] - b["v"]) * (x - b["x_km"]) / (a["x_km"] - b["x_km"])
        v = F.when(b.isNull(), a["v"]).when(a.isNull(), b["v"]).when(a["x_km"] == b["x_km"], b["v"]).otherwise(inner)
        near = F.least(F.coalesce(x - b["x_km"], F.lit(float("inf"))), F.coalesce(a["x_km"] - x, F.lit(float("inf"))))
        return F.when((F.col(f"_n_{name}") >= 2) & (t.isNull() | (near <= t)), v).alias(name)

    kept = [c for c in grid.columns if c not in {v for v, _ in values}]
    return both.select(*kept, *[value(v, k) for v, k in values])


def regridded(source: DataFrame, grid: DataFrame, value: str, by: list[str], tolerance: Column | None) -> DataFrame:
    """grid with one value of one source, as regridded_all."""
    return regridded_all(grid, [(source, [value], tolerance)], by)


def raster_cells(points: DataFrame, x: str, y: str, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """points with the cell (col, row) and tile whose centre is nearest; rows run down from y0."""
    out = points.withColumns({"col": F.bround((F.col(x) - x0) / dx).cast("long"), "row": F.bround((F.lit(y0) - F.col(y)) / dy).cast("long")})
    return out.withColumns({"tile_col": F.floor(F.col("col") / 512).cast("long"), "tile_row": F.floor(F.col("row") / 512).cast("long")})


def sampled(points: DataFrame, raster: DataFrame, values: list[str], pad: int = 42) -> DataFrame:
    """points (from raster_cells) with the raster's values in their cells, NULL outside.

    The raster is first cut down to the points' box, `pad` cells wider (5 km of 120 m), by tile and by cell.
    The box is four numbers; as literals they prune the tiles' partitions and the files' row groups, so
    what is shuffled doesn't grow with the raster. The join is on tile and cell.
    """
    keys = ["tile_col", "tile_row", "col", "row"]
    box = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("col", "row")]).first()
    if box.min_col is not None:
        for c in ("col", "row"):
            lo, hi = box[f"min_{c}"] - pad, box[f"max_{c}"] + pad
            raster = raster.where(F.col(c).between(lo, hi) & F.col(f"tile_{c}").between(lo // 512, hi // 512))
    return points.join(raster.select(*keys, *values), keys, "left")


def outer_aligned(parts: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of series on their keys; what a series lacks is NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, on, "full_outer")
    return out


def overlap(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi, reason): the stretch of x_km that both series cover; reason is empty unless there is none."""
    ext = lambda d, k: d.groupBy(*by).agg(F.min("x_km").alias(f"lo{k}"), F.max("x_km").alias(f"hi{k}"))
    out = ext(a, 0).join(ext(b, 1), by).select(*by, F.greatest("lo0", "lo1").alias("lo"), F.least("hi0", "hi1").alias("hi"))
    return out.withColumn("reason", F.when(F.col("hi") > F.col("lo"), "").otherwise("series do not overlap"))

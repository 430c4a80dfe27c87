"""Polylines that cross: pieces on a grid meet by equal cells, then are tested exactly; equal lines meet others once for all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnspark.operators.joins import nearest

Finish = Callable[[DataFrame], DataFrame]
#: Keys of equal lines that one row lists at most: a row with two lists becomes rows in memory, all of them at once.
LISTED = 128


def boxes(lines: DataFrame, points: str = "points") -> DataFrame:
    """lines with the bounds of their points (array of struct lon, lat)."""
    xs, ys = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return lines.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})


def segments(lines: DataFrame, key: str, points: str = "points") -> DataFrame:
    """(key, part, ax, ay, bx, by): one row per piece of a polyline."""
    pieces = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda k: F.struct(F.element_at(points, k).alias("a"), F.element_at(points, k + 1).alias("b")))
    out = lines.where(F.size(points) >= 2).select(key, F.posexplode(pieces).alias("part", "s"))
    return out.select(key, "part", F.col("s.a.lon").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lon").alias("bx"), F.col("s.b.lat").alias("by"))


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def crossing() -> Column:
    """Whether the pieces a-b and c-d share a point, ends and overlaps included."""
    a, b, c, d = (tuple(F.col(f"{p}{k}") for k in "xy") for p in "abcd")
    d1, d2, d3, d4 = _side(*c, *d, *a), _side(*c, *d, *b), _side(*a, *b, *c), _side(*a, *b, *d)
    between = lambda p, q, r: (r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0]))) & (r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1])))
    touching = ((d1 == 0) & between(c, d, a)) | ((d2 == 0) & between(c, d, b)) | ((d3 == 0) & between(a, b, c)) | ((d4 == 0) & between(a, b, d))
    return ((d1 != d2) & (d3 != d4) & (d1 * d2 <= 0) & (d3 * d4 <= 0) & ~((d1 == 0) & (d2 == 0))) | touching


def cells(pieces: DataFrame, size: float, p: str, q: str) -> DataFrame:
    """pieces with each grid cell that a piece passes through, and no more: column by column, the rows between its ends there.

    A long piece across the grid is as many rows as it is long, not as its box is large. Ends are widened a little, so
    rounding leaves no cell out.
    """
    ax, ay, bx, by = (F.col(f"{e}{c}") for e in (p, q) for c in "xy")
    pad = size * 1e-9
    x0, x1, y0, y1 = F.least(ax, bx), F.greatest(ax, bx), F.least(ay, by), F.greatest(ay, by)
    out = pieces.withColumn("cx", F.explode(F.sequence(F.floor((x0 - pad) / size), F.floor((x1 + pad) / size))))
    steep = (by - ay) / F.nullif(bx - ax, F.lit(0.0))
    at = lambda x: F.greatest(y0, F.least(y1, ay + steep * (F.greatest(x0, F.least(x1, x)) - ax)))
    left, right = at(F.col("cx") * size - pad), at((F.col("cx") + 1) * size + pad)
    lo, hi = F.coalesce(F.least(left, right), y0), F.coalesce(F.greatest(left, right), y1)
    lo, hi = F.when(steep.isNull(), y0).otherwise(lo), F.when(steep.isNull(), y1).otherwise(hi)
    return out.withColumn("cy", F.explode(F.sequence(F.floor((lo - pad) / size), F.floor((hi + pad) / size))))


def shapes(lines: DataFrame, key: str, name: str, *also: str) -> tuple[DataFrame, DataFrame]:
    """(key, name) of every key, name standing for all of its lines, and (name, points, also) once for each different name.

    Keys of equal lines (and equal columns `also`) have one name, their digest, so what is compared grows with the
    different lines and not with their copies.
    """
    own = lines.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("points", *also))).alias("lines"))
    own = own.withColumn(name, F.unhex(F.sha2(F.col("lines").cast("string"), 256)))
    return own.select(key, name), own.groupBy(name).agg(F.first("lines").alias("lines")).select(name, F.inline("lines"))


def _met(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float) -> DataFrame:
    """Pieces a-b of the left lines and c-d of the right ones that share a point, with the left piece's number."""
    own = cells(segments(left, left_key), cell, "a", "b")
    other = cells(segments(right, right_key).drop("part"), cell, "a", "b").toDF(right_key, "cx_", "cy_", "dx_", "dy_", "cx", "cy")
    met = own.join(other, ["cx", "cy"]).drop("cx", "cy")
    return met.toDF(left_key, "part", "ax", "ay", "bx", "by", right_key, "cx", "cy", "dx", "dy").where(crossing())


def _listed(keys: DataFrame, name: str, key: str) -> DataFrame:
    """(name, name_k, name_keys): the keys of each name, a NULL included, in lists of at most LISTED."""
    at = F.row_number().over(Window.partitionBy(name).orderBy(key)) - 1
    listed = F.concat(F.collect_list(key), F.array_repeat(F.lit(None), F.count_if(F.col(key).isNull()).cast("int")))
    return keys.withColumn(f"{name}_k", F.floor(at / LISTED)).groupBy(name, f"{name}_k").agg(listed.alias(f"{name}_keys"))


def _of_keys(found: DataFrame, keys: DataFrame, others: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """found (_own, _other, ...) with a row for each key of either name.

    A few pairs of names may be very many rows, so lists of keys are joined and dealt evenly, and become rows last.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in found.columns if c not in ("_own", "_other")]
    lists = found.join(_listed(keys, "_own", left_key), "_own").join(_listed(others, "_other", right_key), "_other")
    rows = lists.repartition(parts, "_own", "_own_k", "_other", "_other_k").select("_other_keys", *values, F.explode("_own_keys").alias(left_key))
    return rows.select(left_key, *values, F.explode("_other_keys").alias(right_key)).select(left_key, right_key, *values)


def intersecting(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float = 0.5) -> DataFrame:
    """(left_key, right_key) of polylines that share a point: one distributed join for all of them, equal lines as one."""
    (keys, own), (others, other) = shapes(left, left_key, "_own"), shapes(right, right_key, "_other")
    met = _met(own, other, "_own", "_other", cell).select("_own", "_other").distinct()
    return _of_keys(met, keys, others, left_key, right_key)


def clipped(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float = 0.5, finish: Finish = lambda found: found) -> DataFrame:
    """(left_key, right_key, first, last): the first and last crossing along the left line, as points.

    Pieces that lie on one another count by their end that comes first on the left line. Equal lines are compared once.
    finish: what else is made of the points, once for all keys of equal lines; it passes on columns that it doesn't know.
    """
    (keys, own), (others, other) = shapes(left, left_key, "_own"), shapes(right, right_key, "_other")
    return _of_keys(finish(_ends(own, other, "_own", "_other", cell)), keys, others, left_key, right_key)


def _ends(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float) -> DataFrame:
    """What `clipped` gives, all lines compared."""
    met = _met(left, right, left_key, right_key, cell)
    ux, uy, vx, vy = (F.col(p) - F.col(q) for p, q in (("bx", "ax"), ("by", "ay"), ("dx", "cx"), ("dy", "cy")))
    cross, length = ux * vy - uy * vx, ux * ux + uy * uy
    proper = ((F.col("cx") - F.col("ax")) * vy - (F.col("cy") - F.col("ay")) * vx) / F.nullif(cross, F.lit(0.0))
    along = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col(f"{p}x") - F.col("ax")) * ux + (F.col(f"{p}y") - F.col("ay")) * uy) / F.nullif(length, F.lit(0.0))))
    met = met.withColumn("s", F.coalesce(proper, F.least(along("c"), along("d")), F.lit(0.0)))
    at = F.struct("part", "s", (F.col("ax") + F.col("s") * ux).alias("lon"), (F.col("ay") + F.col("s") * uy).alias("lat"))
    out = met.groupBy(left_key, right_key).agg(F.min(at).alias("f"), F.max(at).alias("l"))
    point = lambda c: F.struct(F.col(f"{c}.lon").alias("lon"), F.col(f"{c}.lat").alias("lat"))
    return out.select(left_key, right_key, point("f").alias("first"), point("l").alias("last"))


def along_track_bounds(found: DataFrame, samples: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, lat_first, lat_last, lon_first, lon_last): along-track positions of the crossings of `clipped`.

    Each crossing takes the x_km of the track's sample nearest in latitude, and of the one nearest in
    longitude. One order by each coordinate serves all crossings; nothing is exploded.
    """
    ends = F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"{e}.lat").alias("lat"), F.col(f"{e}.lon").alias("lon")) for e in ("first", "last")])
    out = found.select(left_key, right_key, F.inline(ends))
    for c in ("lat", "lon"):
        known = samples.where(F.col(c).isNotNull()).groupBy(left_key, c).agg(F.min("x_km").alias(f"x_{c}"))
        out = nearest(out, known, c, [f"x_{c}"], [left_key])
    at = lambda c, e: F.max(F.when(F.col("end") == e, F.col(f"x_{c}"))).alias(f"{c}_{e}")
    return out.groupBy(left_key, right_key).agg(*[at(c, e) for c in ("lat", "lon") for e in ("first", "last")])


def track_bounds(tracks: DataFrame, lines: DataFrame, samples: DataFrame, left_key: str, right_key: str, cell: float = 0.5, finish: Finish = lambda found: found) -> DataFrame:
    """`along_track_bounds` of what `clipped` finds; tracks of equal points and samples are looked up once, as are equal lines.

    finish: what else is made of the bounds, once for all keys of equal lines; it passes on columns that it doesn't know.
    """
    near = samples.groupBy(left_key).agg(F.sort_array(F.collect_set(F.struct("lat", "lon", "x_km"))).alias("samples"))
    (keys, own), (others, other) = shapes(tracks.join(near, left_key, "left"), left_key, "_own", "samples"), shapes(lines, right_key, "_other")
    found = along_track_bounds(_ends(own.drop("samples"), other, "_own", "_other", cell), own.select("_own", F.inline("samples")), "_own", "_other")
    return _of_keys(finish(found), keys, others, left_key, right_key)


def search(frames: DataFrame, collections: list[str] | None = None, segments_: list[str] | None = None, years: tuple[int, int] | None = None, dates: str | None = None, geometry: DataFrame | None = None, key: str = "frame", geometry_key: str = "id", cell: float = 0.5) -> DataFrame:
    """Catalog rows of the collections, segments and years asked for, that meet any line of `geometry`.

    dates: "first/last" year, either of which may be left out. frames and geometry have points, and rows are
    told apart by key and geometry_key.
    """
    out = frames
    if collections:
        out = out.where(F.col("collection").isin(collections))
    if segments_:
        out = out.where(F.col("segment").isin(segments_))
    if dates:
        first, _, last = dates.partition("/")
        years = (int(first or -(1 << 31)), int(last or (1 << 31) - 1))
    if years:
        out = out.where(F.col("year").between(*years))
    if geometry is not None:
        (keys, own), (_, other) = shapes(out, key, "_own"), shapes(geometry, geometry_key, "_other")
        met = keys.join(_met(own, other, "_own", "_other", cell).select("_own"), "_own", "left_semi")
        out = out.join(met, key, "left_semi")
    return out

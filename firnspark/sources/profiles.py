"""Profiles as DataFrames: schema, checks, and the sources they come from."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnspark.constants import EARTH, LIGHT
from firnspark.functions.physics import clean
from firnspark.operators import series

_D = T.DoubleType()
PROFILE = T.StructType([T.StructField("segment_id", T.LongType()), T.StructField("i", T.LongType()), *(T.StructField(c, _D) for c in ("x_km", "amp", "h_surf", "h_bed", "geoid_m", "lat", "lon"))])

#: A profile made of the events table: each user is a segment over open water, a floating shelf and grounded ice.
#: The text runs in Spark and DuckDB alike.
EVENTS_SQL = """
WITH e AS (
  SELECT user_id, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM {events}
), k AS (
  SELECT *, CASE WHEN user_id % 2 = 0 THEN i ELSE n - 1 - i END AS k FROM e WHERE n >= 2
), r AS (
  SELECT *, CAST(k AS DOUBLE) / (n - 1) AS r,
         CAST((event_id % 11) - 5 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS eps_h,
         CAST((event_id % 7) - 3 AS DOUBLE) * CAST(0.4 AS DOUBLE) AS eps_a
  FROM k
), g AS (
  SELECT *, CAST(14.0 AS DOUBLE) + CAST(2.0 AS DOUBLE) * r AS geoid_m,
         CASE WHEN r < 0.12 AND k = 1 THEN CAST(0.0 AS DOUBLE)
              WHEN r < 0.12 THEN CAST(1.0 AS DOUBLE)
              WHEN r < 0.45 THEN CAST(400.0 AS DOUBLE)
              ELSE CAST(400.0 AS DOUBLE) + CAST(300.0 AS DOUBLE) * (r - CAST(0.45 AS DOUBLE)) END AS thick,
         CASE WHEN r < 0.12 THEN CAST(6.0 AS DOUBLE)
              WHEN r < 0.45 THEN CAST(43.19 AS DOUBLE)
              ELSE CAST(43.19 AS DOUBLE) + CAST(500.0 AS DOUBLE) * (r - CAST(0.45 AS DOUBLE)) END AS s_msl
  FROM r
)
SELECT user_id AS segment_id, CAST(i AS BIGINT) AS i, CAST(i AS DOUBLE) * CAST({step} AS DOUBLE) AS x_km,
       CASE WHEN i % 23 IN (5, 6, 7) THEN NULL
            ELSE CAST(-60.0 AS DOUBLE) - CAST(25.0 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), greatest(CAST(0.0 AS DOUBLE), (r - CAST(0.45 AS DOUBLE)) / CAST(0.15 AS DOUBLE))) + eps_a END AS amp,
       geoid_m + s_msl + eps_h AS h_surf,
       CASE WHEN i % 29 IN (11, 12) THEN NULL ELSE geoid_m + s_msl + eps_h - thick END AS h_bed,
       geoid_m,
       CAST(80.0 AS DOUBLE) + CAST(0.00448 AS DOUBLE) * k AS lat,
       CAST(-60.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (user_id % 10) AS lon,
       CAST(CASE WHEN user_id % 5 = 4 THEN 289.7777 ELSE -77.6457 END AS DOUBLE) AS vx,
       CAST(CASE WHEN user_id % 5 = 4 THEN -77.6457 ELSE -289.7777 END AS DOUBLE) AS vy
FROM g
"""


def from_events(spark: SparkSession, sf_dir: str, step_km: float = 0.5) -> DataFrame:
    return spark.sql(EVENTS_SQL.replace("{step}", repr(step_km)), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


#: Radar frames, layer picks and tracks made of the profile {p}, so that reading them gives it back: a sample every two
#: seconds, echoes at the picks' two-way times on a grid of 50 ns, an aircraft at 3 km, 20 samples a frame. Runs in Spark and
#: DuckDB alike.
TWTT_STEP = 5e-8
_S = f"((3000.0e0 - h_surf) * {2 / LIGHT!r})"
_B = f"({_S} + (h_surf - h_bed) * {2 * math.sqrt(EARTH.permittivity) / LIGHT!r})"
TRACK_SQL = "SELECT segment_id, CAST(i AS BIGINT) * 2000000 AS us, lat, lon FROM {p}"
LAYERS_SQL = f"""SELECT segment_id, 'standard:surface' AS layer, i * 2000000 + 400000 AS us, {_S} AS twtt, CAST(3000.0 AS DOUBLE) AS elev FROM {{p}} WHERE i % 31 <> 4
UNION ALL SELECT segment_id, 'standard:bottom', i * 2000000 + 400000, {_B}, CAST(3000.0 AS DOUBLE) FROM {{p}} WHERE h_bed IS NOT NULL AND i % 31 <> 4"""
_ECHO = "SELECT segment_id, CAST(floor(i / 20.0e0) AS BIGINT) AS frame, i * 2000000 AS us, CAST(floor({t} / 5.0e-8 + 0.5e0) AS BIGINT) + {o} AS bin, lat, lon, {a} AS data FROM {{p}} WHERE {w}"
FRAMES_SQL = " UNION ALL ".join(_ECHO.format(t=t, o=o, a=a, w=w) for t, v, w in ((_S, "1.0e-3", "h_surf IS NOT NULL"), (_B, "pow(10.0e0, amp / 10.0e0)", "h_bed IS NOT NULL AND amp IS NOT NULL")) for o, a in ((-1, f"0.5e0 * {v}"), (0, v), (1, f"0.25e0 * {v}")))


def radar_from_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, layers, track) with slow_time and, in frames and layers, twtt."""
    p = from_events(spark, sf_dir)
    read = lambda sql: spark.sql(sql, p=p).withColumn("slow_time", F.timestamp_micros("us")).drop("us")
    frames = read(FRAMES_SQL).withColumn("twtt", F.col("bin") * F.lit(TWTT_STEP)).drop("bin")
    return frames, read(LAYERS_SQL), read(TRACK_SQL)


def from_arrays(spark: SparkSession, segment_id: int, **columns) -> DataFrame:
    """A profile of one segment from sequences of equal length; geoid_m may be a number. NaN and None are NULL."""
    n = len(columns["x_km"])
    wide = {k: v if hasattr(v, "__len__") else [v] * n for k, v in ({"geoid_m": 0.0, "lat": None, "lon": None} | columns).items()}
    if bad := [k for k, v in wide.items() if len(v) != n]:
        raise ValueError(f"{bad} have another length than x_km")
    if n < 2 or any(b <= a for a, b in zip(wide["x_km"], wide["x_km"][1:], strict=False)):
        raise ValueError("x_km must have two values or more and increase")
    number = lambda v: None if v is None or v != v else float(v)
    rows = [(segment_id, k, *(number(wide[c.name][k]) for c in PROFILE.fields[2:])) for k in range(n)]
    return spark.createDataFrame(rows, PROFILE)


def faults(profile: DataFrame) -> DataFrame:
    """(segment_id, n, reason) of segments that are no profile: too short, or x that doesn't increase."""
    own = profile.withColumn("_d", series.difference("x_km"))
    out = own.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("_d"), F.count("x_km").alias("_x"))
    reason = F.when(F.col("n") < 2, "fewer than two samples").when(F.col("_x") < F.col("n"), "missing x").when(F.col("_d") <= 0, "x does not increase")
    return out.select("segment_id", "n", reason.alias("reason")).where("reason IS NOT NULL")


def csv_triple(spark: SparkSession, power: str, bed: str, surface: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Power, bed and surface tables with x_km; rows without an elevation are left out of the last two."""
    schema = T.StructType([T.StructField("along_track", _D), T.StructField("bed_power_dB", _D)])
    elevation = T.StructType([T.StructField("along_track", _D), T.StructField("wgs84", _D)])
    read = lambda path, s: spark.read.schema(s).option("enforceSchema", False).csv(path, header=True).withColumn("x_km", F.col("along_track") / 1000)
    p = read(power, schema).withColumn("bed_power_dB", clean(F.col("bed_power_dB")))
    return p, *(read(x, elevation).withColumn("wgs84", clean(F.col("wgs84"))).na.drop(subset=["wgs84"]) for x in (bed, surface))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: its properties, and points for its line (array of struct lon, lat)."""
    raw = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    points = F.transform(F.col("f.geometry.coordinates"), lambda p: F.struct(p[0].cast("double").alias("lon"), p[1].cast("double").alias("lat")))
    return raw.select("f.properties.*", points.alias("points"))


def write_geojson(lines: DataFrame, path: str) -> None:
    """All features in one job, one JSON object a row (newline-delimited GeoJSON)."""
    properties = F.struct(*[c for c in lines.columns if c != "points"])
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    lines.select(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")).write.mode("overwrite").json(path)


def raster(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Cells of the variables (of a table var, tile_col, tile_row, col, row, value), one column each."""
    known = {"vx", "vy", "geoid", "bed", "surface"}
    if bad := set(variables) - known:
        raise KeyError(f"no such variable: {sorted(bad)}")
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no raster table at {path}: convert the grid to (var, col, row, value) with write_raster, or pass a number instead") from e
    keys = ["tile_col", "tile_row", "col", "row"]
    # Filters on tiles and cells reach the scan through the grouping; one variable needs none.
    if len(variables) == 1:
        return table.where(F.col("var") == variables[0]).select(*keys, F.col("value").alias(variables[0]))
    one = lambda v: F.max(F.when(F.col("var") == v, F.col("value"))).alias(v)
    return table.where(F.col("var").isin(variables)).groupBy(*keys).agg(*[one(v) for v in variables])


def write_raster(cells: DataFrame, path: str) -> None:
    """Store cells (var, col, row, value) by variable and tile, unless the table is there already."""
    tiles = cells.withColumns({"tile_col": F.floor(F.col("col") / 512).cast("long"), "tile_row": F.floor(F.col("row") / 512).cast("long")})
    tiles.repartition("var", "tile_col", "tile_row").write.mode("ignore").partitionBy("var", "tile_col", "tile_row").parquet(path)


def parse_slice(text: str) -> tuple[int | None, int | None]:
    """'7:11', ':3', '4:' as bounds."""
    lo, _, hi = text.partition(":")
    return (int(lo) if lo else None, int(hi) if hi else None)


def sliced(frames: DataFrame, by: str, order: str, bounds: tuple[int | None, int | None]) -> DataFrame:
    """Frames by position within `by`, from the first bound up to but without the second."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    lo, hi = bounds
    out = frames.withColumn("_k", at).where(F.col("_k") >= (lo or 0))
    return (out if hi is None else out.where(F.col("_k") < hi)).drop("_k")

"""Catalog tables: termini from their converted shapes, regions and labels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnspark.functions.projection import inverse


def termini(names: DataFrame, shapes: DataFrame, end_year: int | None = None, start_year: int | None = None) -> DataFrame:
    """names (row, year, ...) with points (lon, lat in degrees) of shapes (row, points in projected metres), by row.

    Both are the converted tables of one release; a row that lacks either part is left out. Names are few,
    but nothing is broadcast by force.
    """
    years = names
    if start_year is not None:
        years = years.where(F.col("year") >= start_year)
    if end_year is not None:
        years = years.where(F.col("year") <= end_year)

    def degrees(p):
        lat, lon = inverse(p["x"], p["y"])
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return years.join(shapes.select("row", F.transform("points", degrees).alias("points")), "row")


def region(regions: DataFrame, name: str) -> DataFrame:
    """The rows of the regions table with this name; none is an error only for who needs one."""
    return regions.where(F.col("name") == name)


def labelled(df: DataFrame, column: str, labels: list) -> DataFrame:
    """Rows whose column has one of the labels; a filter that reaches the scan."""
    return df.where(F.col(column).isin(labels))


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only within one process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="firnspark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written as a table below the shared folder and read again: what several plans start from is made once.

    The table survives the loss of executors and cuts the plan; the folder's own clean-up takes it away.
    """
    path = f"{shared(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

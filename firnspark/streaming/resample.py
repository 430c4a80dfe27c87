"""The tumbling mean as a stream: an extension, with the batch result as its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_mean(stream: DataFrame, time: str, interval: str, values: list[str], by: list[str], late: str = "1 second") -> DataFrame:
    """Mean in windows of `interval` of a stream, emitted when the watermark passes the window; later rows are dropped."""
    out = stream.withWatermark(time, late).groupBy(*by, F.window(time, interval).alias("_w"))
    return out.agg(*[F.avg(v).alias(v) for v in values]).select(*by, F.col("_w.start").alias(time), *values)

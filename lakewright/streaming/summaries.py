"""Residual and sample summaries over event streams, with watermarks; an extra beyond batch parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.functions.special import finite


def windowed_summary(events: DataFrame, *, time: str, by: list[str], value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """n, mean, sd and RMS of finite values per tumbling window and group; on a stream rows later than ``late`` are dropped."""
    v = F.when(finite(F.col(value)), F.col(value))
    out = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.sqrt(F.avg(v * v)).alias("rms"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "mean", "sd", "rms")

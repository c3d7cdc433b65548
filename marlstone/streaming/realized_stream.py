"""Realised measures of a stream of returns, by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_realized(stream: DataFrame, ts: str, r: str, key: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Realised variance, semivariances and counts by tumbling window; rows later than ``late`` are left out by the
    watermark. Works on batch frames too."""
    x = F.col(r)
    half = lambda c: F.sum(F.when(c, x * x).otherwise(0.0))
    out = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), *key)
    return out.agg(F.count(x).alias("n_obs"), F.sum(x * x).alias("rv"), half(x > 0).alias("rsv_pos"), half(x < 0).alias("rsv_neg")).select(
        F.col("window.start").alias("start"), *key, "n_obs", "rv", "rsv_pos", "rsv_neg")

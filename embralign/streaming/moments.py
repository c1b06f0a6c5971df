"""An extension: moments of a stream by event-time window (they add up, so late data within the watermark does too)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, time: str, x: str, y: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(
        F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")
    )
    return sums.select(F.col("window.start").alias("start"), "n", "sx", "sy", "sxx", "syy", "sxy")

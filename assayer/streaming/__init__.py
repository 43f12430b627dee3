"""Profiles of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import core


def windowed_profile(stream: DataFrame, time: str, columns: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, missing values, extremes and means of numeric columns in tumbling windows.

    Late rows are dropped by the watermark; state is one row a window.
    """
    parts = []
    for c in columns:
        x = core.finite(F.col(c))
        parts += [F.count_if(F.col(c).isNull()).alias(f"{c}_missing"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.avg(x).alias(f"{c}_mean")]
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("rows"), *parts)

"""The look-back aggregate on a stream. Beyond the batch operators' scope: windows are aligned to the clock, not to an episode's start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_stats(stream: DataFrame, length: str = "24 hours", slide: str = "24 hours", late: str = "6 hours") -> DataFrame:
    """entity, item, window start and end, count, mean, least, most of each window; events later than ``late`` are dropped by the watermark. ``stream``: entity, item, ts (timestamp), value."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", length, slide), "entity", "item")
        .agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
        .select("entity", "item", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "count", "mean", "least", "most")
    )

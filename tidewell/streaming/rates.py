"""Windowed statistics of an event stream: the streaming form of grouped moments and misfit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(
    events: DataFrame, by: str = "event_type", value: str = "value", time: str = "ts", width: str = "1 day", late: str = "2 hours"
) -> DataFrame:
    """(window start, by): count, mean and std of each window; rows later than `late` behind the watermark are dropped by the engine."""
    g = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return g.agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    ).select(F.col("w.start").alias("start"), by, "n", "mean", "std")


def windowed_misfit(events: DataFrame, expected: DataFrame, by: str = "event_type", **window) -> DataFrame:
    """Moments against an expected mean for each group (a static table, joined to the stream): residual, and residual over std (0 or unknown counts as 1)."""
    m = windowed_moments(events, by, **window).join(expected, by)
    s = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return m.select(
        "start", by, "n", "mean", (F.col("mean") - F.col("expected")).alias("residual"),
        ((F.col("mean") - F.col("expected")) / s).alias("residual_z")
    )

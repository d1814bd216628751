"""An extension: the hourly grid's means kept up to date from a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_means(stream: DataFrame, late: str = "2 hours", key: str = "device", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, ts, value): means of tumbling hours, final once the watermark has passed; readings later than ``late`` are
    not counted. Empty hours are made when the grid is read, as a stream can't tell an hour that is to come from a gap."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    means = timed.groupBy(key, F.window("_t", "1 hour")).agg(F.avg(value).alias("value"))
    return means.select(key, F.col("window.start").alias("ts"), "value")

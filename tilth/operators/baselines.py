"""Forecasts without a fitted model. Row t holds the forecast for t made h hours before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import over


def persistence(h: int, column: str = "value", key: str = "device") -> Column:
    return F.lag(column, h).over(over(key))


def seasonal_naive(h: int, period: int = 24, column: str = "value", key: str = "device") -> Column:
    return F.lag(column, period * math.ceil(h / period)).over(over(key))


def drydown_trend(h: int, window: int = 24, column: str = "value", key: str = "device") -> Column:
    last, first = F.lag(column, h).over(over(key)), F.lag(column, h + window).over(over(key))
    return last + (last - first) / window * h


def hourly_deltas(grid: DataFrame, column: str = "value", key: str = "device") -> DataFrame:
    """The grid with ``delta``, the change from the hour before where both hours are observed."""
    return grid.withColumn("delta", F.col(column) - F.lag(column, 1).over(over(key)))


def climatology(train: DataFrame, column: str = "value", key: str = "device") -> DataFrame:
    """(key, hour, climatology): mean by hour of day."""
    return train.groupBy(key, F.hour("ts").alias("hour")).agg(F.avg(column).alias("climatology"))


def delta_table(train: DataFrame, column: str = "value", key: str = "device") -> DataFrame:
    """(key, hour, delta): mean change into each hour of day over gap-free pairs, 0 where there is none."""
    means = hourly_deltas(train, column, key).groupBy(key, F.hour("ts").alias("hour")).agg(F.avg("delta").alias("delta"))
    hours = train.select(key).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return hours.join(means, [key, "hour"], "left").select(key, "hour", F.coalesce("delta", F.lit(0.0)).alias("delta"))


def cumulative_drift(table: DataFrame, h: int, key: str = "device") -> DataFrame:
    """(key, hour, drift): the sum of the h hourly changes that end at each hour, round the clock."""
    steps = table.select(key, F.col("hour").alias("to"), F.explode(F.sequence(F.lit(1 - h), F.lit(0))).alias("o"))
    back = steps.withColumn("hour", F.pmod(F.col("to") + F.col("o"), F.lit(24))).drop("o")
    return back.join(table, [key, "hour"]).groupBy(key, F.col("to").alias("hour")).agg(F.sum("delta").alias("drift"))


def diurnal_drift(grid: DataFrame, train: DataFrame, h: int, column: str = "value", key: str = "device") -> DataFrame:
    """The grid with ``forecast``: the value h hours before plus the usual drift since."""
    drift = cumulative_drift(delta_table(train, column, key), h, key)  # 24 rows a key
    last = grid.withColumn("_last", persistence(h, column, key)).withColumn("hour", F.hour("ts"))
    return last.join(drift, [key, "hour"], "left").withColumn("forecast", F.col("_last") + F.col("drift")).drop("_last", "drift", "hour")


def diurnal_drift_temp(grid: DataFrame, train: DataFrame, h: int, temp: str = "temp", bins: int = 3, column: str = "value", key: str = "device") -> DataFrame:
    """Drift by temperature class at the time of forecasting: edges are quantiles of the training temperatures, equal
    goes up; a class that never saw an hour, and a missing temperature, fall back on the drift over all."""
    cuts = train.groupBy(key).agg(F.percentile(temp, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("_e"))

    def classed(df: DataFrame, t: Column) -> DataFrame:
        return df.join(cuts, key, "left").withColumn("bin", F.when(t.isNotNull(), F.size(F.filter("_e", lambda e: t >= e)))).drop("_e")

    pooled = delta_table(train, column, key)
    own = classed(hourly_deltas(train, column, key), F.col(temp)).groupBy(key, "bin", F.hour("ts").alias("hour")).agg(F.avg("delta").alias("_d"))
    cells = pooled.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = cells.join(own, [key, "bin", "hour"], "left").select(key, "bin", "hour", F.coalesce("_d", "delta").alias("delta"))
    full = full.unionByName(pooled.withColumn("bin", F.lit(-1)))
    keyed = full.withColumn("_kb", F.struct(key, "bin"))
    drift = cumulative_drift(keyed.select("_kb", "hour", "delta"), h, "_kb").select(F.col(f"_kb.{key}").alias(key), F.col("_kb.bin").alias("bin"), "hour", "drift")
    w = over(key)
    last = grid.withColumn("_last", F.lag(column, h).over(w)).withColumn("_t", F.lag(temp, h).over(w)).withColumn("hour", F.hour("ts"))
    last = classed(last, F.col("_t")).withColumn("bin", F.coalesce("bin", F.lit(-1)))
    return last.join(drift, [key, "bin", "hour"], "left").withColumn("forecast", F.col("_last") + F.col("drift")).drop("_last", "_t", "drift", "hour", "bin")

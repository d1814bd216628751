"""Regular grids: readings averaged into bins, with a row for every bin. Empty bins stay null; nothing is imputed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bins of a key's grid beyond which its timestamps are taken for wrong (200 years of hours).
MOST_BINS = 1_753_200


def resample(rows: DataFrame, hours: int = 1, values: tuple[str, ...] = ("value",), key: str = "device", ts: str = "ts", most_bins: int = MOST_BINS) -> DataFrame:
    """(key, ts, i, *values): means over left-closed, left-labelled bins of ``hours``, from each key's first bin to its
    last; ``i`` numbers the bins from 0. Readings are summed before anything is joined, so a window over a key runs over
    its bins and not over its readings. A key whose readings span more than ``most_bins`` is an error, as one wrong
    timestamp would otherwise make a grid of any length."""
    size = hours * 3600
    bin_no = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000 * size)).cast("long")
    means = rows.where(F.col(ts).isNotNull()).groupBy(F.col(key), bin_no.alias("_b")).agg(*[F.avg(v).alias(v) for v in values])
    span = means.groupBy(key).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    wrong = F.raise_error(F.concat(F.lit("readings span more bins than most_bins: "), F.col(key).cast("string"))).cast("bigint")
    last = F.when(F.col("_hi") - F.col("_lo") < most_bins, F.col("_hi")).otherwise(wrong)
    every = span.select(key, "_lo", F.explode(F.sequence("_lo", last)).alias("_b"))
    at = F.timestamp_seconds(F.col("_b") * size).cast("timestamp_ntz")
    return every.join(means, [key, "_b"], "left").select(key, at.alias("ts"), (F.col("_b") - F.col("_lo")).alias("i"), *values)


def over(key: str = "device", order: str = "ts"):
    """Every ordered window of a grid uses this one specification, so one exchange and sort serve them all."""
    return Window.partitionBy(key).orderBy(order)


def gap_report(grid: DataFrame, values: tuple[str, ...] = ("value",), key: str = "device") -> DataFrame:
    """Missing bins of each key and column."""
    return grid.groupBy(key).agg(*[(F.count("*") - F.count(v)).alias(f"{v}_missing") for v in values])


def longest_gap(grid: DataFrame, value: str = "value", key: str = "device") -> DataFrame:
    """(key, longest_gap): the longest run of missing bins, by gaps and islands."""
    w = over(key)
    island = F.sum(F.col(value).isNotNull().cast("int")).over(w)
    runs = grid.withColumn("_g", island).where(F.col(value).isNull()).groupBy(key, "_g").agg(F.count("*").alias("n"))
    longest = runs.groupBy(key).agg(F.max("n").alias("n"))
    return grid.select(key).distinct().join(longest, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("longest_gap"))


def aligned(grid: DataFrame, value: str = "value", key: str = "device") -> DataFrame:
    """Every key on the union of all keys' bins; a bin a key lacks is null. Keys and hours are small dimensions."""
    keys, times = grid.select(key).distinct(), grid.select("ts").distinct()
    return keys.crossJoin(times).join(grid.select(key, "ts", value), [key, "ts"], "left")

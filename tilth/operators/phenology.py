"""Degree days over seasons and the dates at which they pass given sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds (exclusive) of the five climate regions, in degree days above 10 C.
REGIONS = (("I", 1389.0), ("II", 1667.0), ("III", 1944.0), ("IV", 2222.0))


def daily_gdd(high: Column, low: Column, base: float = 10.0, cap: float | None = None) -> Column:
    """Mean of the (capped) extremes above the base; missing stays missing."""
    h, lo = (F.least(high, F.lit(cap)), F.least(low, F.lit(cap))) if cap is not None else (high, low)
    return F.when(high.isNotNull() & low.isNotNull(), F.greatest((h + lo) / 2 - base, F.lit(0.0)))


def region(total: Column) -> Column:
    out = F.when(total.isNull(), None)
    for name, upper in REGIONS:
        out = out.when(total < upper, name)
    return out.otherwise("V")


def trajectories(daily: DataFrame, seasons: DataFrame, base: float = 10.0, cap: float | None = None) -> DataFrame:
    """(season, date, gdd, cumulative, is_gap, missing): every day of each season of ``seasons`` (season, first, last);
    a day without weather adds nothing and is counted as missing."""
    days = seasons.select("season", F.explode(F.sequence("first", "last")).alias("date"))
    w = Window.partitionBy("season").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = days.join(daily, "date", "left").withColumn("gdd", daily_gdd(F.col("temp_max_c"), F.col("temp_min_c"), base, cap))
    return rows.select(
        "season", "date", "gdd", F.coalesce(F.sum("gdd").over(w), F.lit(0.0)).alias("cumulative"), F.col("gdd").isNull().alias("is_gap"),
        F.sum(F.col("gdd").isNull().cast("long")).over(w).alias("missing"),
    )


def crossings(rows: DataFrame, bands: dict[str, float]) -> DataFrame:
    """(season, band, threshold, date): first day the sum reaches each threshold, null if it never does."""
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.lit(v).alias("threshold")) for k, v in bands.items()]))
    wide = rows.select("season", "date", "cumulative", names.alias("b"))
    return wide.groupBy("season", F.col("b.band").alias("band"), F.col("b.threshold").alias("threshold")).agg(
        F.min(F.when(F.col("cumulative") >= F.col("b.threshold"), F.col("date"))).alias("date")
    )

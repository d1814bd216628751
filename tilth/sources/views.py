"""Sensor, weather, season, pixel and file tables as views of the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def not_nan(df: DataFrame) -> DataFrame:
    """NaN marks a missing reading at the edges of the system; inside, missing is null."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, ts, value): the event stream as irregular sensor readings."""
    events = table(spark, sf_dir, "events")
    return not_nan(events.select(F.col("event_type").alias("device"), "ts", "value"))


def user_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, ts, value) by user: many devices with long gaps."""
    events = table(spark, sf_dir, "events")
    return not_nan(events.select(F.col("user_id").cast("string").alias("device"), "ts", "value"))


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, temp_max_c, temp_min_c, precip_mm, et0_mm): daily figures drawn from the stream. Every seventh day has no
    row and every fifth no precipitation, so that gaps are met."""
    day = F.to_date("ts")
    kind = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    rows = table(spark, sf_dir, "events").groupBy(day.alias("date")).agg(
        (F.max("value") / 20).alias("temp_max_c"),
        (F.avg("value") / 20).alias("temp_min_c"),
        (F.sum(kind("error")) / 1000).alias("precip_mm"),
        (F.avg(kind("view")) / 20).alias("et0_mm"),
    )
    n = F.dayofyear("date")
    return rows.where(n % 7 != 0).withColumn("precip_mm", F.when(n % 5 != 0, F.col("precip_mm")))


def season_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, temp_max_c, temp_min_c): several years of daily extremes."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.max("o_totalprice") / 15000).alias("temp_max_c"), (F.min("o_totalprice") / 15000).alias("temp_min_c")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, band, pos, value): raster cells. Band 0 is the first half of each vector, band 1 the second."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("zone"), F.posexplode("embedding").alias("k", "v"))
    half = F.lit(32)
    return rows.select(
        "zone",
        (F.col("k") >= half).cast("int").alias("band"),
        (F.col("vec_id") * half + F.col("k") % half).alias("pos"),
        F.col("v").cast("double").alias("value"),
    )

"""Features on a grid, all causal but the lead-time sums of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import over


def lag_features(grid: DataFrame, column: str = "value", lags: tuple[int, ...] = (1, 6, 24), key: str = "device") -> DataFrame:
    return grid.select("*", *[F.lag(column, k).over(over(key)).alias(f"{column}_lag_{k}") for k in lags])


def rolling_features(grid: DataFrame, column: str = "value", hours: tuple[int, ...] = (1, 6, 24), key: str = "device") -> DataFrame:
    """Mean and sample deviation over (t - w, t]; a single value has no deviation."""
    out = []
    for h in hours:
        w = over(key).rowsBetween(1 - h, 0)
        out += [F.avg(column).over(w).alias(f"{column}_mean_{h}h"), F.stddev_samp(column).over(w).alias(f"{column}_std_{h}h")]
    return grid.select("*", *out)


def growing_degree_days(daily: DataFrame, temp: str, base: float = 10.0, key: str = "device", order: str = "date") -> DataFrame:
    """Running sum of max(temp - base, 0); null on a day without a temperature, which adds nothing."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    gain = F.when(F.col(temp).isNotNull(), F.greatest(F.col(temp) - base, F.lit(0.0)))
    return daily.withColumn("gdd", F.when(F.col(temp).isNotNull(), F.sum(gain).over(w)))


def forward_sum(column: Column, hours: int, key: str = "device") -> Column:
    """Sum over (t, t + hours]; null where any hour of it is missing or beyond the grid."""
    w = over(key).rowsBetween(1, hours)
    return F.when(F.count(column).over(w) == hours, F.sum(column).over(w))


def lead_time_features(frame: DataFrame, horizons: tuple[int, ...], columns: tuple[str, ...] = ("precip_mm", "et0_mm"), key: str = "device") -> DataFrame:
    """Daily totals spread evenly over their hours and summed over the hours a forecast looks ahead."""
    return frame.select("*", *[forward_sum(F.col(c) / 24, h, key).alias(f"{c}_next_{h}h") for c in columns for h in horizons])


def freshest_age(lead_h: int) -> int:
    """Whole days by which a forecast must be older than the hours it speaks of, to be out ``lead_h`` hours before them."""
    days, rest = divmod(lead_h, 24)
    if lead_h < 1:
        raise ValueError(f"a lead of {lead_h} hours looks back")
    return days + (rest > 0)


def vintage_features(frame: DataFrame, horizons: tuple[int, ...], columns: tuple[str, ...] = ("precip_mm", "et0_mm"), key: str = "device") -> DataFrame:
    """Lead-time sums from hourly archived forecasts in columns ``<name>_prev<days>``, never fresher than causal."""
    need = {f"{c}_prev{freshest_age(h)}" for c in columns for h in horizons}
    if missing := sorted(need - set(frame.columns)):
        raise ValueError(f"forecast columns are missing: {', '.join(missing)}")
    return frame.select("*", *[forward_sum(F.col(f"{c}_prev{freshest_age(h)}"), h, key).alias(f"{c}_next_{h}h") for c in columns for h in horizons])


def attach_weather(frame: DataFrame, daily: DataFrame, columns: tuple[str, ...], base: float = 10.0, key: str = "device") -> DataFrame:
    """Each column's last known daily value at every hour (each column on its own, of any age), the mean temperature and
    the degree days gathered so far. Days, one row each, are repeated for every key and carried forward in the grid."""
    mean = (F.col("temp_max_c") + F.col("temp_min_c")) / 2
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    gain = F.greatest(mean - base, F.lit(0.0))
    days = daily.select("date", *columns, mean.alias("temp_mean_c"), F.when(mean.isNotNull(), F.sum(F.when(mean.isNotNull(), gain)).over(w)).alias("gdd"))
    names = [*columns, "temp_mean_c", "gdd"]
    keys = frame.select(key).distinct()
    points = keys.crossJoin(days.select(F.col("date").cast("timestamp_ntz").alias("ts"), *names))
    both = frame.withColumn("_own", F.lit(True)).join(points, [key, "ts"], "full")
    run = over(key).rowsBetween(Window.unboundedPreceding, 0)
    filled = [F.last(c, ignorenulls=True).over(run).alias(c) for c in names]
    return both.select(*[c for c in frame.columns], "_own", *filled).where("_own").drop("_own")


def ewma_frame(frame: DataFrame, column: str, out: str, halflife: float, least: int = 24, key: str | list[str] = "device", order: str = "ts", block: int = 400) -> DataFrame:
    """``frame`` with ``out``, the exponentially weighted mean of ``column`` up to each row: weights halve every ``halflife``
    observed values, missing ones carry the mean on, and it is null before ``least`` values.

    Weights are counted anew in blocks of ``block`` halflives; the sums of the block before are carried on, and what lies
    before that weighs 2^-block at most, which is nothing in double precision. So a series may be of any length."""
    keys = [key] if isinstance(key, str) else key
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    size = max(1, int(block * halflife))
    counted = frame.withColumn("_k", F.count(column).over(run)).withColumn("_b", F.floor((F.col("_k") - 1) / F.lit(size)))
    weight = F.pow(F.lit(2.0), (F.col("_k") - 1 - F.col("_b") * F.lit(size)) / F.lit(float(halflife)))
    counted = counted.withColumn("_w", F.when(F.col(column).isNotNull(), weight))
    totals = counted.where("_w is not null").groupBy(*keys, (F.col("_b") + 1).alias("_b")).agg(F.sum(F.col(column) * F.col("_w")).alias("_s0"), F.sum("_w").alias("_w0"))
    faded = F.pow(F.lit(2.0), F.lit(-size / float(halflife)))
    both = counted.join(totals.select(*keys, "_b", (F.col("_s0") * faded).alias("_s0"), (F.col("_w0") * faded).alias("_w0")), [*keys, "_b"], "left")
    part = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda x, carried: F.coalesce(F.sum(x).over(part), F.lit(0.0)) + F.coalesce(F.col(carried), F.lit(0.0))
    mean = total(F.col(column) * F.col("_w"), "_s0") / total(F.col("_w"), "_w0")
    return both.withColumn(out, F.when(F.col("_k") >= least, mean)).select(*frame.columns, out)

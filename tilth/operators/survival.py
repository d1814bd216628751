"""Time to a drawdown, with gaps as censoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import over


def survival_labels(grid: DataFrame, drop: float, max_h: int, column: str = "value", key: str = "device") -> DataFrame:
    """(key, ts, i, value, time, event) for observed hours: hours until the value has fallen by ``drop``, if that comes
    before the first gap; else the observed hours until the gap or the grid's end, without an event. A row that sees all
    ``max_h`` hours without one has time max_h + 1. Rows followed at once by a gap are left out."""
    w = over(key).rowsBetween(1, max_h)
    ahead = F.collect_list(F.struct(F.col(column).alias("v"))).over(w)  # the struct keeps missing values in place
    rows = grid.where(F.lit(True)).withColumn("_a", ahead).where(F.col(column).isNotNull())
    hit = F.array_position(F.transform("_a", lambda x: F.coalesce(x["v"] <= F.col(column) - drop, F.lit(False))), True)
    gap = F.array_position(F.transform("_a", lambda x: x["v"].isNull()), True)
    rows = rows.withColumn("_hit", hit).withColumn("_seen", F.when(gap > 0, gap - 1).otherwise(F.size("_a").cast("long")))
    event = (F.col("_hit") > 0) & (F.col("_hit") <= F.col("_seen"))
    time = F.when(event, F.col("_hit")).when(F.col("_seen") == max_h, F.lit(max_h + 1)).otherwise(F.col("_seen"))
    out = rows.select(key, "ts", "i", column, time.cast("int").alias("time"), event.alias("event"))
    return out.where("time > 0")


def kaplan_meier(labels: DataFrame, max_h: int, key: str = "device", censoring: bool = False) -> DataFrame:
    """(key, h, s): the product-limit curve on 1..max_h of the event, or of the censoring with roles swapped; in either,
    everybody who reaches an hour is at risk in it. Hours nobody is at risk leave the curve level."""
    happened = ~F.col("event") & (F.col("time") <= max_h) if censoring else F.col("event")
    counts = labels.groupBy(key, F.col("time").alias("h")).agg(
        F.count("*").alias("out"), F.count_if(happened).alias("d")
    )
    total = labels.groupBy(key).agg(F.count("*").alias("n"))
    hours = total.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(max_h))))
    w = Window.partitionBy(key).orderBy("h")
    left = F.coalesce(F.sum("out").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = hours.join(counts, [key, "h"], "left").fillna(0, ["out", "d"]).withColumn("r", F.col("n") - left)
    factor = F.when(F.col("r") > 0, 1 - F.col("d") / F.col("r")).otherwise(1.0)
    return table.withColumn("f", factor).select(key, "h", F.product("f").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))


def censored_brier(labels: DataFrame, surv: DataFrame, cens: DataFrame, key: str = "device") -> DataFrame:
    """(key, h, brier): inverse-probability-weighted Brier score of one survival curve a key at each horizon; weights use
    the censoring curve just before the event, or at h for those still there, floored at 1e-6; the divisor is all rows."""
    g = cens.select(key, F.col("h").alias("gh"), F.greatest("s", F.lit(1e-6)).alias("g")).unionByName(
        cens.select(key).distinct().select(key, F.lit(0).alias("gh"), F.lit(1.0).alias("g"))
    )
    # labels fall into few (time, event) classes, so scores are sums over those
    classes = labels.groupBy(key, "time", "event").agg(F.count("*").alias("n"))
    rows = classes.join(surv, key)
    rows = rows.join(g.select(key, F.col("gh").alias("h"), F.col("g").alias("g_h")), [key, "h"])
    rows = rows.withColumn("gh", F.col("time") - 1).join(g.select(key, "gh", F.col("g").alias("g_t")), [key, "gh"], "left")
    gone = F.col("event") & (F.col("time") <= F.col("h"))
    there = F.col("time") > F.col("h")
    term = F.when(gone, F.pow("s", F.lit(2)) / F.col("g_t")).when(there, F.pow(1 - F.col("s"), 2) / F.col("g_h")).otherwise(0.0)
    return rows.groupBy(key, "h").agg((F.sum(term * F.col("n")) / F.sum("n")).alias("brier"))


def person_periods(labels: DataFrame, max_h: int) -> DataFrame:
    """A row for each hour at risk: ``period`` and ``died``."""
    rows = labels.withColumn("period", F.explode(F.sequence(F.lit(1), F.least(F.col("time"), F.lit(max_h)))))
    return rows.withColumn("died", F.col("event") & (F.col("period") == F.col("time")))


def clock_survival(mu: Column, drop: float, h: Column) -> Column:
    """1 until the drop is reached at the present drift, then 0; always 1 without a downward drift, null without one known."""
    return F.when(mu.isNull(), None).when(mu >= 0, 1.0).when(h < F.lit(drop) / -mu, 1.0).otherwise(0.0)


def quantile_time(surv: DataFrame, q: float, key: str = "device") -> DataFrame:
    """(key, hours): first hour with 1 - S >= q, null if beyond the window."""
    return surv.groupBy(key).agg(F.min(F.when(1 - F.col("s") >= q, F.col("h"))).alias("hours"))


def hazard_columns(period: Column, hour: Column, edges: tuple[int, ...] = (3, 6, 12, 24)) -> dict[str, Column]:
    """Design of the hourly hazard: a dummy for each band of periods (upper edges included) and the hour's cycle."""
    lows, angle = (0, *edges), 2 * F.pi() * hour / 24
    bands = {f"band_{i}": ((period > lo) & (period <= hi if hi else F.lit(True))).cast("int") for i, (lo, hi) in enumerate(zip(lows, (*edges, None), strict=True))}
    return bands | {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}

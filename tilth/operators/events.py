"""Rise events, what caused them, and rain gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import over


def rise_events(grid: DataFrame, min_jump: float = 0.5, max_span: int = 12, tol: float = 0.0, column: str = "value", key: str = "device") -> DataFrame:
    """(key, start, end, trough, peak, jump, span_h): maximal runs of hourly rises above ``tol`` that climb ``min_jump``
    or more within ``max_span`` hours, with an observed hour that doesn't rise on each side of the run. A run that a gap
    or the grid's end borders is left out, as its extent isn't known."""
    w = over(key)
    d = F.col(column) - F.lag(column).over(w)
    steps = grid.select(key, "ts", column, F.lag("ts").over(w).alias("from_ts"), F.lag(column).over(w).alias("from_v"), d.alias("d"))
    rising = F.coalesce(F.col("d") > tol, F.lit(False))
    steps = steps.withColumn("up", rising)
    steps = steps.withColumn("run", F.sum(F.when(F.col("up"), 0).otherwise(1)).over(w))
    flat = F.col("d").isNotNull() & ~F.col("up")
    steps = steps.withColumn("clear_before", F.lag(flat).over(w)).withColumn("clear_after", F.lead(flat).over(w))
    runs = steps.where("up").groupBy(key, "run").agg(
        F.min("from_ts").alias("start"), F.max("ts").alias("end"), F.min_by("from_v", "ts").alias("trough"), F.max_by(column, "ts").alias("peak"),
        F.count("*").alias("span_h"), F.min_by("clear_before", "ts").alias("before"), F.max_by("clear_after", "ts").alias("after"),
    )
    jump = F.col("peak") - F.col("trough")
    return runs.where(F.coalesce("before", F.lit(False)) & F.coalesce("after", F.lit(False)) & (jump >= min_jump) & (F.col("span_h") <= max_span)).select(
        key, "start", "end", "trough", "peak", jump.alias("jump"), "span_h"
    )


def attribute_rain(events: DataFrame, daily: DataFrame, rain_mm: float = 1.0) -> DataFrame:
    """Events with ``attribution``: rain if the event's day or the day before had ``rain_mm`` or more, else irrigation."""
    day = daily.select(F.col("date"), F.coalesce(F.col("precip_mm") >= rain_mm, F.lit(False)).alias("wet"))
    at = events.withColumn("_d", F.to_date("start"))
    same = at.join(day.select(F.col("date").alias("_d"), F.col("wet").alias("_w0")), "_d", "left")
    both = same.join(day.select(F.date_add("date", 1).alias("_d"), F.col("wet").alias("_w1")), "_d", "left")
    wet = F.coalesce("_w0", F.lit(False)) | F.coalesce("_w1", F.lit(False))
    return both.withColumn("attribution", F.when(wet, "rain").otherwise("irrigation")).drop("_d", "_w0", "_w1")


def in_event(grid: DataFrame, events: DataFrame, trailing_h: int = 24, key: str = "device") -> DataFrame:
    """The grid with ``in_event``: start <= t <= end + trailing of any event. Events are spread over their hours, which
    makes the range join an equi-join."""
    stop = F.col("end") + F.expr(f"INTERVAL {int(trailing_h)} HOURS")
    hours = events.select(key, F.explode(F.sequence("start", stop, F.expr("INTERVAL 1 HOUR"))).alias("ts")).distinct()
    return grid.join(hours.withColumn("_in", F.lit(True)), [key, "ts"], "left").withColumn("in_event", F.coalesce("_in", F.lit(False))).drop("_in")


def gate_fired(precip: Column, threshold_mm: float) -> Column:
    """Forecast rain at or over the threshold; missing never fires."""
    return F.coalesce(precip >= threshold_mm, F.lit(False))


def hybrid(persistence: Column, challenger: Column, fired: Column) -> Column:
    """The challenger where the gate fired and it has a value, else exactly persistence."""
    return F.when(fired & challenger.isNotNull(), challenger).otherwise(persistence)


def crossing_labels(grid: DataFrame, h: int, level: float, column: str = "value", key: str = "device", strict: bool = True) -> DataFrame:
    """The grid with ``valid`` (this hour and the next h all observed) and ``crossed`` (any of the next h under the level)."""
    w = over(key).rowsBetween(1, h)
    c = F.col(column)
    hit = (c < level) if strict else (c <= level)
    valid = c.isNotNull() & (F.count(c).over(w) == h)
    return grid.withColumn("valid", valid).withColumn("crossed", valid & (F.coalesce(F.sum(F.coalesce(hit, F.lit(False)).cast("int")).over(w), F.lit(0)) > 0))


def drawdown_labels(grid: DataFrame, h: int, drop: float, column: str = "value", key: str = "device") -> DataFrame:
    """As crossing_labels(), for a fall of ``drop`` or more below the present value."""
    w = over(key).rowsBetween(1, h)
    c = F.col(column)
    valid = c.isNotNull() & (F.count(c).over(w) == h)
    return grid.withColumn("valid", valid).withColumn("crossed", F.coalesce(valid & (F.min(c).over(w) <= c - drop), F.lit(False)))

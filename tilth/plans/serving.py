"""What a service answers from the grid, and the command line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, folds, grid
from ..sources import archives, views
from .registry import FOLDS, GRID, query
from .sensor import HORIZONS, hourly, r6


class UnknownBlock(LookupError):
    """404."""


class NoReading(LookupError):
    """503."""


@dataclass(frozen=True)
class Serving:
    devices: dict[str, str]
    irrigate_below: float = 25.0
    max_age_h: float = 4.0
    horizons: tuple[int, ...] = HORIZONS


def irrigation_forecast(readings: DataFrame, block: str, how: Serving, now) -> dict:
    """A block's persistence forecast from its device's latest finite reading: stale readings, and ones from more than a
    quarter of an hour ahead, give no values and no advice."""
    if block not in how.devices:
        raise UnknownBlock(block)
    finite = readings.where((F.col("device") == how.devices[block]) & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    last = finite.agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")).first()
    if last["ts"] is None:
        raise NoReading(block)
    age = (now - last["ts"]).total_seconds() / 3600
    usable = -0.25 <= age <= how.max_age_h
    status = "ok" if usable else "invalid" if age < -0.25 else "stale"
    value = last["value"] if usable else None
    return {
        "block_id": block, "device": how.devices[block], "read_at": last["ts"], "age_h": age, "status": status, "soil_water": value,
        "forecast": [{"horizon_h": h, "soil_water": value} for h in how.horizons], "irrigate": None if value is None else value < how.irrigate_below,
    }


def harvest_readiness(block: str) -> dict:
    """Not modelled: nulls."""
    return {"block_id": block, "ready": None, "date": None}


@query(f"""WITH {GRID} SELECT device, ts, round(value, 6) AS value, value IS NULL AS value_is_gap, round(avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS value_mean_6h,
round(lag(value, 24) OVER w, 6) AS value_lag_24, coalesce(value < 5 OR value > 400, false) AS value_out_of_range FROM g WINDOW w AS (PARTITION BY device ORDER BY ts)""")
def e01_feature_frame(spark, sf_dir):
    """Grid, rolling and lag features and flags in one pass over one window specification."""
    f = features.lag_features(features.rolling_features(hourly(spark, sf_dir), hours=(6,)), lags=(24,))
    out = F.coalesce((F.col("value") < 5) | (F.col("value") > 400), F.lit(False))
    return f.select("device", "ts", r6("value", "value"), F.col("value").isNull().alias("value_is_gap"), r6(F.col("value_mean_6h") + 1e-9, "value_mean_6h"), r6("value_lag_24", "value_lag_24"), out.alias("value_out_of_range"))


@query("""SELECT block, date, camera, max(path) AS path FROM (SELECT 'B' || event_id % 7 AS block, strftime(DATE '2024-01-01' + CAST(event_id % 5 AS INT), '%Y%m%d') AS date, CASE event_id % 3 WHEN 0 THEN 'M3M' WHEN 1 THEN 'P4' ELSE 'OLD' END AS camera,
'/root/B' || event_id % 7 || '/' || strftime(DATE '2024-01-01' + CAST(event_id % 5 AS INT), '%Y%m%d') || '_am/' || CASE event_id % 3 WHEN 0 THEN 'M3M' WHEN 1 THEN 'P4' ELSE 'OLD' END || '/f' || event_id AS path FROM events) WHERE camera <> 'OLD' GROUP BY 1, 2, 3""")
def s29_flight_index(spark, sf_dir):
    """Flights by block, date and camera from their paths."""
    e = views.table(spark, sf_dir, "events")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 5).cast("int")), "yyyyMMdd")
    camera = F.get(F.array(F.lit("M3M"), F.lit("P4"), F.lit("OLD")), (F.col("event_id") % 3).cast("int"))
    path = F.concat(F.lit("/root/B"), F.col("event_id") % 7, F.lit("/"), day, F.lit("_am/"), camera, F.lit("/f"), "event_id")
    return archives.index_flights(e.select(path.alias("path")), ("M3M", "P4"))


@query(f"""WITH {GRID} SELECT device, CAST(count(*) AS BIGINT) AS n FROM (SELECT device, ts FROM g WHERE device <> 'click' UNION ALL SELECT device, ts FROM g WHERE device = 'click') GROUP BY 1""")
def u01_union(spark, sf_dir):
    """Tables of devices put together again."""
    g = hourly(spark, sf_dir).select("device", "ts")
    return g.where("device <> 'click'").unionByName(g.where("device = 'click'")).groupBy("device").agg(F.count("*").alias("n"))


_ECM = f"""WITH {FOLDS}, pv AS (SELECT ts, max(i) AS i, max(n) AS n, max(fold) AS fold, max(value) FILTER (device = 'click') AS a, avg(value) FILTER (device <> 'click') AS b FROM f GROUP BY 1),
fo AS (SELECT unnest(range(5)) AS k), tr AS (SELECT fo.k, pv.* FROM pv CROSS JOIN fo WHERE i < n // 2 + CAST(round_even(k * (n - n // 2) / 5.0, 0) AS BIGINT) - 5 AND a IS NOT NULL AND b IS NOT NULL),
mo AS (SELECT k, avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM tr GROUP BY 1),
sp AS (SELECT mo.k, pv.*, (a - ma) / sa - (b - mb) / sb AS s FROM pv CROSS JOIN mo), lg AS (SELECT *, lag(s, 6) OVER (PARTITION BY k ORDER BY ts) AS s6, lag(a, 6) OVER (PARTITION BY k ORDER BY ts) AS a6 FROM sp),
co AS (SELECT k, regr_slope(a - a6, s6) AS sl, regr_intercept(a - a6, s6) AS ic FROM lg WHERE i < n // 2 + CAST(round_even(k * (n - n // 2) / 5.0, 0) AS BIGINT) - 5 AND a IS NOT NULL AND a6 IS NOT NULL AND s6 IS NOT NULL GROUP BY 1)"""


def ecm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each fold's error correction with the lagged spread, and (k, sl, ic) of the fits on its purged past."""
    h = 6
    g = folds.with_folds(hourly(spark, sf_dir))
    own = F.col("device") == "click"
    pair = g.groupBy("ts").agg(F.max("i").alias("i"), F.max("n").alias("n"), F.max("fold").alias("fold"), F.max(F.when(own, F.col("value"))).alias("a"), F.avg(F.when(~own, F.col("value"))).alias("b"))
    wide = pair.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    past = F.col("i") < folds.fold_start(F.col("k"), F.col("n")) - (h - 1)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    w = Window.partitionBy("k")
    moment = lambda f, c: f(F.when(past & both, F.col(c))).over(w)
    s = (F.col("a") - moment(F.avg, "a")) / moment(F.stddev_samp, "a") - (F.col("b") - moment(F.avg, "b")) / moment(F.stddev_samp, "b")
    o = w.orderBy("ts")
    x = wide.withColumn("past", past).withColumn("s", s).withColumn("s6", F.lag("s", h).over(o)).withColumn("a6", F.lag("a", h).over(o))
    x = x.where("a is not null and a6 is not null and s6 is not null")
    change = F.col("a") - F.col("a6")
    return x, x.where("past").groupBy("k").agg(F.regr_slope(change, F.col("s6")).alias("sl"), F.regr_intercept(change, F.col("s6")).alias("ic"), F.count("*").alias("rows"))


@query(f"""{_ECM} SELECT CAST(lg.k AS INT) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(abs(a - (a6 + ic + sl * s6))), 5) AS mae, round(avg(abs(a - a6)), 5) AS mae_persistence FROM lg JOIN co ON co.k = lg.k
WHERE lg.fold = lg.k AND a IS NOT NULL AND a6 IS NOT NULL AND s6 IS NOT NULL GROUP BY 1""")
def m12_ecm_walk_forward(spark, sf_dir):
    """Error correction against the mean of the other devices, fitted on each fold's purged past."""
    x, fit = ecm(spark, sf_dir)
    test = x.where("fold = k").join(fit, "k")
    err = F.abs(F.col("a") - (F.col("a6") + F.col("ic") + F.col("sl") * F.col("s6")))
    return test.groupBy(F.col("k").alias("fold")).agg(F.count("*").alias("n"), F.round(F.avg(err), 5).alias("mae"), F.round(F.avg(F.abs(F.col("a") - F.col("a6"))), 5).alias("mae_persistence"))


@query(f"{_ECM} SELECT CAST(k AS INT) AS fold, round(sl, 5) AS slope, round(ic, 5) AS intercept FROM co")
def e08_ecm_diagnostics(spark, sf_dir):
    """How each fold's fit pulls the level back."""
    return ecm(spark, sf_dir)[1].select(F.col("k").alias("fold"), F.round("sl", 5).alias("slope"), F.round("ic", 5).alias("intercept"))


@query(f"""WITH {GRID}, t AS (SELECT max(ts) + INTERVAL 3 HOUR AS now FROM g), l AS (SELECT device, arg_max(value, ts) AS level, max(ts) AS read_at FROM g WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1),
s AS (SELECT device, CASE WHEN (epoch(now) - epoch(read_at)) / 3600.0 BETWEEN -0.25 AND 4 THEN level END AS v FROM l CROSS JOIN t) SELECT device, CAST(h AS INT) AS horizon_h, round(v, 6) AS soil_water, v < 25 AS irrigate FROM s, (SELECT unnest([6, 12, 24, 48]) AS h)""")
def g06_irrigation_forecast(spark, sf_dir):
    """What the irrigation service would answer for every device: nothing from readings that are stale."""
    g = hourly(spark, sf_dir)
    now = g.agg((F.max("ts") + F.expr("INTERVAL 3 HOURS")).alias("now"))
    last = g.where("value is not null").groupBy("device").agg(F.max_by("value", "ts").alias("level"), F.max("ts").alias("read_at"))
    age = (F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("read_at").cast("timestamp"))) / 3600.0
    v = last.join(F.broadcast(now)).withColumn("v", F.when(age.between(-0.25, 4.0), F.col("level")))  # one row
    return v.select("device", F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon_h"), r6("v", "soil_water"), (F.col("v") < 25).alias("irrigate"))


def main(argv: list[str]) -> int:
    """``run <query> <data folder>``, ``list``, ``version``."""
    from . import QUERIES

    if argv[:1] == ["version"]:
        print("tilth 0.1")
    elif argv[:1] == ["list"]:
        print("\n".join(sorted(QUERIES)))
    elif argv[:1] == ["run"] and len(argv) == 3 and argv[1] in QUERIES:
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        QUERIES[argv[1]](spark, argv[2]).show(100, truncate=False)
    else:
        print("usage: python -m tilth version | list | run <query> <data folder>")
        return 2
    return 0

"""Queries on the hourly grid: cleaning, features, baselines and walk-forward scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import baselines, features, folds, grid, scoring
from ..sources import views
from .registry import FOLDS, GRID, WEATHER, query

HORIZONS = (6, 12, 24, 48)
ALERT_BELOW = 25.0


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded for comparison."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def r6_binary(c: Column | str, name: str) -> Column:
    """Rounded as the SQL rounds: the double times a million, halves away from zero. r6() rounds the shortest decimal that
    stands for the double, which differs where the product is a half but the decimal isn't, or the other way."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 1e300, F.round(c * 1e6, 0) / 1e6).otherwise(c).alias(name)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.resample(views.readings(spark, sf_dir))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.with_folds(hourly(spark, sf_dir))


@query(f"WITH {GRID} SELECT device, ts, i, round(value, 6) AS value, value IS NULL AS is_gap FROM g")
def a01_resample(spark, sf_dir):
    """Hourly means on a regular grid, gaps flagged."""
    return hourly(spark, sf_dir).select("device", "ts", "i", r6("value", "value"), F.col("value").isNull().alias("is_gap"))


@query(f"WITH {GRID} SELECT device, count(*) - count(value) AS value_missing FROM g GROUP BY 1")
def a02_gap_report(spark, sf_dir):
    return grid.gap_report(hourly(spark, sf_dir))


@query(f"""WITH {GRID}, r AS (SELECT *, sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ts) AS k FROM g),
m AS (SELECT device, k, count(*) AS n FROM r WHERE value IS NULL GROUP BY 1, 2)
SELECT d.device, coalesce(max(m.n), 0) AS longest_gap FROM (SELECT DISTINCT device FROM g) d LEFT JOIN m ON d.device = m.device GROUP BY 1""")
def a05_longest_gap(spark, sf_dir):
    return grid.longest_gap(hourly(spark, sf_dir))


@query(f"""WITH {GRID}, r AS (SELECT *, sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ts) AS k FROM g),
m AS (SELECT device, max(n) AS longest_gap_bins FROM (SELECT device, k, count(*) AS n FROM r WHERE value IS NULL GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT event_type AS device, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events),
q AS (SELECT device, count(*) AS raw_rows, quantile_cont((t - p) / 6e7::DOUBLE, 0.5) AS median_minutes, quantile_cont((t - p) / 6e7::DOUBLE, 0.9) AS p90_minutes FROM c GROUP BY 1),
x AS (SELECT device, count(*) AS expected, count(value) AS observed FROM g GROUP BY 1)
SELECT x.device, raw_rows, round(median_minutes, 4) AS median_minutes, round(p90_minutes, 4) AS p90_minutes, expected, observed, expected - observed AS missing,
round(100.0::DOUBLE * (expected - observed) / expected, 6) AS missing_pct, coalesce(longest_gap_bins, 0) AS longest_gap_bins
FROM x JOIN q ON x.device = q.device LEFT JOIN m ON x.device = m.device""")
def a03_sensor_coverage(spark, sf_dir):
    """Cadence and completeness of each sensor."""
    raw = views.readings(spark, sf_dir)
    step = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(grid.over())) / 6e7
    cadence = raw.withColumn("step", step).groupBy("device").agg(
        F.count("*").alias("raw_rows"), F.percentile("step", 0.5).alias("median_minutes"), F.percentile("step", 0.9).alias("p90_minutes")
    )
    g = hourly(spark, sf_dir)
    bins = g.groupBy("device").agg(F.count("*").alias("expected"), F.count("value").alias("observed"))
    gap = grid.longest_gap(g).withColumnRenamed("longest_gap", "longest_gap_bins")
    missing = F.col("expected") - F.col("observed")
    return bins.join(cadence, "device").join(gap, "device").select(
        "device", "raw_rows", F.round("median_minutes", 4).alias("median_minutes"), F.round("p90_minutes", 4).alias("p90_minutes"),
        "expected", "observed", missing.alias("missing"), r6(100.0 * missing / F.col("expected"), "missing_pct"), "longest_gap_bins",
    )


@query(f"""WITH {GRID} SELECT device, CAST(date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE) AS week,
round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS missing_fraction FROM g GROUP BY 1, 2""")
def a04_weekly_missingness(spark, sf_dir):
    """Weeks run from Tuesday to Monday and bear that Monday's date."""
    week = F.next_day(F.date_sub(F.to_date("ts"), 1), "MON").alias("week")
    return hourly(spark, sf_dir).groupBy("device", week).agg(r6(F.avg(F.col("value").isNull().cast("double")), "missing_fraction"))


@query(f"""WITH {GRID}, {WEATHER}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM g),
j AS (SELECT d.date, w.precip_mm, w.et0_mm FROM d LEFT JOIN wd w ON d.date = w.date)
SELECT c AS channel, CAST(count(*) AS BIGINT) AS expected_days, CAST(count(v) AS BIGINT) AS observed_days, round(100.0::DOUBLE * count(v) / count(*), 6) AS coverage_pct
FROM (SELECT 'precip_mm' AS c, precip_mm AS v FROM j UNION ALL SELECT 'et0_mm', et0_mm FROM j UNION ALL SELECT 'wind_ms', NULL FROM j) GROUP BY 1""")
def a06_weather_coverage(spark, sf_dir):
    """Days of the sensors' time line that each weather channel covers; a channel without a column covers none."""
    days = hourly(spark, sf_dir).select(F.to_date("ts").alias("date")).distinct()
    weather = views.weather_daily(spark, sf_dir)
    joined = days.join(weather, "date", "left")
    channels = ("precip_mm", "et0_mm", "wind_ms")
    parts = [F.struct(F.lit(c).alias("channel"), (F.col(c) if c in joined.columns else F.lit(None).cast("double")).alias("v")) for c in channels]
    long = joined.select(F.inline(F.array(*parts)))
    return long.groupBy("channel").agg(
        F.count("*").alias("expected_days"), F.count("v").alias("observed_days"), r6(100.0 * F.count("v") / F.count("*"), "coverage_pct")
    )


@query(f"""WITH {GRID} SELECT device, CAST(count(*) AS BIGINT) AS n, CAST(count(value) AS BIGINT) AS observed, min(ts) AS first_ts, max(ts) AS last_ts,
round(100.0::DOUBLE * (count(*) - count(value)) / count(*), 6) AS missing_pct, round(avg(value), 6) AS mean_value, round(min(value), 6) AS min_value,
round(max(value), 6) AS max_value, round(avg(CASE WHEN coalesce(value < 25, false) THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS share_below FROM g GROUP BY 1""")
def a28_overview(spark, sf_dir):
    """Datasheet line of each device (A26, A28, P16): a missing value doesn't count as below the threshold."""
    g = hourly(spark, sf_dir)
    return g.groupBy("device").agg(
        F.count("*").alias("n"), F.count("value").alias("observed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        r6(100.0 * (F.count("*") - F.count("value")) / F.count("*"), "missing_pct"), r6(F.avg("value"), "mean_value"), r6(F.min("value"), "min_value"),
        r6(F.max("value"), "max_value"), r6(F.avg(scoring.below("value", ALERT_BELOW).cast("double")), "share_below"),
    )


@query(f"""WITH {GRID}, k AS (SELECT unnest(range(1, 73)) AS lag)
SELECT g.device, CAST(k.lag AS INT) AS lag, round(corr(g.value, p.value), 6) AS acf FROM g JOIN k ON true JOIN g p ON p.device = g.device AND p.i = g.i - k.lag GROUP BY 1, 2""")
def a19_autocorrelation(spark, sf_dir):
    """Pairwise-complete correlation with the value 1 to 72 hours before."""
    g = hourly(spark, sf_dir)
    w = grid.over()
    lagged = g.select("device", "value", *[F.lag("value", k).over(w).alias(f"l{k}") for k in range(1, 73)])
    wide = lagged.groupBy("device").agg(*[F.corr("value", f"l{k}").alias(f"c{k}") for k in range(1, 73)])
    return wide.select("device", F.posexplode(F.array(*[f"c{k}" for k in range(1, 73)])).alias("lag", "acf")).select(
        "device", (F.col("lag") + 1).alias("lag"), r6("acf", "acf")
    )


@query(f"""WITH {GRID} SELECT device, ts, lag(value, 1) OVER w AS value_lag_1, lag(value, 6) OVER w AS value_lag_6, lag(value, 24) OVER w AS value_lag_24
FROM (SELECT device, ts, round(value, 6) AS value FROM g) WINDOW w AS (PARTITION BY device ORDER BY ts)""")
def w01_lags(spark, sf_dir):
    g = hourly(spark, sf_dir).withColumn("value", r6("value"))
    return features.lag_features(g).drop("i", "value")


@query(f"""WITH {GRID} SELECT device, ts, round(avg(value) OVER (w ROWS BETWEEN CURRENT ROW AND CURRENT ROW) + 1e-9, 6) AS value_mean_1h,
round(avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS value_mean_6h, round(stddev_samp(value) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 5) AS value_std_6h,
round(avg(value) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS value_mean_24h, round(stddev_samp(value) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 5) AS value_std_24h
FROM g WINDOW w AS (PARTITION BY device ORDER BY ts)""")
def w02_rolling(spark, sf_dir):
    f = features.rolling_features(hourly(spark, sf_dir))
    return f.select("device", "ts", *[F.round(F.col(c) + 1e-9, 5 if "std" in c else 6).alias(c) for c in f.columns if "_mean_" in c or ("_std_" in c and not c.endswith("_1h"))])


@query(f"""WITH {WEATHER}, t AS (SELECT date, (temp_max_c + temp_min_c) / 2 AS t FROM wd)
SELECT date, round(t, 6) AS temp_mean_c, round(sum(greatest(t - 10, 0)) OVER (ORDER BY date), 6) AS gdd FROM t""")
def w03_degree_days(spark, sf_dir):
    days = views.weather_daily(spark, sf_dir).select("date", ((F.col("temp_max_c") + F.col("temp_min_c")) / 2).alias("temp_mean_c"), F.lit(1).alias("site"))
    return features.growing_degree_days(days, "temp_mean_c", key="site").select("date", r6("temp_mean_c", "temp_mean_c"), r6("gdd", "gdd"))


_JOINED = f"""WITH {GRID}, {WEATHER}, days AS (SELECT date, temp_max_c, temp_min_c, precip_mm, et0_mm, (temp_max_c + temp_min_c) / 2 AS temp_mean_c,
sum(greatest((temp_max_c + temp_min_c) / 2 - 10, 0)) OVER (ORDER BY date) AS gdd FROM wd),
u AS (SELECT device, ts, i, value, true AS own FROM g UNION ALL BY NAME SELECT d.device, CAST(days.date AS TIMESTAMP) AS ts, false AS own FROM days, (SELECT DISTINCT device FROM g) d),
k AS (SELECT u.device, u.ts, max(u.i) AS i, max(u.value) AS value, bool_or(u.own) AS own FROM u GROUP BY 1, 2),
j AS (SELECT k.*, days.* EXCLUDE (date) FROM k LEFT JOIN days ON CAST(days.date AS TIMESTAMP) = k.ts),
a AS (SELECT device, ts, i, value, own, {', '.join(f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in ('temp_max_c', 'precip_mm', 'et0_mm', 'temp_mean_c', 'gdd'))}
FROM j WINDOW w AS (PARTITION BY device ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
jw AS MATERIALIZED (SELECT * FROM a WHERE own)"""


def with_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.attach_weather(hourly(spark, sf_dir), views.weather_daily(spark, sf_dir), ("temp_max_c", "precip_mm", "et0_mm"))


@query(f"{_JOINED} SELECT device, ts, {', '.join(f'round({c}, 6) AS {c}' for c in ('value', 'temp_max_c', 'precip_mm', 'et0_mm', 'temp_mean_c', 'gdd'))} FROM jw")
def j01_attach_weather(spark, sf_dir):
    """Daily weather on the hourly grid, each column carried on by itself."""
    return with_weather(spark, sf_dir).select("device", "ts", *[r6(c, c) for c in ("value", "temp_max_c", "precip_mm", "et0_mm", "temp_mean_c", "gdd")])


@query(f"""{_JOINED} SELECT device, ts, {', '.join(f'CASE WHEN count({c}) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN round(sum({c} / 24) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) + 1e-9, 6) END AS {c}_next_{h}h' for c in ('precip_mm', 'et0_mm') for h in (6, 24, 48))}
FROM jw WINDOW w AS (PARTITION BY device ORDER BY ts)""")
def w04_lead_time(spark, sf_dir):
    f = features.lead_time_features(with_weather(spark, sf_dir), (6, 24, 48))
    return f.select("device", "ts", *[r6(F.col(c) + 1e-9, c) for c in f.columns if "_next_" in c])


def with_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with archived forecasts: the vintage of n days ago is off by n hundredths, and every 11th hour lacks it."""
    hours = hourly(spark, sf_dir).groupBy("ts").agg(F.avg("value").alias("v"))
    vintage = hours.where(F.pmod(F.hour("ts") + 24 * F.dayofyear("ts"), F.lit(11)) != 0).select(
        "ts", *[(F.col("v") / k * (1 + n / 100)).alias(f"{c}_prev{n}") for c, k in (("precip_mm", 100), ("et0_mm", 50)) for n in (1, 2)]
    )
    return hourly(spark, sf_dir).join(vintage, "ts", "left")


_VINTAGE = f"""WITH {GRID}, hv AS (SELECT ts, avg(value) AS v FROM g GROUP BY 1), vin AS (SELECT ts,
{', '.join(f'v / {k} * (1 + {n} / 100.0::DOUBLE) AS {c}_prev{n}' for c, k in (('precip_mm', 100), ('et0_mm', 50)) for n in (1, 2))}
FROM hv WHERE (hour(ts) + 24 * dayofyear(ts)) % 11 <> 0), jv AS (SELECT g.*, vin.* EXCLUDE (ts) FROM g LEFT JOIN vin ON g.ts = vin.ts)"""


@query(f"""{_VINTAGE} SELECT device, ts, {', '.join(f'CASE WHEN count({c}_prev{n}) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN round(sum({c}_prev{n}) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) + 1e-9, 6) END AS {c}_next_{h}h' for c in ('precip_mm', 'et0_mm') for h, n in ((6, 1), (24, 1), (48, 2)))}
FROM jv WINDOW w AS (PARTITION BY device ORDER BY ts)""")
def w05_vintage_lead_time(spark, sf_dir):
    """Lead-time sums from the forecasts that were out in time."""
    f = features.vintage_features(with_vintages(spark, sf_dir), (6, 24, 48))
    return f.select("device", "ts", *[r6(F.col(c) + 1e-9, c) for c in f.columns if "_next_" in c])


@query(f"""WITH {GRID} SELECT device, ts, lag(v, 6) OVER w AS persistence_6, lag(v, 24) OVER w AS seasonal_6, lag(v, 48) OVER w AS seasonal_48,
round(lag(value, 6) OVER w + (lag(value, 6) OVER w - lag(value, 30) OVER w) / 24 * 6, 6) AS drydown_6
FROM (SELECT *, round(value, 6) AS v FROM g) WINDOW w AS (PARTITION BY device ORDER BY ts)""")
def w07_baselines(spark, sf_dir):
    """Persistence, seasonal naive and drydown trend."""
    g = hourly(spark, sf_dir)
    return g.select(
        "device", "ts", r6(baselines.persistence(6), "persistence_6"), r6(baselines.seasonal_naive(6), "seasonal_6"),
        r6(baselines.seasonal_naive(48), "seasonal_48"), r6(baselines.drydown_trend(6), "drydown_6"),
    )


@query(f"WITH {FOLDS} SELECT device, hour(ts) AS hour, round(avg(value), 6) AS climatology FROM f WHERE fold = -1 GROUP BY 1, 2")
def a10_climatology(spark, sf_dir):
    t = baselines.climatology(folded(spark, sf_dir).where("fold = -1"))
    return t.select("device", F.col("hour").cast("long").alias("hour"), r6("climatology", "climatology"))


_DELTA = f"""WITH {FOLDS}, dd AS (SELECT *, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS delta FROM f WHERE fold = -1),
dt AS (SELECT device, hour(ts) AS hour, avg(delta) AS delta FROM dd GROUP BY 1, 2),
tab AS (SELECT d.device, r.hour, coalesce(dt.delta, 0) AS delta FROM (SELECT DISTINCT device FROM f) d CROSS JOIN (SELECT unnest(range(24)) AS hour) r
LEFT JOIN dt ON dt.device = d.device AND dt.hour = r.hour)"""


@query(f"{_DELTA} SELECT device, CAST(hour AS BIGINT) AS hour, round(delta, 6) AS delta FROM tab")
def a11_hourly_delta_table(spark, sf_dir):
    t = baselines.delta_table(folded(spark, sf_dir).where("fold = -1"))
    return t.select("device", F.col("hour").cast("long").alias("hour"), r6("delta", "delta"))


_DRIFT = f"""{_DELTA}, cd AS (SELECT a.device, a.hour, sum(b.delta) AS drift FROM tab a, (SELECT unnest(range(12)) AS o) o, tab b
WHERE b.device = a.device AND b.hour = (a.hour - o.o + 24) % 24 GROUP BY 1, 2)"""


@query(f"{_DRIFT} SELECT device, CAST(hour AS BIGINT) AS hour, round(drift, 6) AS drift FROM cd")
def w10_cumulative_drift(spark, sf_dir):
    t = baselines.cumulative_drift(baselines.delta_table(folded(spark, sf_dir).where("fold = -1")), 12)
    return t.select("device", F.col("hour").cast("long").alias("hour"), r6("drift", "drift"))


@query(f"""{_DRIFT} SELECT f.device, ts, round(lag(value, 12) OVER (PARTITION BY f.device ORDER BY ts) + drift, 6) AS forecast
FROM f JOIN cd ON cd.device = f.device AND cd.hour = hour(ts)""")
def w11_diurnal_drift(spark, sf_dir):
    g = folded(spark, sf_dir)
    return baselines.diurnal_drift(g, g.where("fold = -1"), 12).select("device", "ts", r6("forecast", "forecast"))


@query(f"WITH {GRID} SELECT device, ts, round(value - lag(value) OVER (PARTITION BY device ORDER BY ts), 6) AS delta FROM g")
def w13_hourly_deltas(spark, sf_dir):
    return baselines.hourly_deltas(hourly(spark, sf_dir)).select("device", "ts", r6("delta", "delta"))


@query(f"""{_JOINED}, tj AS (SELECT *, count(*) OVER (PARTITION BY device) AS n, temp_mean_c AS temp FROM jw),
tr AS (SELECT *, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS delta FROM tj WHERE i < n // 2),
ed AS (SELECT device, quantile_cont(temp, 1 / 3.0::DOUBLE) AS e1, quantile_cont(temp, 2 / 3.0::DOUBLE) AS e2 FROM tr GROUP BY 1),
own AS (SELECT tr.device, CAST(temp >= e1 AS INT) + CAST(temp >= e2 AS INT) AS bin, hour(ts) AS hour, avg(delta) AS delta FROM tr JOIN ed ON ed.device = tr.device GROUP BY 1, 2, 3),
hs AS (SELECT d.device, h.hour FROM (SELECT DISTINCT device FROM tj) d CROSS JOIN (SELECT unnest(range(24)) AS hour) h),
pl AS (SELECT hs.device, hs.hour, coalesce(x.delta, 0) AS delta FROM hs LEFT JOIN (SELECT device, hour(ts) AS hour, avg(delta) AS delta FROM tr GROUP BY 1, 2) x ON x.device = hs.device AND x.hour = hs.hour),
ce AS (SELECT pl.device, b.bin, pl.hour, coalesce(own.delta, pl.delta) AS delta FROM pl CROSS JOIN (SELECT unnest([0, 1, 2]) AS bin) b
LEFT JOIN own ON own.device = pl.device AND own.bin = b.bin AND own.hour = pl.hour UNION ALL SELECT device, -1, hour, delta FROM pl),
dr AS (SELECT a.device, a.bin, a.hour, sum(b.delta) AS drift FROM ce a, (SELECT unnest(range(6)) AS o) o, ce b WHERE b.device = a.device AND b.bin = a.bin AND b.hour = (a.hour - o.o + 24) % 24 GROUP BY 1, 2, 3),
la AS (SELECT device, ts, lag(value, 6) OVER w AS l, lag(temp, 6) OVER w AS t FROM tj WINDOW w AS (PARTITION BY device ORDER BY ts))
SELECT la.device, la.ts, round(l + drift, 6) AS forecast FROM la JOIN ed ON ed.device = la.device
LEFT JOIN dr ON dr.device = la.device AND dr.hour = hour(la.ts) AND dr.bin = coalesce(CAST(t >= e1 AS INT) + CAST(t >= e2 AS INT), -1)""")
def w12_diurnal_drift_temp(spark, sf_dir):
    """Drift by temperature class, trained on the first half."""
    g = folds.with_folds(with_weather(spark, sf_dir).withColumnRenamed("temp_mean_c", "temp"))
    return baselines.diurnal_drift_temp(g, g.where("fold = -1"), 6).select("device", "ts", r6("forecast", "forecast"))


@query(f"WITH {FOLDS} SELECT device, ts, i, CAST(fold AS INT) AS fold FROM f")
def w19_folds(spark, sf_dir):
    """Fold of each row."""
    return folded(spark, sf_dir).select("device", "ts", "i", "fold")


@query(f"""WITH {FOLDS}, s AS (SELECT DISTINCT device, n, unnest(range(5)) AS for_fold FROM f)
SELECT f.device, CAST(s.for_fold AS INT) AS for_fold, CAST(count(*) AS BIGINT) AS train_rows, CAST(count(value) AS BIGINT) AS train_observed FROM f JOIN s ON s.device = f.device
WHERE f.i < f.n // 2 + CAST(round_even(s.for_fold * (f.n - f.n // 2) / 5.0, 0) AS BIGINT) - 23 GROUP BY 1, 2""")
def w21_purged_train(spark, sf_dir):
    """Size of each fold's training set at a lead of 24 hours, purged."""
    t = folds.purged_train(folded(spark, sf_dir), 24)
    return t.groupBy("device", "for_fold").agg(F.count("*").alias("train_rows"), F.count("value").alias("train_observed"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, ts, fold, horizon_h, y, persistence, seasonal, drydown) on the rows where the truth and every forecast exist."""
    g = folded(spark, sf_dir)
    parts = [
        F.struct(F.lit(h).alias("horizon_h"), baselines.persistence(h).alias("persistence"), baselines.seasonal_naive(h).alias("seasonal"), baselines.drydown_trend(h).alias("drydown"))
        for h in HORIZONS
    ]
    wide = g.select("device", "ts", "fold", F.col("value").alias("y"), *[p.alias(f"_{h}") for p, h in zip(parts, HORIZONS, strict=True)])
    long = wide.select("device", "ts", "fold", "y", F.inline(F.array(*[f"_{h}" for h in HORIZONS])))
    return long.where("fold >= 0 and y is not null and persistence is not null and seasonal is not null and drydown is not null")


_SCORED = f"""WITH {FOLDS},
p AS ({" UNION ALL ".join(f"SELECT device, ts, fold, {h} AS horizon_h, value AS y, lag(value, {h}) OVER w AS persistence, lag(value, {24 * -(-h // 24)}) OVER w AS seasonal, lag(value, {h}) OVER w + (lag(value, {h}) OVER w - lag(value, {h + 24}) OVER w) / 24 * {h} AS drydown FROM f WINDOW w AS (PARTITION BY device ORDER BY ts)" for h in (6, 12, 24, 48))}),
s AS MATERIALIZED (SELECT * FROM p WHERE fold >= 0 AND y IS NOT NULL AND persistence IS NOT NULL AND seasonal IS NOT NULL AND drydown IS NOT NULL),
m AS (UNPIVOT s ON persistence, seasonal, drydown INTO NAME model VALUE pred)"""


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = ("persistence", "seasonal", "drydown")
    return scored(spark, sf_dir).unpivot(["device", "ts", "fold", "horizon_h", "y"], list(models), "model", "p")


@query(f"""{_SCORED}, a AS (SELECT device, horizon_h, model, CAST(count(*) AS BIGINT) AS n, avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) ** 2)) AS rmse,
count(*) FILTER (y < 25 AND pred < 25) AS tp, count(*) FILTER (NOT y < 25 AND pred < 25) AS fp, count(*) FILTER (y < 25 AND NOT pred < 25) AS fn, count(*) FILTER (NOT y < 25 AND NOT pred < 25) AS tn FROM m GROUP BY 1, 2, 3)
SELECT a.device, a.horizon_h, a.model, a.n, round(a.mae, 6) AS mae, round(a.rmse, 6) AS rmse, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) ELSE 0 END AS "precision",
CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) ELSE 0 END AS recall, CASE WHEN b.mae = 0 OR b.mae IS NULL THEN 0 ELSE round(1 - a.mae / b.mae, 6) END AS skill
FROM a LEFT JOIN (SELECT device, horizon_h, mae FROM a WHERE model = 'persistence') b ON b.device = a.device AND b.horizon_h = a.horizon_h""")
def e02_persistence_skill(spark, sf_dir):
    """Scores of the baselines on identical rows, by device and lead."""
    alert = {k: v.alias(k) for k, v in scoring.confusion(scoring.below("y", ALERT_BELOW), scoring.below("p", ALERT_BELOW)).items()}
    by = stacked(spark, sf_dir).groupBy("device", "horizon_h", "model").agg(F.count("*").alias("n"), scoring.mae().alias("mae"), scoring.rmse().alias("rmse"), *alert.values())
    base = F.max(F.when(F.col("model") == "persistence", F.col("mae"))).over(Window.partitionBy("device", "horizon_h"))
    m = scoring.binary_metrics()
    return by.select("device", "horizon_h", "model", "n", r6("mae", "mae"), r6("rmse", "rmse"), r6(m["precision"], "precision"), r6(m["recall"], "recall"), r6(scoring.skill(F.col("mae"), base), "skill"))


@query(f"""{_SCORED}, a AS (SELECT device, horizon_h, model, fold, avg(abs(y - pred)) AS mae FROM m GROUP BY 1, 2, 3, 4),
s2 AS (SELECT a.device, a.horizon_h, a.model, CASE WHEN b.mae = 0 THEN 0 ELSE 1 - a.mae / b.mae END AS skill FROM a JOIN a b ON b.device = a.device AND b.horizon_h = a.horizon_h AND b.fold = a.fold AND b.model = 'persistence')
SELECT device, horizon_h, model, round(quantile_cont(skill, 0.5), 6) AS skill_median, round(min(skill), 6) AS skill_min, CAST(count(*) AS BIGINT) AS folds FROM s2 GROUP BY 1, 2, 3""")
def e03_fold_skill(spark, sf_dir):
    """Median and worst fold."""
    by = stacked(spark, sf_dir).groupBy("device", "horizon_h", "model", "fold").agg(scoring.mae().alias("mae"))
    base = F.max(F.when(F.col("model") == "persistence", F.col("mae"))).over(Window.partitionBy("device", "horizon_h", "fold"))
    each = by.withColumn("skill", scoring.skill(F.col("mae"), base))
    return each.groupBy("device", "horizon_h", "model").agg(r6(F.percentile("skill", 0.5), "skill_median"), r6(F.min("skill"), "skill_min"), F.count("*").alias("folds"))


@query(f"""{_SCORED} SELECT coalesce(device, 'ALL') AS device, horizon_h, model, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - pred)), 6) AS mae
FROM m GROUP BY GROUPING SETS ((device, horizon_h, model), (horizon_h, model))""")
def e06_fleet_rollup(spark, sf_dir):
    """Each device and the fleet as a whole, weighted by rows."""
    s = stacked(spark, sf_dir)
    sets = s.groupingSets([["device", "horizon_h", "model"], ["horizon_h", "model"]], "device", "horizon_h", "model")
    return sets.agg(F.count("*").alias("n"), scoring.mae().alias("mae")).select(F.coalesce("device", F.lit("ALL")).alias("device"), "horizon_h", "model", "n", r6("mae", "mae"))


@query(f"""{_SCORED}, c AS (SELECT model, count(*) FILTER (y < 25 AND pred < 25) AS tp, count(*) FILTER (NOT y < 25 AND pred < 25) AS fp,
count(*) FILTER (y < 25 AND NOT pred < 25) AS fn, count(*) FILTER (NOT y < 25 AND NOT pred < 25) AS tn FROM m GROUP BY 1)
SELECT model, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 OR tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1, round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity,
round((tp + fn) / (tp + fp + fn + tn)::DOUBLE, 6) AS prevalence, round((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 6) AS alert_rate FROM c""")
def a29_pooled_confusion(spark, sf_dir):
    """Confusion and rates pooled over devices."""
    c = scoring.confusion(scoring.below("y", ALERT_BELOW), scoring.below("p", ALERT_BELOW))
    pooled = stacked(spark, sf_dir).groupBy("model").agg(*[v.alias(k) for k, v in c.items()])
    return pooled.select("model", *c, *[r6(v, k) for k, v in scoring.binary_metrics().items()])


@query(f"""{_SCORED} SELECT device, horizon_h, round(max(mae) FILTER (model = 'drydown'), 6) AS drydown, round(max(mae) FILTER (model = 'persistence'), 6) AS persistence,
round(max(mae) FILTER (model = 'seasonal'), 6) AS seasonal FROM (SELECT device, horizon_h, model, avg(abs(y - pred)) AS mae FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def a17_pivot(spark, sf_dir):
    """Errors side by side."""
    by = stacked(spark, sf_dir).groupBy("device", "horizon_h", "model").agg(scoring.mae().alias("mae"))
    return by.groupBy("device", "horizon_h").pivot("model", ["drydown", "persistence", "seasonal"]).agg(r6(F.first("mae")))


@query(f"""{_SCORED}, w AS (SELECT device, fold FROM f WHERE fold >= 0 GROUP BY 1, 2 HAVING bool_and(value IS NOT NULL)), l AS (SELECT device, max(fold) AS fold FROM w GROUP BY 1)
SELECT a.device, CAST(a.fold AS INT) AS fold, a.ts, round(a.value, 6) AS y, round(b.value, 6) AS persistence_24, round(c.value, 6) AS persistence_48 FROM f a JOIN l ON l.device = a.device AND l.fold = a.fold
LEFT JOIN f b ON b.device = a.device AND b.i = a.i - 24 LEFT JOIN f c ON c.device = a.device AND c.i = a.i - 48""")
def e26_latest_full_fold(spark, sf_dir):
    """Truth and persistence over the latest fold that is observed throughout."""
    g = folded(spark, sf_dir).select("device", "ts", "fold", F.col("value").alias("y"), baselines.persistence(24).alias("p24"), baselines.persistence(48).alias("p48"))
    full = g.where("fold >= 0").groupBy("device", "fold").agg(F.bool_and(F.col("y").isNotNull()).alias("full")).where("full")
    latest = full.groupBy("device").agg(F.max("fold").alias("fold"))
    return g.join(latest, ["device", "fold"]).select("device", "fold", "ts", r6("y", "y"), r6("p24", "persistence_24"), r6("p48", "persistence_48"))


@query(f"""WITH {GRID}, k AS (SELECT DISTINCT device FROM g), t AS (SELECT DISTINCT ts FROM g)
SELECT k.device, t.ts, round(g.value, 6) AS value FROM k CROSS JOIN t LEFT JOIN g ON g.device = k.device AND g.ts = t.ts""")
def j05_aligned(spark, sf_dir):
    """All devices on the union of their hours."""
    return grid.aligned(hourly(spark, sf_dir)).select("device", "ts", r6("value", "value"))


@query(f"""WITH {GRID} SELECT device, ts, round(value, 6) AS value FROM (SELECT *, max(ts) OVER (PARTITION BY device) AS top FROM g) WHERE ts > top - INTERVAL 14 DAY""")
def p17_last_two_weeks(spark, sf_dir):
    g = hourly(spark, sf_dir)
    top = F.max("ts").over(Window.partitionBy("device"))
    return g.withColumn("top", top).where(F.col("ts") > F.col("top") - F.expr("INTERVAL 14 DAYS")).select("device", "ts", r6("value", "value"))

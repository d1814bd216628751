"""Queries on single scores, masks, splits, joins and selections, each by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import baselines, events, features, folds, phenology, scoring, screening
from ..sources import views
from .decisions import _EVENTS, _MASK, _STUDY, _SURV, _KM, _VOL, HOURS, found_events, labelled, study, volatility
from .plots import _PX, _RANGES, _RANKED, ranked
from .registry import FOLDS, GRID, ORACLE_SQL, WEATHER, query
from .sensor import _SCORED, _VINTAGE, ALERT_BELOW, folded, hourly, r6, r6_binary, scored, stacked, with_vintages, with_weather
from .small import declared_features

_COUNTS = "count(*) FILTER (y < 25 AND pred < 25) AS tp, count(*) FILTER (NOT y < 25 AND pred < 25) AS fp, count(*) FILTER (y < 25 AND NOT pred < 25) AS fn, count(*) FILTER (NOT y < 25 AND NOT pred < 25) AS tn"


def counted(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    c = scoring.confusion(scoring.below("y", ALERT_BELOW), scoring.below("p", ALERT_BELOW))
    return stacked(spark, sf_dir).groupBy(*keys).agg(*[v.alias(k) for k, v in c.items()])


@query(f"{_SCORED} SELECT device, horizon_h, model, {_COUNTS} FROM m GROUP BY 1, 2, 3")
def a20_confusion_counts(spark, sf_dir):
    """The four outcomes of alerts."""
    return counted(spark, sf_dir, "device", "horizon_h", "model")


@query(f"""{_SCORED}, c AS (SELECT horizon_h, model, {_COUNTS} FROM m GROUP BY 1, 2)
SELECT horizon_h, model, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1,
round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity, round((tp + fn) / (tp + fp + fn + tn)::DOUBLE, 6) AS prevalence, round((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 6) AS alert_rate FROM c""")
def a21_binary_metrics(spark, sf_dir):
    """Rates of alerts by lead and model; without a denominator 0."""
    return counted(spark, sf_dir, "horizon_h", "model").select("horizon_h", "model", *[r6(v, k) for k, v in scoring.binary_metrics().items()])


@query(f"""{_SCORED}, c AS (SELECT device, model, {_COUNTS} FROM m GROUP BY 1, 2)
SELECT device, model, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall FROM c""")
def a22_precision_recall(spark, sf_dir):
    m = scoring.binary_metrics()
    return counted(spark, sf_dir, "device", "model").select("device", "model", r6(m["precision"], "precision"), r6(m["recall"], "recall"))


@query(f"{_SCORED} SELECT device, horizon_h, model, round(avg(abs(y - pred)), 6) AS mae FROM m GROUP BY 1, 2, 3")
def a23_mae(spark, sf_dir):
    return stacked(spark, sf_dir).groupBy("device", "horizon_h", "model").agg(r6(scoring.mae(), "mae"))


@query(f"{_SCORED} SELECT device, horizon_h, model, round(sqrt(avg((y - pred) ** 2)), 6) AS rmse FROM m GROUP BY 1, 2, 3")
def a24_rmse(spark, sf_dir):
    return stacked(spark, sf_dir).groupBy("device", "horizon_h", "model").agg(r6(scoring.rmse(), "rmse"))


@query(f"""WITH {GRID} SELECT device, CAST(count(*) AS BIGINT) AS hours, round(100.0::DOUBLE * (count(*) - count(value)) / count(*), 6) AS gap_pct, round(avg(value), 6) AS mean_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM g GROUP BY 1""")
def a26_datasheet(spark, sf_dir):
    """Row counts, gaps and extremes, as the datasheet prints them."""
    return hourly(spark, sf_dir).groupBy("device").agg(
        F.count("*").alias("hours"), r6(100.0 * (F.count("*") - F.count("value")) / F.count("*"), "gap_pct"),
        r6(F.avg("value"), "mean_value"), r6(F.min("value"), "min_value"), r6(F.max("value"), "max_value"),
    )


@query(f"""WITH {GRID}, r AS (SELECT * FROM (VALUES ('click', 5.0, 400.0), ('view', 0.0, 300.0), ('error', 10.0, 450.0)) t(device, lo, hi)) SELECT g.device, ts, coalesce(value < lo OR value > hi, false) AS out_of_range FROM g LEFT JOIN r ON r.device = g.device""")
def p01_range_flags(spark, sf_dir):
    """Values strictly outside their unit's range; missing ones and unknown units aren't flagged."""
    g = hourly(spark, sf_dir).join(F.broadcast(unit_ranges(spark)), "device", "left")  # a catalogue of three rows
    return g.select("device", "ts", F.coalesce((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), F.lit(False)).alias("out_of_range"))


def unit_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, *r) for d, r in _RANGES.items()], "device string, lo double, hi double")


@query("""SELECT device, unit, CASE WHEN unit = 'ok' THEN lo END AS lo, CASE WHEN unit = 'ok' THEN hi END AS hi FROM (SELECT DISTINCT event_type AS device, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'other' END AS unit FROM events) e
LEFT JOIN (VALUES ('click', 5.0::DOUBLE, 400.0::DOUBLE), ('view', 0.0, 300.0), ('error', 10.0, 450.0)) t(d, lo, hi) ON d = device""")
def p02_unit_ranges(spark, sf_dir):
    """A range holds for its column and unit only."""
    e = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("device"), F.when(F.col("event_id") % 2 == 0, "ok").otherwise("other").alias("unit")).distinct()
    return e.join(F.broadcast(unit_ranges(spark).withColumn("unit", F.lit("ok"))), ["device", "unit"], "left").select("device", "unit", "lo", "hi")


@query(f"WITH {GRID} SELECT device, ts, value IS NULL AS value_is_gap FROM g")
def p03_gap_flags(spark, sf_dir):
    return hourly(spark, sf_dir).select("device", "ts", F.col("value").isNull().alias("value_is_gap"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def p06_deployed_points(spark, sf_dir):
    """Points whose device is deployed."""
    deployed = views.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return views.table(spark, sf_dir, "supplier").join(deployed, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query("SELECT unnest(['value', 'value_lag_1', 'value_lag_6', 'value_lag_24', 'value_mean_6h', 'value_std_6h', 'precip_mm_next_6h']) AS feature")
def p07_declared_features(spark, sf_dir):
    """Columns of declared bases, and this lead's water sums only."""
    f = features.lag_features(features.rolling_features(hourly(spark, sf_dir), hours=(6,)))
    f = f.withColumns({"precip_mm_next_6h": F.lit(0.0), "precip_mm_next_24h": F.lit(0.0), "other": F.lit(0)})
    names = declared_features(f.columns, ("value",), 6)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query(f"{_VINTAGE} SELECT device, ts, coalesce(precip_mm_prev1 >= 2, false) AS fired FROM jv")
def p09_rain_gate(spark, sf_dir):
    """Forecast rain at or over the threshold; missing never fires."""
    return with_vintages(spark, sf_dir).select("device", "ts", events.gate_fired(F.col("precip_mm_prev1"), 2.0).alias("fired"))


@query(f"""{_VINTAGE} SELECT device, ts, round(CASE WHEN coalesce(precip_mm_prev1 >= 2, false) AND lag(value, 24) OVER w IS NOT NULL THEN lag(value, 24) OVER w ELSE lag(value, 6) OVER w END, 6) AS hybrid FROM jv WINDOW w AS (PARTITION BY device ORDER BY ts)""")
def p10_hybrid(spark, sf_dir):
    """The challenger where the gate fired and it has a value, else persistence (P10)."""
    fired = events.gate_fired(F.col("precip_mm_prev1"), 2.0)
    return with_vintages(spark, sf_dir).select("device", "ts", r6(events.hybrid(baselines.persistence(6), baselines.persistence(24), fired), "hybrid"))


@query(f"""WITH {FOLDS}, l AS (SELECT device, ts, fold, value, lag(value, 6) OVER w AS a, lag(value, 24) OVER w AS b FROM f WINDOW w AS (PARTITION BY device ORDER BY ts)) SELECT device, ts, fold >= 0 AND value IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AS valid FROM l""")
def p11_holdout_mask(spark, sf_dir):
    """Hours of a test fold at which the truth and every forecast exist."""
    l = folded(spark, sf_dir).select("device", "ts", "fold", "value", baselines.persistence(6).alias("a"), baselines.seasonal_naive(6).alias("b"))  # noqa: E741
    return l.select("device", "ts", ((F.col("fold") >= 0) & F.col("value").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull()).alias("valid"))


@query(f"WITH {FOLDS} SELECT device, CAST(fold AS INT) AS fold, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM f WHERE fold >= 0 GROUP BY 1, 2")
def p12_fold_masks(spark, sf_dir):
    return folded(spark, sf_dir).where("fold >= 0").groupBy("device", "fold").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def p13_numeric_columns(spark, sf_dir):
    """Only the numeric columns of a table."""
    return numeric_only(views.table(spark, sf_dir, "supplier"))


def numeric_only(df: DataFrame) -> DataFrame:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select(*[F.col(f"`{c}`") for c, t in df.dtypes if t in kinds or t.startswith("decimal")])


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value FROM events")
def p14_numbers(spark, sf_dir):
    """Texts as numbers; what is none is missing."""
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("t")).select("event_id", F.expr("try_cast(t as double)").alias("value"))


@query(f"WITH {_PX} SELECT zone, round(avg(value), 6) AS ndvi_mean, CAST(count(value) AS BIGINT) AS ndvi_count FROM px WHERE band = 0 GROUP BY 1")
def p15_prefixed(spark, sf_dir):
    """An index's statistics under its own prefix."""
    z = views.pixels(spark, sf_dir).where("band = 0").groupBy("zone").agg(r6(F.avg("value"), "mean"), F.count("value").alias("count"))
    return z.select("zone", *[F.col(c).alias(f"ndvi_{c}") for c in z.columns if c != "zone"])


@query(f"WITH {GRID} SELECT device, round(avg(CASE WHEN coalesce(value < 25, false) THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS share FROM g GROUP BY 1")
def p16_share_below(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("device").agg(r6(F.avg(scoring.below("value", ALERT_BELOW).cast("double")), "share"))


@query("SELECT s_suppkey, n_name, CASE WHEN n_regionkey = 1 THEN n_regionkey END AS block FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 1")
def j03_alignment(spark, sf_dir):
    """All devices with the block they lie in, those in none too."""
    n = views.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("block"))
    return views.table(spark, sf_dir, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", "n_name", "block")


@query(f"""WITH {_PX}, a AS (SELECT zone, avg(value) AS m FROM px WHERE band = 0 AND zone % 3 <> 0 GROUP BY 1), b AS (SELECT zone, avg(value) AS m FROM px WHERE band = 1 AND zone % 3 <> 1 GROUP BY 1)
SELECT coalesce(a.zone, b.zone) AS zone, round(a.m, 6) AS ndvi_mean, round(b.m, 6) AS ndre_mean FROM a FULL JOIN b ON a.zone = b.zone""")
def j04_index_outer_join(spark, sf_dir):
    """Statistics of two indices by block, whichever of them there is."""
    side = lambda band, skip, name: views.pixels(spark, sf_dir).where(f"band = {band} and zone % 3 <> {skip}").groupBy("zone").agg(r6(F.avg("value"), name))
    return side(0, 0, "ndvi_mean").join(side(1, 1, "ndre_mean"), "zone", "full")


@query(f"{_VINTAGE} SELECT device, ts, round(precip_mm_prev1, 6) AS precip_mm_prev1, round(et0_mm_prev2, 6) AS et0_mm_prev2 FROM jv")
def j06_vintage_join(spark, sf_dir):
    """Archived forecasts by hour; an hour without one stays, missing."""
    return with_vintages(spark, sf_dir).select("device", "ts", *[r6_binary(c, c) for c in ("precip_mm_prev1", "et0_mm_prev2")])


@query(f"""{_EVENTS} SELECT ev.device, "start", round(a.precip_mm, 6) AS day_mm, round(b.precip_mm, 6) AS day_before_mm FROM ev LEFT JOIN wd a ON a.date = CAST("start" AS DATE) LEFT JOIN wd b ON b.date + 1 = CAST("start" AS DATE)""")
def j07_event_days(spark, sf_dir):
    """Rain of each event's day and of the day before."""
    day = views.weather_daily(spark, sf_dir).select("date", "precip_mm")
    ev = found_events(spark, sf_dir).withColumn("date", F.to_date("start"))
    ev = ev.join(day.withColumnRenamed("precip_mm", "day_mm"), "date", "left")
    return ev.join(day.select(F.date_add("date", 1).alias("date"), F.col("precip_mm").alias("day_before_mm")), "date", "left").select("device", "start", r6("day_mm", "day_mm"), r6("day_before_mm", "day_before_mm"))


@query(f"""{_SCORED}, a AS (SELECT horizon_h, model, avg(abs(y - pred)) AS x FROM m GROUP BY 1, 2) SELECT a.horizon_h, a.model, round(a.x, 6) AS mae, round(b.x, 6) AS matched_mae FROM a LEFT JOIN a b ON b.horizon_h = a.horizon_h AND b.model = 'persistence' WHERE a.model <> 'persistence'""")
def j08_matched_baseline(spark, sf_dir):
    """Each model beside the baseline's error at its lead."""
    a = stacked(spark, sf_dir).groupBy("horizon_h", "model").agg(r6(scoring.mae(), "mae"))
    base = a.where("model = 'persistence'").select("horizon_h", F.col("mae").alias("matched_mae"))
    return a.where("model <> 'persistence'").join(base, "horizon_h", "left")


@query(f"""{_RANKED}, q AS (SELECT zone, CAST(count(*) AS BIGINT) AS acquisitions FROM px WHERE band = 1 AND zone % 2 = 0 GROUP BY 1) SELECT sc.zone, round(score, 6) AS score, coalesce(acquisitions, 0) AS acquisitions FROM sc LEFT JOIN q ON q.zone = sc.zone""")
def j10_ranks_on_polygons(spark, sf_dir):
    """Polygons with their ranks and counts; without a count 0."""
    n = views.pixels(spark, sf_dir).where("band = 1 and zone % 2 = 0").groupBy("zone").agg(F.count("*").alias("acquisitions"))
    return ranked(spark, sf_dir).select("zone", r6("score", "score")).join(n, "zone", "left").fillna(0, ["acquisitions"])


@query("SELECT CAST(h AS INT) AS horizon_h, CAST(ceil(h / 24.0) AS INT) AS lag_days FROM (SELECT unnest(range(1, 73)) AS h)")
def w06_lag_days(spark, sf_dir):
    """Age of the freshest forecast that is out in time, by lead."""
    return spark.createDataFrame([(h, features.freshest_age(h)) for h in range(1, 73)], "horizon_h int, lag_days int")


@query(f"WITH {GRID} SELECT device, ts, round(lag(value, 24) OVER w, 6) AS seasonal_24, round(lag(value, 72) OVER w, 6) AS seasonal_50 FROM g WINDOW w AS (PARTITION BY device ORDER BY ts)")
def w08_seasonal_naive(spark, sf_dir):
    return hourly(spark, sf_dir).select("device", "ts", r6(baselines.seasonal_naive(24), "seasonal_24"), r6(baselines.seasonal_naive(50), "seasonal_50"))


@query(f"WITH {GRID} SELECT device, ts, round(lag(value, 12) OVER w + (lag(value, 12) OVER w - lag(value, 36) OVER w) / 24 * 12, 6) AS drydown_12 FROM g WINDOW w AS (PARTITION BY device ORDER BY ts)")
def w09_drydown_trend(spark, sf_dir):
    return hourly(spark, sf_dir).select("device", "ts", r6(baselines.drydown_trend(12), "drydown_12"))


@query(f"{_VOL} SELECT device, ts, round(drift, 5) AS drift FROM ew")
def w15_ewma_drift(spark, sf_dir):
    return volatility(spark, sf_dir).select("device", "ts", F.round("drift", 5).alias("drift"))


@query(f"""WITH {FOLDS}, n AS (SELECT DISTINCT device, n, unnest(range(6)) AS k FROM f), sb AS (SELECT device, k, n // 2 + CAST(round_even(k * (n - n // 2) / 5.0, 0) AS BIGINT) AS at FROM n)
SELECT a.device, CAST(a.k AS INT) AS fold, a.at AS test_start, b.at AS test_stop FROM sb a JOIN sb b ON b.device = a.device AND b.k = a.k + 1""")
def w20_expanding_splits(spark, sf_dir):
    """Where each fold's test rows begin and end; all rows before train it."""
    n = folded(spark, sf_dir).select("device", "n").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return n.select("device", "fold", folds.fold_start(F.col("fold"), F.col("n")).alias("test_start"), folds.fold_start(F.col("fold") + 1, F.col("n")).alias("test_stop"))


_AHEAD = "value IS NOT NULL AND count(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) = 12"


@query(f"""WITH {GRID}, x AS (SELECT device, ts, {_AHEAD} AS valid, min(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) <= 25 AS reached FROM g WINDOW w AS (PARTITION BY device ORDER BY ts)) SELECT device, ts, valid, valid AND coalesce(reached, false) AS reached FROM x""")
def w23_absolute_labels(spark, sf_dir):
    """Whether the level is reached within 12 hours, itself included."""
    return events.crossing_labels(hourly(spark, sf_dir), 12, ALERT_BELOW, strict=False).select("device", "ts", "valid", F.col("crossed").alias("reached"))


@query(f"""WITH {GRID}, x AS (SELECT device, ts, {_AHEAD} AS valid, min(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) <= value - 40 AS fell FROM g WINDOW w AS (PARTITION BY device ORDER BY ts)) SELECT device, ts, valid, valid AND coalesce(fell, false) AS fell FROM x""")
def w24_drawdown_labels(spark, sf_dir):
    return events.drawdown_labels(hourly(spark, sf_dir), 12, 40.0).select("device", "ts", "valid", F.col("crossed").alias("fell"))


@query(f"WITH {GRID}, l AS (SELECT device, value AS s, lag(value) OVER (PARTITION BY device ORDER BY ts) AS s1 FROM g) SELECT device, round(regr_slope(s, s1), 6) AS ar1 FROM l WHERE s IS NOT NULL AND s1 IS NOT NULL GROUP BY 1")
def w27_ar1(spark, sf_dir):
    """Slope on the hour before, over pairs that are both observed."""
    l = hourly(spark, sf_dir).select("device", F.col("value").alias("s"), baselines.persistence(1).alias("s1"))  # noqa: E741
    return l.where("s is not null and s1 is not null").groupBy("device").agg(r6(F.regr_slope("s", "s1"), "ar1"))


@query(f"""{_VOL}, cm AS (SELECT device, ts, round(drift, 5) AS m FROM ew WHERE drift IS NOT NULL), q AS (SELECT device, quantile_cont(m, 1 / 3.0::DOUBLE) AS e1, quantile_cont(m, 2 / 3.0::DOUBLE) AS e2 FROM cm GROUP BY 1)
SELECT cm.device, ts, CAST(m >= e1 AS INT) + CASE WHEN e2 > e1 THEN CAST(m >= e2 AS INT) ELSE 0 END AS bucket FROM cm JOIN q ON q.device = cm.device""")
def w29_survival_buckets(spark, sf_dir):
    """Three drift classes, as the survival runner cuts them."""
    c = volatility(spark, sf_dir).where("drift is not null").select("device", "ts", F.round("drift", 5).alias("m"))
    e = c.groupBy("device").agg(F.array_distinct(F.percentile("m", F.array(F.lit(1 / 3), F.lit(2 / 3)))).alias("e"))
    return c.join(e, "device").select("device", "ts", F.size(F.filter("e", lambda x: F.col("m") >= x)).alias("bucket"))


@query(f"""WITH {_PX}, m AS (SELECT zone, avg(value) AS v FROM px WHERE band = 0 GROUP BY 1) SELECT zone, round((rank() OVER (ORDER BY v DESC) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS concern FROM m""")
def o01_concern(spark, sf_dir):
    """Average-rank percentile, the lowest value of highest concern."""
    m = views.pixels(spark, sf_dir).where("band = 0").groupBy("zone").agg(F.avg("value").alias("v"))
    return m.select("zone", r6(screening.concern_percentile("v", F.lit(True)), "concern"))


@query(f"{_SCORED} SELECT device, horizon_h, model, round(avg(abs(y - pred)), 6) AS mae FROM m GROUP BY 1, 2, 3 ORDER BY horizon_h, mae, device, model")
def o03_ordered_results(spark, sf_dir):
    by = stacked(spark, sf_dir).groupBy("device", "horizon_h", "model").agg(r6(scoring.mae(), "mae"))
    return by.orderBy("horizon_h", "mae", "device", "model")


@query(f"""{_EVENTS} SELECT device, "start", round(trough, 3) AS trough, round(peak, 3) AS peak, round(jump, 3) AS jump FROM ev ORDER BY device, "start" """)
def o06_event_catalogue(spark, sf_dir):
    return found_events(spark, sf_dir).select("device", "start", *[F.round(c, 3).alias(c) for c in ("trough", "peak", "jump")]).orderBy("device", "start")


@query(f"WITH {GRID} SELECT DISTINCT ts FROM g")
def u02_index_union(spark, sf_dir):
    """The hours of any device."""
    return hourly(spark, sf_dir).select("ts").distinct()


@query(f"WITH {GRID} SELECT ts FROM g WHERE device = 'click' AND value IS NOT NULL INTERSECT SELECT ts FROM g WHERE device = 'view' AND value IS NOT NULL")
def u04_intersection(spark, sf_dir):
    """Hours that two devices both observed."""
    g = hourly(spark, sf_dir).where("value is not null")
    return g.where("device = 'click'").select("ts").intersect(g.where("device = 'view'").select("ts"))


_E = "(SELECT vec_id, list_transform(embedding, lambda x: abs(x)) AS e FROM embeddings)"


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x)).alias("e"))
    return e.select("vec_id", *[F.get("e", F.lit(i)).alias(c) for i, c in enumerate(("r", "g", "b", "nir", "re"))])


@query(f"SELECT vec_id, greatest(-1, least(1, (e[4] - e[1]) / (e[4] + e[1] + 1e-8::FLOAT))) AS ndvi FROM {_E}")
def x02_ndvi(spark, sf_dir):
    return _bands(spark, sf_dir).select("vec_id", screening.ndvi(F.col("nir"), F.col("r")).alias("ndvi"))


@query(f"SELECT vec_id, greatest(-1, least(1, (e[4] - e[5]) / (e[4] + e[5] + 1e-8::FLOAT))) AS ndre FROM {_E}")
def x03_ndre(spark, sf_dir):
    return _bands(spark, sf_dir).select("vec_id", screening.ndre(F.col("nir"), F.col("re")).alias("ndre"))


@query(f"""SELECT vec_id, CAST(7 AS INT) AS channels, e[1] AS red, e[4] AS nir, greatest(-1, least(1, (e[4] - e[1]) / (e[4] + e[1] + 1e-8::FLOAT))) AS sixth, greatest(-1, least(1, (e[4] - e[5]) / (e[4] + e[5] + 1e-8::FLOAT))) AS seventh FROM {_E}""")
def x04_channel_stack(spark, sf_dir):
    s = _bands(spark, sf_dir).select("vec_id", screening.stacked_channels(*[F.col(c) for c in ("r", "g", "b", "nir", "re")]).alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    return s.select("vec_id", F.size("c").alias("channels"), at(0).alias("red"), at(3).alias("nir"), at(5).alias("sixth"), at(6).alias("seventh"))


@query(f"WITH {WEATHER} SELECT date, round(CASE WHEN temp_max_c IS NOT NULL AND temp_min_c IS NOT NULL THEN greatest((least(temp_max_c, 20) + least(temp_min_c, 20)) / 2 - 10, 0) END, 6) AS gdd FROM wd")
def x05_daily_gdd(spark, sf_dir):
    w = views.weather_daily(spark, sf_dir)
    return w.select("date", r6(phenology.daily_gdd(F.col("temp_max_c"), F.col("temp_min_c"), cap=20.0), "gdd"))


@query(f"""{_SCORED}, a AS (SELECT device, horizon_h, avg(abs(y - persistence)) AS b, avg(abs(y - seasonal)) AS s FROM s GROUP BY 1, 2) SELECT device, horizon_h, round(CASE WHEN b = 0 OR b IS NULL THEN 0 ELSE 1 - s / b END, 6) AS skill FROM a""")
def x07_skill(spark, sf_dir):
    err = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    return scored(spark, sf_dir).groupBy("device", "horizon_h").agg(r6(scoring.skill(err("seasonal"), err("persistence")), "skill"))


@query(f"""WITH {_PX}, m AS (SELECT zone, avg(value) AS v FROM px WHERE band = 1 GROUP BY 1) SELECT zone, CAST(v >= -0.002 AS INT) + CAST(v >= 0.0 AS INT) + CAST(v >= 0.002 AS INT) AS class FROM m""")
def x13_digitized(spark, sf_dir):
    """Classes of fixed thresholds; equal goes up."""
    m = views.pixels(spark, sf_dir).where("band = 1").groupBy("zone").agg(F.avg("value").alias("v"))
    return m.select("zone", screening.digitize(F.col("v"), [-0.002, 0.0, 0.002]).alias("class"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) < 1e-12 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio FROM lineitem")
def x14_guarded_ratio(spark, sf_dir):
    """No ratio over next to nothing."""
    l = views.table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", r6(scoring.guarded(F.col("l_tax"), F.col("l_discount")), "ratio"))


@query("SELECT c_nationkey, round(min(c_acctbal) FILTER (c_custkey % 3 <> 0), 6) AS least FROM customer GROUP BY 1")
def x15_finite_min(spark, sf_dir):
    """The least of the finite values; null if none is."""
    c = views.table(spark, sf_dir, "customer")
    x = F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return c.select("c_nationkey", x.alias("x")).groupBy("c_nationkey").agg(r6(F.min(scoring.finite(F.col("x"))), "least"))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1")
def x16_weighted_mean(spark, sf_dir):
    """Mean of the finite values by weight."""
    l = views.table(spark, sf_dir, "lineitem")  # noqa: E741
    x = scoring.finite(F.when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(F.col("l_discount")))
    return l.select("l_suppkey", x.alias("x"), F.col("l_quantity").alias("w")).groupBy("l_suppkey").agg(r6(scoring.weighted_mean(F.col("x"), F.col("w")), "mean")).where("mean is not null")


@query(f"""WITH {GRID}, t AS (SELECT max(ts) AS now FROM g), a AS (SELECT device, ts, (epoch(now) - epoch(ts)) / 3600.0::DOUBLE AS age FROM g CROSS JOIN t WHERE value IS NOT NULL)
SELECT device, ts, round(age, 4) AS age_h, CASE WHEN age < -0.25 THEN 'invalid' WHEN age > 48 THEN 'stale' ELSE 'ok' END AS status FROM a""")
def x19_age(spark, sf_dir):
    """Hours since each reading, seen from the last one, and its standing."""
    g = hourly(spark, sf_dir).select("device", "ts", "value")
    now = F.max("ts").over(Window.partitionBy(F.lit(0)))  # a row an hour
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600.0
    a = g.withColumn("age", age).where("value is not null")
    return a.select("device", "ts", F.round("age", 4).alias("age_h"), F.when(F.col("age") < -0.25, "invalid").when(F.col("age") > 48, "stale").otherwise("ok").alias("status"))


@query(f"{_SURV}, {_KM} SELECT device, CAST(h AS INT) AS h, round(g, 6) AS g FROM km")
def v02_censoring_curve(spark, sf_dir):
    """Product-limit curve of the censoring."""
    from ..operators import survival

    return survival.kaplan_meier(labelled(spark, sf_dir), HOURS, censoring=True).select("device", "h", r6("s", "g"))


@query(f"""{_SURV}, pp AS (SELECT device, event, time, unnest(range(1, least(time, 24) + 1)) AS period FROM sl), hz AS (SELECT device, period, count(*) FILTER (event AND period = time) / count(*)::DOUBLE AS l FROM pp GROUP BY 1, 2)
SELECT device, CAST(period AS INT) AS period, round(product(1 - l) OVER (PARTITION BY device ORDER BY period), 6) AS s FROM hz""")
def m15_hazard_survival(spark, sf_dir):
    """Hourly hazards to survival by running products."""
    from ..operators import survival

    p = survival.person_periods(labelled(spark, sf_dir), HOURS).groupBy("device", "period").agg((F.count_if("died") / F.count("*")).alias("l"))
    return p.select("device", "period", r6(F.product(1 - F.col("l")).over(Window.partitionBy("device").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)), "s"))


@query(f"""{_SURV}, pp AS (SELECT device, hour(ts) AS hr, unnest(range(1, least(time, 24) + 1)) AS period FROM sl)
SELECT device, CAST(count(*) FILTER (period <= 3) AS BIGINT) AS band_0, CAST(count(*) FILTER (period BETWEEN 4 AND 6) AS BIGINT) AS band_1, CAST(count(*) FILTER (period BETWEEN 7 AND 12) AS BIGINT) AS band_2, CAST(count(*) FILTER (period BETWEEN 13 AND 24) AS BIGINT) AS band_3,
CAST(count(*) FILTER (period > 24) AS BIGINT) AS band_4, round(sum(sin(2 * pi() * ((hr + period) % 24) / 24)), 4) AS sin_sum, round(sum(cos(2 * pi() * ((hr + period) % 24) / 24)), 4) AS cos_sum FROM pp GROUP BY 1""")
def m13_hazard_design(spark, sf_dir):
    """Sums of the period dummies and of the hour's cycle over all person-periods."""
    from ..operators import survival

    p = survival.person_periods(labelled(spark, sf_dir), HOURS)
    x = survival.hazard_columns(F.col("period"), F.pmod(F.hour("ts") + F.col("period"), F.lit(24)))
    d = p.select("device", *[v.alias(k) for k, v in x.items()])
    return d.groupBy("device").agg(*[F.sum(f"band_{i}").cast("long").alias(f"band_{i}") for i in range(5)], F.round(F.sum("hour_sin"), 4).alias("sin_sum"), F.round(F.sum("hour_cos"), 4).alias("cos_sum"))


@query(f"""{_SCORED}, q AS (SELECT device, horizon_h, y BETWEEN persistence - 50 AND persistence + 50 AS inside FROM s) SELECT device, horizon_h, round(avg(CAST(inside AS INT)), 6) AS coverage FROM q GROUP BY 1, 2""")
def d06_coverage(spark, sf_dir):
    """Share of truths in a closed interval."""
    return scored(spark, sf_dir).groupBy("device", "horizon_h").agg(r6(scoring.coverage(F.col("y"), F.col("persistence") - 50, F.col("persistence") + 50), "coverage"))


@query(f"""WITH {FOLDS}, o AS (SELECT device, value AS v, row_number() OVER (PARTITION BY device ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY device) AS n FROM f WHERE fold < 0 AND value IS NOT NULL)
SELECT device, k, round(v, 6) AS v FROM o WHERE n <= 100 OR k IN (SELECT CAST(round_even(j * (o.n - 1) / 99.0::DOUBLE, 0) AS BIGINT) FROM range(100) r(j))""")
def d07_climatology_sample(spark, sf_dir):
    """At most 100 evenly spaced order statistics of the first half."""
    w = Window.partitionBy("device")
    o = folded(spark, sf_dir).where("fold < 0 and value is not null").select("device", F.col("value").alias("v"), (F.row_number().over(w.orderBy("value")) - 1).cast("long").alias("k"), F.count("*").over(w).alias("n"))
    near = F.bround(F.bround(F.col("k") * 99.0 / (F.col("n") - 1), 0) * (F.col("n") - 1) / 99.0, 0)
    return o.where((F.col("n") <= 100) | (near == F.col("k"))).select("device", "k", r6("v", "v"))


@query(f"""WITH {GRID}, z AS (SELECT device, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS z FROM g), k AS (SELECT device, z, row_number() OVER (PARTITION BY device ORDER BY z) - 1 AS k, count(*) OVER (PARTITION BY device) AS n FROM z WHERE z IS NOT NULL)
SELECT device, round(1 - 0.5 * (2 * sum(z * (2 * k - n + 1)) / (max(n) * max(n))::DOUBLE) / avg(abs(z)), 6) AS ceiling FROM k GROUP BY 1 HAVING avg(abs(z)) > 0""")
def d11_skill_ceiling(spark, sf_dir):
    """What any sharper shape could gain at most."""
    w = Window.partitionBy("device")
    z = baselines.hourly_deltas(hourly(spark, sf_dir)).where("delta is not null").select("device", F.col("delta").alias("z"))
    k = z.withColumn("k", F.row_number().over(w.orderBy("z")) - 1).withColumn("n", F.count("*").over(w))
    n = F.max("n").cast("double")
    gmd = 2 * F.sum(F.col("z") * (2 * F.col("k") - F.col("n") + 1)) / (n * n)
    return k.groupBy("device").agg(r6(1 - 0.5 * gmd / F.avg(F.abs("z")), "ceiling"), F.avg(F.abs("z")).alias("m")).where("m > 0").drop("m")


_RULE = "SELECT device, horizon_h, y < 25 AS event, persistence < 25 AS alert FROM s"


@query(f"{_SCORED}, q AS ({_RULE}) SELECT device, horizon_h, round(avg(CASE WHEN alert THEN 0.3 WHEN event THEN 1 ELSE 0 END::DOUBLE), 6) AS expense FROM q GROUP BY 1, 2")
def d17_expense(spark, sf_dir):
    """Mean expense of acting on alerts at a cost of 0.3."""
    a, e = scoring.below("persistence", ALERT_BELOW), scoring.below("y", ALERT_BELOW)
    return scored(spark, sf_dir).groupBy("device", "horizon_h").agg(r6(scoring.cost_loss_expense(a, e, 0.3), "expense"))


@query(f"WITH {GRID}, z AS (SELECT device, ts, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS z FROM g) SELECT device, ts, round(z, 6) AS z FROM z WHERE z IS NOT NULL")
def d19_increment_pool(spark, sf_dir):
    """All gap-free hourly changes."""
    return baselines.hourly_deltas(hourly(spark, sf_dir)).where("delta is not null").select("device", "ts", r6("delta", "z"))


@query(f"""WITH {GRID}, z AS (SELECT device, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS z FROM g), q AS (SELECT device, quantile_cont(z, [{", ".join(f"{(k + 0.5) / 16}" for k in range(16))}]) AS q FROM z WHERE z IS NOT NULL GROUP BY 1 HAVING count(*) >= 48)
SELECT device, CAST(k AS INT) AS k, round(q[k + 1], 6) AS z FROM q, (SELECT unnest(range(16)) AS k)""")
def d22_discretized_pool(spark, sf_dir):
    """Sixteen quantile points of each pool of 48 changes or more."""
    z = baselines.hourly_deltas(hourly(spark, sf_dir)).where("delta is not null")
    q = z.groupBy("device").agg(F.percentile("delta", F.array(*[F.lit((k + 0.5) / 16) for k in range(16)])).alias("q"), F.count("*").alias("n")).where("n >= 48")
    return q.select("device", F.posexplode("q").alias("k", "z")).select("device", "k", r6("z", "z"))


@query(f"""WITH {GRID}, z AS (SELECT device, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS z FROM g), q AS (SELECT device, quantile_cont(z, [{", ".join(f"{(k + 0.5) / 16}" for k in range(16))}]) AS q FROM z WHERE z IS NOT NULL GROUP BY 1 HAVING count(*) >= 48),
u AS (SELECT device, CAST(k AS INT) AS k, q[k + 1] AS z FROM q, (SELECT unnest(range(16)) AS k)) SELECT device, k, round(2 + 3 * (z - avg(z) OVER (PARTITION BY device)) / stddev_pop(z) OVER (PARTITION BY device), 6) AS z FROM u""")
def d21_filtered_increments(spark, sf_dir):
    """A pool's shape at mean 2 and deviation 3, by the points' own (population) moments."""
    z = baselines.hourly_deltas(hourly(spark, sf_dir)).where("delta is not null")
    q = z.groupBy("device").agg(F.percentile("delta", F.array(*[F.lit((k + 0.5) / 16) for k in range(16)])).alias("q"), F.count("*").alias("n")).where("n >= 48")
    u, w = q.select("device", F.posexplode("q").alias("k", "z")), Window.partitionBy("device")
    return u.select("device", "k", r6(2 + 3 * (F.col("z") - F.avg("z").over(w)) / F.stddev_pop("z").over(w), "z"))


@query(f"{_SCORED}, q AS (SELECT device, horizon_h, CASE WHEN y < 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS e, least(greatest(seasonal / 400, 1e-15), 1 - 1e-15) AS p FROM s) SELECT device, horizon_h, round(-avg(e * ln(p) + (1 - e) * ln(1 - p)), 6) AS log_loss FROM q GROUP BY 1, 2")
def d30_log_loss(spark, sf_dir):
    e = scoring.below("y", ALERT_BELOW).cast("double")
    return scored(spark, sf_dir).groupBy("device", "horizon_h").agg(r6(scoring.log_loss(e, F.col("seasonal") / 400), "log_loss"))


@query(f"""{_SCORED}, q AS (SELECT y < 25 AS event, seasonal < 25 AS alert, unnest([0.1, 0.2, 0.4]::DOUBLE[]) AS alpha FROM s), a AS (SELECT alpha, avg(CASE WHEN alert THEN alpha WHEN event THEN 1 ELSE 0 END) AS x, avg(CAST(event AS DOUBLE)) AS r FROM q GROUP BY 1)
SELECT alpha, CASE WHEN least(alpha, r) - alpha * r > 1e-12 THEN round((least(alpha, r) - x) / (least(alpha, r) - alpha * r), 6) END AS value FROM a""")
def e19_value_table(spark, sf_dir):
    """Economic value of a rule at several costs."""
    rows = scored(spark, sf_dir).withColumn("alpha", F.explode(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.4))))
    rows = rows.withColumn("event", scoring.below("y", ALERT_BELOW)).withColumn("alert", scoring.below("seasonal", ALERT_BELOW))
    by = rows.groupBy("alpha").agg(scoring.cost_loss_expense(F.col("alert"), F.col("event"), F.col("alpha")).alias("x"), F.avg(F.col("event").cast("double")).alias("r"))
    climate, perfect = F.least("alpha", "r"), F.col("alpha") * F.col("r")
    return by.select("alpha", r6(F.when(climate - perfect > 1e-12, (climate - F.col("x")) / (climate - perfect)), "value"))


@query(f"{_STUDY} SELECT device, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse FROM sv WHERE in_event GROUP BY 1")
def e13_score_on_mask(spark, sf_dir):
    """Scores on event hours only."""
    return study(spark, sf_dir).where("in_event").groupBy("device").agg(F.count("*").alias("n"), r6(scoring.mae(), "mae"), r6(scoring.rmse(), "rmse"))


_FOLDSKILL = f"""{_MASK}, sp AS (SELECT device, ts, fold, in_event, value AS y, lag(value, 24) OVER w AS p, lag(value, 48) OVER w AS q FROM im WINDOW w AS (PARTITION BY device ORDER BY ts)),
fs AS (SELECT device, fold, avg(abs(y - q)) AS m, avg(abs(y - p)) AS b FROM sp WHERE fold >= 0 AND in_event AND y IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL GROUP BY 1, 2)"""


@query(f"{_FOLDSKILL} SELECT device, round(min(CASE WHEN b = 0 THEN 0 ELSE 1 - m / b END), 6) AS worst_skill FROM fs GROUP BY 1")
def e14_worst_fold(spark, sf_dir):
    """Least skill of any fold on event hours."""
    g = folded(spark, sf_dir).select("device", "ts", "fold", F.col("value").alias("y"), baselines.persistence(24).alias("p"), baselines.persistence(48).alias("q"))
    rows = events.in_event(g, found_events(spark, sf_dir)).where("in_event and fold >= 0 and y is not null and p is not null and q is not null")
    by = rows.groupBy("device", "fold").agg(scoring.mae("y", "q").alias("m"), scoring.mae("y", "p").alias("b"))
    return by.groupBy("device").agg(r6(F.min(scoring.skill(F.col("m"), F.col("b"))), "worst_skill"))


@query(f"""{_STUDY} SELECT device, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (in_event) AS BIGINT) AS event_hours, round(avg(abs(y - p)) FILTER (in_event), 6) AS event_mae, round(avg(abs(y - p)) FILTER (NOT in_event), 6) AS quiet_mae,
round(CASE WHEN sum(abs(y - p)) = 0 THEN 0 ELSE coalesce(sum(abs(y - p)) FILTER (in_event), 0) / sum(abs(y - p)) END, 6) AS event_share FROM sv GROUP BY 1""")
def e11_event_study(spark, sf_dir):
    """A device's errors in and out of events in one line."""
    err, ev = F.abs(F.col("y") - F.col("p")), F.col("in_event")
    return study(spark, sf_dir).groupBy("device").agg(
        F.count("*").alias("n"), F.count_if(ev).alias("event_hours"), r6(F.avg(F.when(ev, err)), "event_mae"), r6(F.avg(F.when(~ev, err)), "quiet_mae"),
        r6(scoring.ratio(F.sum(F.when(ev, err).otherwise(0.0)), F.sum(err)), "event_share"),
    )


@query(f"{_SCORED} SELECT device, model, CAST(count(*) AS BIGINT) AS n FROM m WHERE fold = 2 AND horizon_h = 24 GROUP BY 1, 2")
def e07_pooled_rows(spark, sf_dir):
    """Valid rows of one fold and lead, by device."""
    return stacked(spark, sf_dir).where("fold = 2 and horizon_h = 24").groupBy("device", "model").agg(F.count("*").alias("n"))


@query(f"""{_SCORED} SELECT device, round(max(x) FILTER (horizon_h = 6), 6) AS h6, round(max(x) FILTER (horizon_h = 12), 6) AS h12, round(max(x) FILTER (horizon_h = 24), 6) AS h24, round(max(x) FILTER (horizon_h = 48), 6) AS h48
FROM (SELECT device, horizon_h, CASE WHEN avg(abs(y - persistence)) = 0 THEN 0 ELSE 1 - avg(abs(y - seasonal)) / avg(abs(y - persistence)) END AS x FROM s GROUP BY 1, 2) GROUP BY 1""")
def e24_skill_table(spark, sf_dir):
    """Skill by device, leads side by side."""
    err = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    by = scored(spark, sf_dir).groupBy("device", "horizon_h").agg(r6(scoring.skill(err("seasonal"), err("persistence")), "x"))
    wide = by.groupBy("device").pivot("horizon_h", [6, 12, 24, 48]).agg(F.first("x"))
    return wide.select("device", *[F.col(str(h)).alias(f"h{h}") for h in (6, 12, 24, 48)])


@query(f"""{_VOL}, l AS (SELECT device, max(ts) AS read_at, arg_max(value, ts) AS level, arg_max(drift, ts) AS mu FROM ew WHERE value IS NOT NULL AND drift IS NOT NULL GROUP BY 1) SELECT device, read_at, round(level, 5) AS level, round(mu, 5) AS mu, CASE WHEN mu < 0 THEN round(60 / -mu, 3) END AS hours_left FROM l""")
def e22_clock_reading(spark, sf_dir):
    """The drydown clock at the last hour that has a level and a drift."""
    v = volatility(spark, sf_dir).where("value is not null and drift is not null")
    l = v.groupBy("device").agg(F.max("ts").alias("read_at"), F.max_by("value", "ts").alias("level"), F.max_by("drift", "ts").alias("mu"))  # noqa: E741
    return l.select("device", "read_at", F.round("level", 5).alias("level"), F.round("mu", 5).alias("mu"), F.when(F.col("mu") < 0, F.round(60 / -F.col("mu"), 3)).alias("hours_left"))


@query(f"WITH {_PX} SELECT zone, CAST(pos // 256 AS BIGINT) AS tile, round(avg(CASE WHEN value > -0.2 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS valid_fraction, round(avg(value) FILTER (value > -0.2), 6) AS mean FROM px WHERE band = 0 GROUP BY 1, 2")
def g03_patch_validity(spark, sf_dir):
    """Share of valid cells of each patch, and their mean."""
    p = views.pixels(spark, sf_dir).where("band = 0")
    ok = F.col("value") > -0.2
    return p.groupBy("zone", F.floor(F.col("pos") / 256).alias("tile")).agg(r6(F.avg(ok.cast("double")), "valid_fraction"), r6(F.avg(F.when(ok, F.col("value"))), "mean"))


@query("SELECT 'ok' AS status")
def g07_health(spark, sf_dir):
    """The service answers, and its engine too."""
    return spark.range(1).select(F.lit("ok").alias("status"))


@query("SELECT DISTINCT 'B' || o_custkey AS block_id, CAST(NULL AS BOOLEAN) AS ready, CAST(NULL AS DATE) AS date FROM orders")
def g08_harvest_readiness(spark, sf_dir):
    """Not modelled: nulls for every block."""
    o = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("B"), "o_custkey").alias("block_id")).distinct()
    return o.select("block_id", F.lit(None).cast("boolean").alias("ready"), F.lit(None).cast("date").alias("date"))


_TILES = "(SELECT p_partkey, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM (SELECT p_partkey, p_size * 4 AS h, p_size * 3 AS w FROM part) p, (SELECT unnest(range(0, 400, 32)) AS r) rr, (SELECT unnest(range(0, 400, 32)) AS c) cc WHERE r + 32 <= h AND c + 32 <= w)"


@query(f"SELECT p_partkey, row, col FROM {_TILES} WHERE row >= 10 AND col >= 10 AND row + 32 <= 110 AND col + 32 <= 110")
def g02_block_windows(spark, sf_dir):
    """Tiles that lie wholly within a block's polygon."""
    p = views.table(spark, sf_dir, "part")
    t = p.select("p_partkey", F.inline(screening.tile_origins(F.col("p_size") * 4, F.col("p_size") * 3, 32)))
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((9.5, 9.5), (110.5, 9.5), (110.5, 110.5), (9.5, 110.5))])
    corner = lambda dr, dc: screening.contains(ring, F.col("col") + dc, F.col("row") + dr)
    return t.where(corner(0, 0) & corner(0, 32) & corner(32, 0) & corner(32, 32))


@query(f"""SELECT m.vec_id, CAST(i AS INT) AS i, round((e[32 - i] - s.mean) / s.std, 5) AS v FROM (SELECT vec_id, embedding[1:32] AS e FROM embeddings) m, (SELECT unnest(range(32)) AS i), (WITH {_PX} SELECT avg(value) AS mean, greatest(stddev_pop(value), 1e-6) AS std FROM px WHERE band = 0 AND zone % 2 = 0) s""")
def m21_normalized_batch(spark, sf_dir):
    """Patches standardized by the training patches' moments, and flipped."""
    s = views.pixels(spark, sf_dir).where("band = 0 and zone % 2 = 0").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(1e-6)).alias("std")).first()
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.reverse(F.slice("embedding", 1, 32))).alias("i", "x"))
    if s["std"] is None:
        return e.select("vec_id", "i", F.lit(None).cast("double").alias("v"))
    return e.select("vec_id", "i", F.round((F.col("x").cast("double") - s["mean"]) / s["std"], 5).alias("v"))


@query(f"""{_RANKED} SELECT zone, quality_ok, CASE WHEN quality_ok THEN CAST(rank() OVER (PARTITION BY quality_ok ORDER BY round(score, 9) DESC) AS INT) END AS rank FROM sc""")
def g01_screened_rasters(spark, sf_dir):
    """From pixels of two indices to ranks of blocks."""
    return ranked(spark, sf_dir).select("zone", "quality_ok", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH a AS ({ORACLE_SQL["w12_diurnal_drift_temp"]}), {FOLDS} SELECT f.device, CAST(count(*) AS BIGINT) AS n, round(avg(abs(f.value - a.forecast)), 5) AS mae FROM f JOIN a ON a.device = f.device AND a.ts = f.ts WHERE fold >= 0 AND f.value IS NOT NULL AND a.forecast IS NOT NULL GROUP BY 1""")
def m17_temperature_drift(spark, sf_dir):
    """Scores of the drift by temperature class."""
    g = folds.with_folds(with_weather(spark, sf_dir).withColumnRenamed("temp_mean_c", "temp"))
    f = baselines.diurnal_drift_temp(g, g.where("fold = -1"), 6).where("fold >= 0 and value is not null and forecast is not null")
    return f.groupBy("device").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("value") - F.col("forecast"))), 5).alias("mae"))

"""Queries on events, gates, volatility, crossings and survival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import baselines, events, features, grid, scoring, survival
from ..sources import views
from .registry import FOLDS, GRID, WEATHER, query
from .sensor import ALERT_BELOW, _SCORED, folded, hourly, r6, scored, stacked, with_vintages, _VINTAGE

_EVENTS = f"""WITH {FOLDS}, {WEATHER}, d AS (SELECT device, ts, value, lag(ts) OVER w AS from_ts, lag(value) OVER w AS from_v, value - lag(value) OVER w AS d FROM f WINDOW w AS (PARTITION BY device ORDER BY ts)),
u AS (SELECT *, coalesce(d > 0, false) AS up, d IS NOT NULL AND NOT d > 0 AS flat FROM d),
n AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER w AS run, lag(flat) OVER w AS cb, lead(flat) OVER w AS ca FROM u WINDOW w AS (PARTITION BY device ORDER BY ts)),
r AS (SELECT device, run, min(from_ts) AS "start", max(ts) AS "end", arg_min(from_v, ts) AS trough, arg_max(value, ts) AS peak, count(*) AS span_h, arg_min(cb, ts) AS cb, arg_max(ca, ts) AS ca FROM n WHERE up GROUP BY 1, 2),
ev AS MATERIALIZED (SELECT device, "start", "end", trough, peak, peak - trough AS jump, span_h FROM r WHERE coalesce(cb, false) AND coalesce(ca, false) AND peak - trough >= 60 AND span_h <= 12)"""


def found_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.rise_events(hourly(spark, sf_dir), min_jump=60.0)


@query(f"""{_EVENTS} SELECT ev.device, "start", "end", round(trough, 3) AS trough, round(peak, 3) AS peak, round(jump, 3) AS jump, CAST(span_h AS BIGINT) AS span_h,
CASE WHEN coalesce(a.precip_mm >= 1, false) OR coalesce(b.precip_mm >= 1, false) THEN 'rain' ELSE 'irrigation' END AS attribution
FROM ev LEFT JOIN wd a ON a.date = CAST("start" AS DATE) LEFT JOIN wd b ON b.date + 1 = CAST("start" AS DATE)""")
def w18_rise_events(spark, sf_dir):
    """Event catalogue with attribution, to three decimals."""
    found = events.attribute_rain(found_events(spark, sf_dir), views.weather_daily(spark, sf_dir))
    return found.select("device", "start", "end", *[F.round(c, 3).alias(c) for c in ("trough", "peak", "jump")], "span_h", "attribution")


_MASK = f"""{_EVENTS}, ie AS (SELECT DISTINCT f.device, f.ts FROM f JOIN ev ON ev.device = f.device AND f.ts >= ev."start" AND f.ts <= ev."end" + INTERVAL 24 HOUR),
im AS (SELECT f.*, ie.ts IS NOT NULL AS in_event FROM f LEFT JOIN ie ON ie.device = f.device AND ie.ts = f.ts)"""


@query(f"{_MASK} SELECT device, ts, in_event FROM im")
def p08_event_mask(spark, sf_dir):
    return events.in_event(hourly(spark, sf_dir), found_events(spark, sf_dir)).select("device", "ts", "in_event")


_STUDY = f"""{_MASK}, sp AS (SELECT device, ts, fold, in_event, value AS y, lag(value, 24) OVER (PARTITION BY device ORDER BY ts) AS p FROM im),
sv AS (SELECT * FROM sp WHERE fold >= 0 AND y IS NOT NULL AND p IS NOT NULL)"""


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = folded(spark, sf_dir).select("device", "ts", "fold", F.col("value").alias("y"), baselines.persistence(24).alias("p"))
    return events.in_event(g, found_events(spark, sf_dir)).where("fold >= 0 and y is not null and p is not null")


@query(f"""{_STUDY}, x AS (SELECT device, unnest(['all', CASE WHEN in_event THEN 'event' ELSE 'quiet' END]) AS subset, y, p FROM sv),
k AS (SELECT DISTINCT device, unnest(['all', 'event', 'quiet']) AS subset FROM f)
SELECT k.device, k.subset, CAST(count(x.y) AS BIGINT) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse FROM k LEFT JOIN x ON x.device = k.device AND x.subset = k.subset GROUP BY 1, 2""")
def e09_subset_metrics(spark, sf_dir):
    """Persistence on event hours, quiet hours and all; an empty subset has n = 0 and no scores."""
    rows = study(spark, sf_dir).withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col("in_event"), "event").otherwise("quiet"))))
    keys = hourly(spark, sf_dir).select("device").distinct().withColumn("subset", F.explode(F.array(F.lit("all"), F.lit("event"), F.lit("quiet"))))
    return keys.join(rows, ["device", "subset"], "left").groupBy("device", "subset").agg(F.count("y").alias("n"), r6(scoring.mae(), "mae"), r6(scoring.rmse(), "rmse"))


@query(f"{_STUDY} SELECT device, round(CASE WHEN sum(abs(y - p)) = 0 THEN 0 ELSE coalesce(sum(abs(y - p)) FILTER (in_event), 0) / sum(abs(y - p)) END, 6) AS share FROM sv GROUP BY 1")
def e10_event_error_share(spark, sf_dir):
    err = F.abs(F.col("y") - F.col("p"))
    return study(spark, sf_dir).groupBy("device").agg(r6(scoring.ratio(F.sum(F.when(F.col("in_event"), err).otherwise(0.0)), F.sum(err)), "share"))


_GATED = f"""{_VINTAGE}, nn AS (SELECT *, count(*) OVER (PARTITION BY device) AS n FROM jv), fc AS (SELECT device, ts, i, n, value AS y, lag(value, 24) OVER w AS pers, avg(value) OVER (w ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING) AS chal,
lag(precip_mm_prev1, 24) OVER w AS gate FROM nn WINDOW w AS (PARTITION BY device ORDER BY ts)),
gv AS MATERIALIZED (SELECT * FROM fc WHERE i >= n // 2 AND y IS NOT NULL AND pers IS NOT NULL), th AS (SELECT unnest([0.0, 1.5, 2.5, 3.5]::DOUBLE[]) AS threshold)"""
THRESHOLDS = (0.0, 1.5, 2.5, 3.5)


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, threshold, y, pers, pred, fired): the hybrid at every threshold over the second half."""
    v = with_vintages(spark, sf_dir)
    w = grid.over()
    rows = v.withColumn("n", F.count("*").over(Window.partitionBy("device"))).select(
        "device", "ts", "i", "n", F.col("value").alias("y"), F.lag("value", 24).over(w).alias("pers"), F.avg("value").over(w.rowsBetween(-47, -24)).alias("chal"),
        F.lag("precip_mm_prev1", 24).over(w).alias("gate"),
    )
    rows = rows.where("i >= floor(n / 2) and y is not null and pers is not null")
    wide = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    fired = F.coalesce(F.col("gate") >= F.col("threshold"), F.lit(False))
    return wide.withColumn("fired", fired).withColumn("pred", events.hybrid(F.col("pers"), F.col("chal"), F.col("fired")))


@query(f"""{_GATED}, a AS (SELECT device, threshold, y, pers, coalesce(gate >= threshold, false) AS fired, CASE WHEN coalesce(gate >= threshold, false) AND chal IS NOT NULL THEN chal ELSE pers END AS pred FROM gv CROSS JOIN th)
SELECT device, threshold, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(fired AS INT)), 6) AS fired_fraction, round(avg(abs(y - pred)), 6) AS mae, round(1 - avg(abs(y - pred)) / avg(abs(y - pers)), 6) AS skill,
round(avg(abs(y - pred)) FILTER (fired), 6) AS mae_fired FROM a GROUP BY 1, 2""")
def e15_gated_hybrid(spark, sf_dir):
    """The hybrid at each threshold, over all hours and where the gate fired."""
    err, base = F.avg(F.abs(F.col("y") - F.col("pred"))), F.avg(F.abs(F.col("y") - F.col("pers")))
    return gated(spark, sf_dir).groupBy("device", "threshold").agg(
        F.count("*").alias("n"), r6(F.avg(F.col("fired").cast("double")), "fired_fraction"), r6(err, "mae"), r6(scoring.skill(err, base), "skill"),
        r6(F.avg(F.when(F.col("fired"), F.abs(F.col("y") - F.col("pred")))), "mae_fired"),
    )


@query(f"""{_GATED}, a AS (SELECT device, threshold, avg(abs(y - CASE WHEN coalesce(gate >= threshold, false) AND chal IS NOT NULL THEN chal ELSE pers END)) AS mae FROM gv CROSS JOIN th WHERE i < n // 2 + n // 4 GROUP BY 1, 2)
SELECT device, threshold FROM a QUALIFY row_number() OVER (PARTITION BY device ORDER BY round(mae, 9), threshold DESC) = 1""")
def e12_select_threshold(spark, sf_dir):
    """The threshold that does best on the inner holdout; of equals the largest."""
    inner = gated(spark, sf_dir).where("i < floor(n / 2) + floor(n / 4)").groupBy("device", "threshold").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))
    best = F.row_number().over(Window.partitionBy("device").orderBy(F.round("mae", 9), F.desc("threshold")))
    return inner.withColumn("r", best).where("r = 1").select("device", "threshold")


def _ewma_sql(x: str, name: str, halflife: float) -> str:
    return f"CASE WHEN count({x}) OVER w >= 24 THEN sum({x} * pow(2, k_{name} / {halflife}::DOUBLE)) OVER w / sum(CASE WHEN {x} IS NOT NULL THEN pow(2, k_{name} / {halflife}::DOUBLE) END) OVER w END AS {name}"


_VOL = f"""WITH {GRID}, dl AS (SELECT *, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS d, abs(value - lag(value, 6) OVER (PARTITION BY device ORDER BY ts)) AS e FROM g),
kk AS (SELECT *, d * d AS d2, count(d) OVER w AS k_vol, count(d) OVER w AS k_drift, count(e) OVER w AS k_err FROM dl WINDOW w AS (PARTITION BY device ORDER BY ts)),
ew AS (SELECT device, ts, i, value, d, {_ewma_sql("d2", "vol", 72.0)}, {_ewma_sql("d", "drift", 336.0)}, {_ewma_sql("e", "err", 72.0)} FROM kk WINDOW w AS (PARTITION BY device ORDER BY ts))"""


def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with delta, sigma (root of the weighted mean squared delta) and drift."""
    g = baselines.hourly_deltas(hourly(spark, sf_dir)).withColumn("d2", F.col("delta") * F.col("delta"))
    return features.ewma_frame(features.ewma_frame(g, "d2", "vol", 72.0), "delta", "drift", 336.0).withColumn("sigma", F.sqrt("vol"))


@query(f"{_VOL} SELECT device, ts, round(sqrt(vol), 5) AS sigma, round(drift, 5) AS drift FROM ew")
def w14_ewma(spark, sf_dir):
    """Exponentially weighted volatility and drift."""
    return volatility(spark, sf_dir).select("device", "ts", F.round("sigma", 5).alias("sigma"), F.round("drift", 5).alias("drift"))


@query(f"{_VOL} SELECT device, ts, CASE WHEN lag(err, 6) OVER w IS NOT NULL THEN round(greatest(lag(err, 6) OVER w * sqrt(pi() / 2), 1e-6), 5) END AS sigma FROM ew WINDOW w AS (PARTITION BY device ORDER BY ts)")
def w16_ewma_sigma(spark, sf_dir):
    """Spread of the 6-hour error, as known at forecasting time."""
    g = hourly(spark, sf_dir).withColumn("e", F.abs(F.col("value") - baselines.persistence(6)))
    s = F.lag("err", 6).over(grid.over()) * F.sqrt(F.pi() / 2)
    return features.ewma_frame(g, "e", "err", 72.0).select("device", "ts", F.round(F.when(s.isNotNull(), F.greatest(s, F.lit(1e-6))), 5).alias("sigma"))


@query(f"""WITH {FOLDS}, er AS (SELECT *, abs(value - lag(value, 6) OVER (PARTITION BY device ORDER BY ts)) AS e FROM f), fo AS (SELECT DISTINCT device, n, unnest(range(5)) AS for_fold FROM f)
SELECT er.device, CAST(for_fold AS INT) AS for_fold, CASE WHEN count(e) >= 24 THEN round(greatest(avg(e) * sqrt(pi() / 2), 1e-6), 6) END AS sigma FROM er JOIN fo ON fo.device = er.device
WHERE er.i < er.n // 2 + CAST(round_even(for_fold * (er.n - er.n // 2) / 5.0, 0) AS BIGINT) - 5 GROUP BY 1, 2""")
def w17_fixed_sigma(spark, sf_dir):
    """One spread a fold, from its purged training set."""
    from ..operators import folds

    g = folded(spark, sf_dir).withColumn("e", F.abs(F.col("value") - baselines.persistence(6)))
    t = folds.purged_train(g, 6).groupBy("device", "for_fold").agg(F.avg("e").alias("m"), F.count("e").alias("k"))
    return t.select("device", "for_fold", r6(F.when(F.col("k") >= 24, F.greatest(F.col("m") * F.sqrt(F.pi() / 2), F.lit(1e-6))), "sigma"))


_LABELS = "value IS NOT NULL AND count(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) = 6"


@query(f"""WITH {GRID}, x AS (SELECT device, ts, {_LABELS} AS valid, max(CASE WHEN value < 25 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS under,
max(CASE WHEN value <= 25 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS at_or_under, coalesce(min(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) <= value - 10, false) AS fell FROM g WINDOW w AS (PARTITION BY device ORDER BY ts))
SELECT device, ts, valid, valid AND coalesce(under, 0) = 1 AS crossed, valid AND coalesce(at_or_under, 0) = 1 AS reached, valid AND fell AS fell FROM x""")
def w22_crossing_labels(spark, sf_dir):
    """Crossings of a level, strict and not, and drawdowns within 6 hours."""
    g = hourly(spark, sf_dir)
    a = events.crossing_labels(g, 6, ALERT_BELOW)
    b = events.crossing_labels(a.withColumnRenamed("crossed", "c1").drop("valid"), 6, ALERT_BELOW, strict=False).withColumnRenamed("crossed", "reached").drop("valid")
    c = events.drawdown_labels(b, 6, 10.0)
    return c.select("device", "ts", "valid", F.col("c1").alias("crossed"), "reached", F.col("crossed").alias("fell"))


_SURV = f"""WITH {GRID}, nx AS (SELECT a.device, a.ts, a.i, a.value, b.i - a.i AS s, b.value AS v FROM g a JOIN g b ON b.device = a.device AND b.i > a.i AND b.i <= a.i + 24 WHERE a.value IS NOT NULL),
ag AS (SELECT device, ts, i, any_value(value) AS value, min(s) FILTER (v <= value - 60) AS hit, min(s) FILTER (v IS NULL) AS gap, count(*) AS seen FROM nx GROUP BY 1, 2, 3),
sn AS (SELECT *, CASE WHEN gap IS NOT NULL THEN gap - 1 ELSE seen END AS upto FROM ag),
sl AS MATERIALIZED (SELECT device, ts, i, value, CAST(CASE WHEN hit <= upto THEN hit WHEN upto = 24 THEN 25 ELSE upto END AS INT) AS time, coalesce(hit <= upto, false) AS event FROM sn WHERE upto > 0)"""
_KM = """hh AS (SELECT device, count(*) AS n, unnest(range(1, 25)) AS h FROM sl GROUP BY device),
ct AS (SELECT hh.device, hh.h, hh.n, coalesce(c.o, 0) AS o, coalesce(c.e, 0) AS e FROM hh LEFT JOIN (SELECT device, time, count(*) AS o, count(*) FILTER (event) AS e FROM sl GROUP BY 1, 2) c ON c.device = hh.device AND c.time = hh.h),
rk AS (SELECT *, n - coalesce(sum(o) OVER (PARTITION BY device ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM ct),
km AS (SELECT device, h, product(CASE WHEN r > 0 THEN 1 - e / r::DOUBLE ELSE 1 END) OVER (PARTITION BY device ORDER BY h) AS s,
product(CASE WHEN r > 0 THEN 1 - (o - e) / r::DOUBLE ELSE 1 END) OVER (PARTITION BY device ORDER BY h) AS g FROM rk)"""
DROP, HOURS = 60.0, 24


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.survival_labels(hourly(spark, sf_dir), DROP, HOURS)


@query(f"{_SURV} SELECT device, ts, time, event FROM sl")
def w25_survival_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("device", "ts", "time", "event")


@query(f"{_SURV}, {_KM} SELECT device, CAST(h AS INT) AS h, round(s, 6) AS s, round(g, 6) AS g FROM km")
def v01_kaplan_meier(spark, sf_dir):
    """Product-limit curves of the event and of the censoring."""
    rows = labelled(spark, sf_dir)
    s = survival.kaplan_meier(rows, HOURS)
    g = survival.kaplan_meier(rows, HOURS, censoring=True).withColumnRenamed("s", "g")
    return s.join(g, ["device", "h"]).select("device", "h", r6("s", "s"), r6("g", "g"))


_BRIER = f"""{_SURV}, {_KM}, gg AS (SELECT device, h, greatest(g, 1e-6) AS g FROM km UNION ALL SELECT DISTINCT device, 0, 1.0 FROM km),
bs AS (SELECT sl.device, km.h, sum(CASE WHEN event AND time <= km.h THEN s * s / gt.g WHEN time > km.h THEN (1 - s) ** 2 / gh.g ELSE 0 END) / count(*) AS brier FROM sl JOIN km ON km.device = sl.device
JOIN gg gh ON gh.device = sl.device AND gh.h = km.h LEFT JOIN gg gt ON gt.device = sl.device AND gt.h = sl.time - 1 GROUP BY 1, 2)"""


@query(f"{_BRIER} SELECT device, CAST(h AS INT) AS h, round(brier, 6) AS brier FROM bs")
def v03_censored_brier(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return survival.censored_brier(rows, survival.kaplan_meier(rows, HOURS), survival.kaplan_meier(rows, HOURS, censoring=True)).select("device", "h", r6("brier", "brier"))


@query(f"{_BRIER} SELECT device, round(avg(brier), 6) AS integrated_brier FROM bs GROUP BY 1")
def v04_integrated_brier(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    b = survival.censored_brier(rows, survival.kaplan_meier(rows, HOURS), survival.kaplan_meier(rows, HOURS, censoring=True))
    return b.groupBy("device").agg(r6(F.avg("brier"), "integrated_brier"))


@query(f"""{_SURV}, pp AS (SELECT device, event, time, unnest(range(1, least(time, 24) + 1)) AS period FROM sl)
SELECT device, CAST(period AS INT) AS period, CAST(count(*) AS BIGINT) AS at_risk, CAST(count(*) FILTER (event AND period = time) AS BIGINT) AS died FROM pp GROUP BY 1, 2""")
def v05_person_periods(spark, sf_dir):
    p = survival.person_periods(labelled(spark, sf_dir), HOURS)
    return p.groupBy("device", "period").agg(F.count("*").alias("at_risk"), F.count_if("died").alias("died"))


@query(f"""{_VOL}, l AS (SELECT device, arg_max(drift, ts) AS mu FROM ew WHERE drift IS NOT NULL GROUP BY 1), x AS (SELECT device, mu, unnest(range(1, 25)) AS h FROM l)
SELECT device, CAST(h AS INT) AS h, CASE WHEN mu >= 0 THEN 1.0 WHEN h < 60.0 / -mu THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM x""")
def v06_clock_survival(spark, sf_dir):
    """The drydown clock from the latest drift."""
    mu = volatility(spark, sf_dir).where("drift is not null").groupBy("device").agg(F.max_by("drift", "ts").alias("mu"))
    x = mu.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HOURS))))
    return x.select("device", "h", survival.clock_survival(F.col("mu"), DROP, F.col("h")).alias("s"))


@query(f"{_SURV}, {_KM} SELECT device, CAST(min(h) FILTER (1 - s >= 0.25) AS INT) AS q25, CAST(min(h) FILTER (1 - s >= 0.5) AS INT) AS q50, CAST(min(h) FILTER (1 - s >= 0.9) AS INT) AS q90 FROM km GROUP BY 1")
def v07_quantile_times(spark, sf_dir):
    s = survival.kaplan_meier(labelled(spark, sf_dir), HOURS)
    return s.groupBy("device").agg(*[F.min(F.when(1 - F.col("s") >= q, F.col("h"))).alias(f"q{round(100 * q)}") for q in (0.25, 0.5, 0.9)])


@query(f"""{_SCORED}, q AS (SELECT device, horizon_h, model, y, pred, greatest(0.1 * (y - pred), -0.9 * (y - pred)) AS l10, greatest(0.9 * (y - pred), -0.1 * (y - pred)) AS l90 FROM m)
SELECT device, horizon_h, model, round(avg(l10), 6) AS pinball_10, round(avg(l90), 6) AS pinball_90, round(avg(CASE WHEN y BETWEEN pred - 100 AND pred + 100 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS coverage FROM q GROUP BY 1, 2, 3""")
def d05_pinball(spark, sf_dir):
    """Pinball losses and the coverage of a fixed band."""
    y, p = F.col("y"), F.col("p")
    return stacked(spark, sf_dir).groupBy("device", "horizon_h", "model").agg(
        r6(scoring.pinball(y, p, 0.1), "pinball_10"), r6(scoring.pinball(y, p, 0.9), "pinball_90"), r6(scoring.coverage(y, p - 100, p + 100), "coverage")
    )


_Z = f"""WITH {GRID}, z0 AS (SELECT device, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS z FROM g), z AS (SELECT device, z, row_number() OVER (PARTITION BY device ORDER BY z) - 1 AS k, count(*) OVER (PARTITION BY device) AS n FROM z0 WHERE z IS NOT NULL)"""


@query(f"""{_Z}, a AS (SELECT device, 2 * sum(z * (2 * k - n + 1)) / (max(n) * max(n))::DOUBLE AS gmd, avg(abs(z)) AS mean_abs FROM z GROUP BY 1)
SELECT device, round(gmd, 6) AS gmd, round(CASE WHEN mean_abs > 0 THEN 1 - 0.5 * gmd / mean_abs END, 6) AS ceiling FROM a""")
def d09_gini_ceiling(spark, sf_dir):
    """Gini mean difference of hourly changes and the skill ceiling it sets."""
    z = baselines.hourly_deltas(hourly(spark, sf_dir)).where("delta is not null").select("device", F.col("delta").alias("z"))
    w = Window.partitionBy("device")
    k = z.withColumn("k", F.row_number().over(w.orderBy("z")) - 1).withColumn("n", F.count("*").over(w))
    n = F.max("n").cast("double")
    a = k.groupBy("device").agg((2 * F.sum(F.col("z") * (2 * F.col("k") - F.col("n") + 1)) / (n * n)).alias("gmd"), F.avg(F.abs("z")).alias("m"))
    return a.select("device", r6("gmd", "gmd"), r6(F.when(F.col("m") > 0, 1 - 0.5 * F.col("gmd") / F.col("m")), "ceiling"))


@query(f"""{_Z}, wz AS (SELECT device, z, 1 + k % 3 AS w FROM z), c AS (SELECT *, sum(w) OVER (PARTITION BY device) AS tw, coalesce(sum(w) OVER o, 0) AS bw, coalesce(sum(w * z) OVER o, 0) AS bwz FROM wz WINDOW o AS (PARTITION BY device ORDER BY z, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT device, round(2 * sum(w * (z * bw - bwz)) / (max(tw) * max(tw))::DOUBLE, 6) AS gmd FROM c GROUP BY 1""")
def d10_weighted_gini(spark, sf_dir):
    """Weighted mean difference by prefix sums."""
    z = baselines.hourly_deltas(hourly(spark, sf_dir)).where("delta is not null").select("device", F.col("delta").alias("z"))
    k = F.row_number().over(Window.partitionBy("device").orderBy("z")) - 1
    o = Window.partitionBy("device").orderBy("z", "w").rowsBetween(Window.unboundedPreceding, -1)
    c = z.withColumn("w", 1 + k % 3).select("device", "z", "w", F.coalesce(F.sum("w").over(o), F.lit(0)).alias("bw"), F.coalesce(F.sum(F.col("w") * F.col("z")).over(o), F.lit(0.0)).alias("bwz"), F.sum("w").over(Window.partitionBy("device")).alias("tw"))
    t = F.max("tw").cast("double")
    return c.groupBy("device").agg(r6(2 * F.sum(F.col("w") * (F.col("z") * F.col("bw") - F.col("bwz"))) / (t * t), "gmd"))


@query(f"""{_Z} SELECT device, k, round(z, 6) AS z FROM z WHERE n <= 64 OR k IN (SELECT CAST(round_even(j * (z.n - 1) / 63.0::DOUBLE, 0) AS BIGINT) FROM range(64) r(j))""")
def d12_shape_sample(spark, sf_dir):
    """At most 64 evenly spaced order statistics."""
    z = baselines.hourly_deltas(hourly(spark, sf_dir)).where("delta is not null").select("device", F.col("delta").alias("z"))
    w = Window.partitionBy("device")
    rows = z.select("device", "z", (F.row_number().over(w.orderBy("z")) - 1).cast("long").alias("k"), F.count("*").over(w).alias("n"))
    near = F.bround(F.bround(F.col("k") * 63.0 / (F.col("n") - 1), 0) * (F.col("n") - 1) / 63.0, 0)
    return rows.where((F.col("n") <= 64) | (near == F.col("k"))).select("device", "k", r6("z", "z"))


@query(f"""{_SCORED}, v AS (SELECT device, horizon_h, model, y < 25 AS event, pred < 25 AS alert, unnest([0.1, 0.3, 0.5]::DOUBLE[]) AS alpha FROM m),
a AS (SELECT device, horizon_h, model, alpha, avg(CASE WHEN alert THEN alpha WHEN event THEN 1 ELSE 0 END) AS expense, least(alpha, avg(CAST(event AS DOUBLE))) AS climate, alpha * avg(CAST(event AS DOUBLE)) AS perfect FROM v GROUP BY 1, 2, 3, 4)
SELECT device, horizon_h, model, alpha, round(expense, 6) AS expense, CASE WHEN climate - perfect > 1e-12 THEN round((climate - expense) / (climate - perfect), 6) END AS value FROM a""")
def d18_economic_value(spark, sf_dir):
    """Expense and value of alerts at several costs."""
    rows = stacked(spark, sf_dir).withColumn("alpha", F.explode(F.array(F.lit(0.1), F.lit(0.3), F.lit(0.5))))
    rows = rows.withColumn("event", scoring.below("y", ALERT_BELOW)).withColumn("alert", scoring.below("p", ALERT_BELOW))
    by = rows.groupBy("device", "horizon_h", "model", "alpha").agg(
        scoring.cost_loss_expense(F.col("alert"), F.col("event"), F.col("alpha")).alias("expense"), F.avg(F.col("event").cast("double")).alias("rate")
    )
    climate, perfect = F.least("alpha", "rate"), F.col("rate") * F.col("alpha")
    value = F.when(climate - perfect > 1e-12, (climate - F.col("expense")) / (climate - perfect))
    return by.select("device", "horizon_h", "model", "alpha", r6("expense", "expense"), r6(value, "value"))


@query(f"""{_SCORED}, q AS (SELECT device, horizon_h, CASE WHEN y < 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS e, least(greatest(persistence / 500, 0), 1) AS p FROM s)
SELECT device, horizon_h, round(avg((p - e) ** 2), 6) AS brier, round(-avg(e * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - e) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM q GROUP BY 1, 2""")
def d29_brier_log_loss(spark, sf_dir):
    """Brier score and log loss of a probability."""
    p = F.least(F.greatest(F.col("persistence") / 500, F.lit(0.0)), F.lit(1.0))
    e = scoring.below("y", ALERT_BELOW).cast("double")
    return scored(spark, sf_dir).groupBy("device", "horizon_h").agg(r6(scoring.brier(e, p), "brier"), r6(scoring.log_loss(e, p), "log_loss"))


@query(f"""{_SCORED}, q AS (SELECT horizon_h, CASE WHEN y < 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS e, least(greatest(persistence / 500, 0), 1) AS p FROM s)
SELECT horizon_h, CAST(least(floor(p * 10), 9) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean_p, round(avg(e), 6) AS observed FROM q GROUP BY 1, 2""")
def a16_reliability(spark, sf_dir):
    p = F.least(F.greatest(F.col("persistence") / 500, F.lit(0.0)), F.lit(1.0))
    rows = scored(spark, sf_dir).select("horizon_h", p.alias("p"), scoring.below("y", ALERT_BELOW).cast("double").alias("e"))
    return rows.groupBy("horizon_h", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p"), "mean_p"), r6(F.avg("e"), "observed"))


@query(f"""{_VOL}, cm AS (SELECT device, ts, round(drift, 5) AS m FROM ew WHERE drift IS NOT NULL), q AS (SELECT device, quantile_cont(m, [0.25, 0.5, 0.75]) AS e FROM cm GROUP BY 1),
bk AS (SELECT cm.device, cm.m, CAST(m >= e[1] AS INT) + CASE WHEN e[2] > e[1] THEN CAST(m >= e[2] AS INT) ELSE 0 END + CASE WHEN e[3] > e[2] THEN CAST(m >= e[3] AS INT) ELSE 0 END AS bucket FROM cm JOIN q ON q.device = cm.device)
SELECT device, CAST(bucket AS INT) AS bucket, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(m, 0.5), 5) AS median FROM bk GROUP BY 1, 2""")
def w28_drift_buckets(spark, sf_dir):
    """Drift classes by quantile edges: equal goes up, equal edges count once."""
    c = volatility(spark, sf_dir).where("drift is not null").select("device", F.round("drift", 5).alias("m"))
    e = c.groupBy("device").agg(F.array_distinct(F.percentile("m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).alias("e"))
    b = c.join(e, "device").withColumn("bucket", F.size(F.filter("e", lambda x: F.col("m") >= x)))
    return b.groupBy("device", "bucket").agg(F.count("*").alias("n"), F.round(F.percentile("m", 0.5), 5).alias("median"))


@query(f"""{_VOL}, st AS (SELECT device, ts, round((d - drift) / sqrt(vol), 5) AS z FROM ew WHERE d IS NOT NULL AND vol > 0 AND drift IS NOT NULL) SELECT * FROM st""")
def d20_standardized_pool(spark, sf_dir):
    """Hourly changes, and the same in units of their row's moments."""
    v = volatility(spark, sf_dir).where("delta is not null and vol > 0 and drift is not null")
    return v.select("device", "ts", F.round((F.col("delta") - F.col("drift")) / F.col("sigma"), 5).alias("z"))


@query(f"""{_VOL}, l AS (SELECT device, arg_max(value, ts) AS level, arg_max(sqrt(vol), ts) AS sigma FROM ew WHERE value IS NOT NULL AND vol IS NOT NULL GROUP BY 1)
SELECT device, CASE WHEN sigma > 0 THEN round((level - 25) / (sigma * sqrt(24)), 6) END AS distance FROM l""")
def x08_distance(spark, sf_dir):
    """Distance to the threshold in spreads of the horizon."""
    l = volatility(spark, sf_dir).where("value is not null and vol is not null").groupBy("device").agg(F.max_by("value", "ts").alias("level"), F.max_by("sigma", "ts").alias("sigma"))  # noqa: E741
    return l.select("device", r6(F.when(F.col("sigma") > 0, (F.col("level") - ALERT_BELOW) / (F.col("sigma") * F.sqrt(F.lit(24.0)))), "distance"))


_ECM = f"""WITH {FOLDS}, pv AS (SELECT ts, max(value) FILTER (device = 'click') AS a, avg(value) FILTER (device <> 'click') AS b FROM f GROUP BY 1),
st AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM pv WHERE a IS NOT NULL AND b IS NOT NULL),
sp AS (SELECT ts, (a - ma) / sa - (b - mb) / sb AS s, a FROM pv CROSS JOIN st), ln AS (SELECT *, lag(s) OVER (ORDER BY ts) AS s1, a - lag(a) OVER (ORDER BY ts) AS d FROM sp)"""


@query(f"{_ECM} SELECT round(regr_slope(s, s1), 6) AS ar1, round(regr_slope(d, s1), 5) AS slope, round(regr_intercept(d, s1), 5) AS intercept FROM ln")
def m11_error_correction(spark, sf_dir):
    """Spread of one device against the mean of the others, its persistence, and how it pulls the level back."""
    g = hourly(spark, sf_dir)
    pair = g.groupBy("ts").agg(F.max(F.when(F.col("device") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("device") != "click", F.col("value"))).alias("b"))
    full = pair.where("a is not null and b is not null").agg(*[f(c).alias(f"{n}{c}") for c in "ab" for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
    s = pair.crossJoin(full).withColumn("s", (F.col("a") - F.col("ma")) / F.col("sa") - (F.col("b") - F.col("mb")) / F.col("sb"))
    w = Window.orderBy("ts")  # one row an hour for the whole fleet
    x = s.withColumn("s1", F.lag("s").over(w)).withColumn("d", F.col("a") - F.lag("a").over(w))
    ok = x.where("d is not null and s1 is not null")
    return x.agg(r6(F.regr_slope("s", "s1"), "ar1")).crossJoin(ok.agg(F.round(F.regr_slope("d", "s1"), 5).alias("slope"), F.round(F.regr_intercept("d", "s1"), 5).alias("intercept")))

"""Experiments with kernels and fitted models: a grouped pandas function for each device, lead and fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, models
from ..operators import baselines, events, features, folds, grid, scoring, survival
from .decisions import _VOL, DROP, HOURS, labelled, volatility
from .registry import FOLDS as FOLD_SQL
from .registry import GRID, phi, query
from .sensor import ALERT_BELOW, HORIZONS, folded, hourly, r6, with_vintages

FEATURES = ("last", "lag_1", "lag_24", "mean_6", "mean_24", "precip", "et0", "hour_sin", "hour_cos", "t")
FOLDS = 5


def feature_rows(spark: SparkSession, sf_dir: str, horizons: tuple[int, ...] = (6, 24)) -> DataFrame:
    """(device, horizon_h, ts, i, n, fold, y, *FEATURES): what was known horizon_h hours before each row, and the
    forecast water in and out up to it. All horizons share one window specification."""
    g = folds.with_folds(with_vintages(spark, sf_dir))
    w = grid.over()
    angle = 2 * F.pi() * F.hour("ts") / 24

    def at(h: int) -> Column:
        lag = (h + 23) // 24
        return F.struct(
            F.lit(h).alias("horizon_h"), F.lag("value", h).over(w).alias("last"), F.lag("value", h + 1).over(w).alias("lag_1"), F.lag("value", h + 24).over(w).alias("lag_24"),
            F.avg("value").over(w.rowsBetween(-h - 5, -h)).alias("mean_6"), F.avg("value").over(w.rowsBetween(-h - 23, -h)).alias("mean_24"),
            F.sum(f"precip_mm_prev{lag}").over(w.rowsBetween(1 - h, 0)).alias("precip"), F.sum(f"et0_mm_prev{lag}").over(w.rowsBetween(1 - h, 0)).alias("et0"),
            F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"), F.col("i").cast("double").alias("t"),
        )

    wide = g.select("device", "ts", "i", "n", "fold", F.col("value").alias("y"), *[at(h).alias(f"_{h}") for h in horizons])
    return wide.select("device", "ts", "i", "n", "fold", "y", F.inline(F.array(*[f"_{h}" for h in horizons])))


def walk_forward(rows: DataFrame, make: dict[str, object], pooled: bool = False) -> DataFrame:
    """(device, horizon_h, fold, ts, y, last, *models): every model fitted on each fold's purged past and applied to the
    fold. ``make`` maps a name to a function of the lead that gives a FitPredict. One task fits one (device, lead, fold),
    or with ``pooled`` one (lead, fold) over all devices; a training set is hours, not readings."""
    names = list(make)
    fold = F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))
    wide = rows.withColumn("for_fold", fold)
    start = folds.fold_start(F.col("for_fold"), F.col("n"), FOLDS)
    used = wide.withColumn("test", F.col("fold") == F.col("for_fold")).where(F.col("test") | (F.col("i") < start - (F.col("horizon_h") - 1)))
    keys = ["horizon_h", "for_fold"] if pooled else ["device", "horizon_h", "for_fold"]
    schema = "device string, horizon_h int, fold int, ts timestamp_ntz, y double, last double, " + ", ".join(f"{m} double" for m in names)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["device", "i"])
        x, y = pdf[list(FEATURES)].astype(float), pdf["y"].to_numpy(float)
        test = pdf["test"].to_numpy(bool)
        out = pdf.loc[test, ["device", "horizon_h", "for_fold", "ts", "y", "last"]].rename(columns={"for_fold": "fold"})
        for m in names:
            out[m] = make[m](int(pdf["horizon_h"].iloc[0]))(x[~test], y[~test], x[test]) if test.any() else []
        return out

    return used.groupBy(*keys).applyInPandas(fit, schema)


CHALLENGERS = {
    "water_balance": lambda h: models.water_balance(h),
    "ridge": lambda h: models.ridge(),
    "forest": lambda h: models.forest(20),
    "gbt": lambda h: models.gbt(rounds=40),
    "harmonic": lambda h: models.harmonic(),
    "autoregression": lambda h: models.autoregression(["last", "lag_1", "lag_24"]),
    "robust_water_balance": lambda h: models.water_balance(h, robust=True, gate_mm=0.5),
}


def _skills(pred: DataFrame, names: list[str]) -> DataFrame:
    ok = F.col("y").isNotNull() & F.col("last").isNotNull()
    for m in names:
        ok = ok & F.col(m).isNotNull() & ~F.isnan(m)
    long = pred.where(ok).withColumnRenamed("last", "persistence").unpivot(["device", "horizon_h", "fold", "y"], ["persistence", *names], "model", "p")
    by = long.groupBy("device", "horizon_h", "model").agg(F.count("*").alias("n"), scoring.mae().alias("mae"), scoring.rmse().alias("rmse"))
    base = F.max(F.when(F.col("model") == "persistence", F.col("mae"))).over(Window.partitionBy("device", "horizon_h"))
    return by.select("device", "horizon_h", "model", "n", r6("mae", "mae"), r6("rmse", "rmse"), r6(scoring.skill(F.col("mae"), base), "skill"))


@query()
def e04_challengers(spark, sf_dir):
    """Seven challengers and persistence on identical rows (E04, M01-M05, M16; M06 and M08 by approximate stand-ins)."""
    return _skills(walk_forward(feature_rows(spark, sf_dir), CHALLENGERS), list(CHALLENGERS))


@query()
def m10_pooled_models(spark, sf_dir):
    """One model for all devices at each lead and fold."""
    make = {k: CHALLENGERS[k] for k in ("ridge", "gbt")}
    return _skills(walk_forward(feature_rows(spark, sf_dir), make, pooled=True), list(make))


_ERRORS = f"""WITH {GRID}, er AS ({" UNION ALL ".join(f"SELECT device, ts, {h} AS horizon_h, value, lag(value, {h}) OVER (PARTITION BY device ORDER BY ts) AS mu FROM g" for h in HORIZONS)}),
ek AS (SELECT *, abs(value - mu) AS e, count(abs(value - mu)) OVER (PARTITION BY device, horizon_h ORDER BY ts) AS k FROM er),
ee AS (SELECT *, CASE WHEN k >= 24 THEN sum(e * pow(2, k / 72.0::DOUBLE)) OVER w / sum(CASE WHEN e IS NOT NULL THEN pow(2, k / 72.0::DOUBLE) END) OVER w END AS err FROM ek WINDOW w AS (PARTITION BY device, horizon_h ORDER BY ts)),
es AS (SELECT a.device, a.ts, a.horizon_h, a.value AS y, a.mu, greatest(b.err * sqrt(pi() / 2), 1e-6) AS sigma FROM ee a JOIN ee b ON b.device = a.device AND b.horizon_h = a.horizon_h AND b.ts = a.ts - a.horizon_h * INTERVAL 1 HOUR WHERE a.value IS NOT NULL AND a.mu IS NOT NULL AND b.err IS NOT NULL),
ez AS (SELECT *, (y - mu) / sigma AS z FROM es), ec AS (SELECT *, sigma * (z * (2 * {phi("z")} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) AS crps FROM ez)"""


def gaussian_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, ts, horizon_h, y, mu, sigma): persistence with a weighted spread, as known at forecasting time. All leads
    go through one exchange."""
    g = hourly(spark, sf_dir)
    leads = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon_h"), F.col(f"_{h}").alias("mu")) for h in HORIZONS]))
    long = g.select("device", "ts", F.col("value").alias("y"), *[baselines.persistence(h).alias(f"_{h}") for h in HORIZONS]).select("device", "ts", "y", leads)
    s = features.ewma_frame(long.withColumn("e", F.abs(F.col("y") - F.col("mu"))), "e", "err", 72.0, key=["device", "horizon_h"])
    w = Window.partitionBy("device", "horizon_h").orderBy("ts")
    known = F.coalesce(*[F.when(F.col("horizon_h") == h, F.lag("err", h).over(w)) for h in HORIZONS])
    s = s.withColumn("known", known).where("y is not null and mu is not null and known is not null")
    return s.select("device", "ts", "horizon_h", "y", "mu", F.greatest(F.col("known") * F.sqrt(F.pi() / 2), F.lit(1e-6)).alias("sigma"))


@query(f"{_ERRORS} SELECT device, ts, horizon_h, round(crps, 5) AS crps FROM ec")
def d01_gaussian_crps(spark, sf_dir):
    """Closed form at every hour and lead."""
    f = gaussian_forecasts(spark, sf_dir)
    return f.select("device", "ts", "horizon_h", F.round(kernels.gaussian_crps_udf("y", "mu", "sigma"), 5).alias("crps"))


@query(f"{_ERRORS} SELECT device, horizon_h, CAST(count(*) AS BIGINT) AS n, round(avg(crps), 6) AS crps, round(avg(abs(y - mu)), 6) AS mae FROM ec GROUP BY 1, 2")
def d08_probabilistic(spark, sf_dir):
    """CRPS of Gaussian forecasts with weighted spread, by device and lead, against the fold-free absolute error."""
    scored = gaussian_forecasts(spark, sf_dir).withColumn("crps", kernels.gaussian_crps_udf("y", "mu", "sigma"))
    return scored.groupBy("device", "horizon_h").agg(F.count("*").alias("n"), r6(F.avg("crps"), "crps"), r6(F.avg(F.abs(F.col("y") - F.col("mu"))), "mae"))


@query(f"""WITH {FOLD_SQL}, o AS (SELECT device, value AS x, row_number() OVER (PARTITION BY device ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY device) AS n FROM f WHERE fold < 0 AND value IS NOT NULL),
cs AS (SELECT device, x FROM o WHERE n <= 300 OR k IN (SELECT CAST(round_even(j * (o.n - 1) / 299.0::DOUBLE, 0) AS BIGINT) FROM range(300) r(j))), sp AS (SELECT a.device, avg(abs(a.x - b.x)) AS pairs FROM cs a JOIN cs b ON b.device = a.device GROUP BY 1),
dd AS (SELECT f.device, f.ts, avg(abs(f.value - cs.x)) AS dist FROM f JOIN cs ON cs.device = f.device WHERE f.fold >= 0 AND f.value IS NOT NULL GROUP BY 1, 2) SELECT dd.device, CAST(count(*) AS BIGINT) AS n, round(avg(dist) - max(pairs) / 2, 6) AS crps FROM dd JOIN sp ON sp.device = dd.device GROUP BY 1""")
def d02_empirical_crps(spark, sf_dir):
    """CRPS of the first half's climatology as an ensemble of at most 300."""
    g = folded(spark, sf_dir).where("value is not null").select("device", "fold", "value")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        past = np.sort(pdf.loc[pdf.fold < 0, "value"].to_numpy())
        if len(past) > 300:
            past = past[np.round(np.linspace(0, len(past) - 1, 300)).astype(int)]
        y = pdf.loc[pdf.fold >= 0, "value"].to_numpy()
        return pd.DataFrame({"device": [pdf.device.iloc[0]], "n": [len(y)], "crps": [float(np.round(np.mean(kernels.empirical_crps(past, y)), 6)) if len(y) else None]})

    return g.groupBy("device").applyInPandas(score, "device string, n long, crps double")


def _passage_sql(h: int) -> str:
    ahead = f"OVER (PARTITION BY device ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"SELECT device, ts, {h} AS horizon_h, value - 25 AS b, drift AS mu, sqrt(vol) AS s, value IS NOT NULL AND count(value) {ahead} = {h} AS valid, coalesce(min(value) {ahead} < 25, false) AS crossed FROM ew"


_PASSAGE = f"""{_VOL}, pa AS ({_passage_sql(6)} UNION ALL {_passage_sql(24)}), pz AS (SELECT *, (-b - mu * horizon_h) / (s * sqrt(horizon_h)) AS z1, (-b + mu * horizon_h) / (s * sqrt(horizon_h)) AS z2 FROM pa WHERE valid AND s > 0 AND mu IS NOT NULL),
pp AS (SELECT device, ts, horizon_h, CASE WHEN crossed THEN 1.0 ELSE 0.0 END::DOUBLE AS e, CASE WHEN b <= 0 THEN 1.0 ELSE least(1, greatest(0, {phi("z1")} + least(1, exp(-2 * mu * b / (s * s)) * {phi("z2")}))) END AS p FROM pz)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, ts, horizon_h, e, p): whether the level was crossed within each lead, and the chance of it beforehand."""
    v = volatility(spark, sf_dir)
    for h in (6, 24):
        v = events.crossing_labels(v, h, ALERT_BELOW).withColumnsRenamed({"valid": f"valid_{h}", "crossed": f"crossed_{h}"})
        v = v.withColumn(f"p_{h}", kernels.crossing_udf(ALERT_BELOW, h)("value", "drift", "sigma"))
    leads = F.array(*[F.struct(F.lit(h).alias("horizon_h"), F.col(f"valid_{h}").alias("valid"), F.col(f"crossed_{h}").cast("double").alias("e"), F.col(f"p_{h}").alias("p")) for h in (6, 24)])
    return v.where("sigma > 0 and drift is not null").select("device", "ts", F.inline(leads)).where("valid").select("device", "ts", "horizon_h", "e", "p")


@query(f"{_PASSAGE} SELECT device, ts, horizon_h, round(p, 5) AS p FROM pp")
def d03_crossing_probability(spark, sf_dir):
    """Chance to pass below the threshold, by the reflection principle, at every hour and lead."""
    return passages(spark, sf_dir).select("device", "ts", "horizon_h", F.round("p", 5).alias("p"))


@query(f"""{_PASSAGE} SELECT device, horizon_h, round(arg_max(p, ts), 5) AS p FROM pp GROUP BY 1, 2""")
def d04_first_passage(spark, sf_dir):
    """The chance as estimated at the last hour that can be judged."""
    return passages(spark, sf_dir).groupBy("device", "horizon_h").agg(F.round(F.max_by("p", "ts"), 5).alias("p"))


@query(f"""{_PASSAGE} SELECT device, horizon_h, CAST(count(*) AS BIGINT) AS n, round(avg((p - e) ** 2), 5) AS brier, round(-avg(e * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - e) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))), 4) AS log_loss FROM pp GROUP BY 1, 2""")
def e16_first_passage(spark, sf_dir):
    """Brier scores of barrier-crossing chances against crossings."""
    return passages(spark, sf_dir).groupBy("device", "horizon_h").agg(F.count("*").alias("n"), F.round(scoring.brier(F.col("e"), F.col("p")), 5).alias("brier"), F.round(scoring.log_loss(F.col("e"), F.col("p")), 4).alias("log_loss"))


POINTS = 64


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, pool, level, mu, sigma): POINTS quantile points of the increments of devices with 48 or more, latest level
    and moments. Quantiles are aggregated; a device's series is never gathered in a row."""
    v = volatility(spark, sf_dir)
    probs = F.array(*[F.lit((k + 0.5) / POINTS) for k in range(POINTS)])
    found = v.groupBy("device").agg(
        F.percentile("delta", probs).alias("pool"), F.count("delta").alias("n"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("level"),
        F.max_by("drift", F.when(F.col("drift").isNotNull(), F.col("ts"))).alias("mu"), F.max_by("sigma", F.when(F.col("sigma").isNotNull(), F.col("ts"))).alias("sigma"),
    )
    return found.where("n >= 48").drop("n")


@query()
def e18_exercise_boundary(spark, sf_dir):
    """Levels at which to act, by hour, cost and delay."""

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            inc = np.asarray(r.pool, float)
            for cost in (0.1, 0.3):
                for delay in (0, 6):
                    if len(inc):
                        b = kernels.exercise_boundary(inc, ALERT_BELOW, 12, cost, ALERT_BELOW + 8 * max(float(np.std(inc)), 1e-6), delay)
                        rows += [(r.device, cost, delay, t, float(np.round(x, 6))) for t, x in enumerate(b)]
        return pd.DataFrame(rows, columns=["device", "cost", "delay_h", "hour", "level"])

    return _pool(spark, sf_dir).groupBy("device").applyInPandas(bounds, "device string, cost double, delay_h int, hour int, level double")


@query()
def e17_crossing_curves(spark, sf_dir):
    """Chance of crossing from the latest level under pooled, filtered and Gaussian increments."""

    def chances(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            pool = np.asarray(r.pool, float)
            shaped = kernels.brought_to(pool, r.mu, r.sigma)  # standardizing the pool first would change nothing
            shapes = {"pooled": pool, "filtered": shaped, "gaussian": kernels.gaussian_increments(r.mu, r.sigma, POINTS)}
            for name, inc in shapes.items():
                for h in (6, 24):
                    p = float(kernels.empirical_crossing([r.level], ALERT_BELOW, h, inc)[0]) if len(inc) else None
                    rows.append((r.device, name, h, None if p is None else round(p, 6)))
        return pd.DataFrame(rows, columns=["device", "increments", "horizon_h", "p"])

    ready = _pool(spark, sf_dir).where("mu is not null and sigma is not null and level is not null")
    return ready.groupBy("device").applyInPandas(chances, "device string, increments string, horizon_h int, p double")


SURVIVAL_MODELS = ("km-train", "drydown-clock", "gauss-continuous", "gauss-discrete", "fhs-discrete", "hazard-glm", "fhs-hazard-blend")


@query()
def e20_hazard_survival(spark, sf_dir):
    """Integrated Brier scores of seven survival models by fold, against the test rows' own censoring."""
    keep = ["device", "ts", "i", "n", "fold", "delta", "drift", "sigma"]
    rows = folds.with_folds(volatility(spark, sf_dir)).select(*keep)
    rows = rows.join(labelled(spark, sf_dir).select("device", "ts", "time", "event"), ["device", "ts"], "left")

    def study(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        hour, sigma, mu = pd.to_datetime(pdf.ts).dt.hour.to_numpy(), pdf.sigma.to_numpy(float), pdf.drift.to_numpy(float)
        labelled_row = pdf.time.notna().to_numpy()
        usable = labelled_row & np.isfinite(sigma) & (sigma > 0) & np.isfinite(mu)
        time, event = pdf.time.fillna(0).to_numpy(int), pdf.event.fillna(False).to_numpy(bool)
        z = (pdf.delta.to_numpy(float) - mu) / np.where(sigma > 0, sigma, np.nan)
        out = []
        for k in range(FOLDS):
            test = np.flatnonzero((pdf.fold.to_numpy() == k) & usable)
            first = int(np.flatnonzero(pdf.fold.to_numpy() == k)[0]) if (pdf.fold == k).any() else 0
            past = np.arange(len(pdf)) < first - (HOURS - 1)
            if not len(test):
                continue
            depth, lean = DROP / sigma[test], mu[test] / sigma[test]
            curves = {"km-train": np.tile(kernels.product_limit(time[past & labelled_row], event[past & labelled_row], HOURS), (len(test), 1))}
            steps = np.arange(1, HOURS + 1)
            with np.errstate(divide="ignore"):
                curves["drydown-clock"] = (steps[None, :] < np.where(mu[test] < 0, DROP / -mu[test], np.inf)[:, None]).astype(float)
            curves["gauss-continuous"] = np.column_stack([1 - kernels.crossing_probability(np.full(len(test), DROP), 0.0, h, mu[test], sigma[test]) for h in steps])
            bucket, centres = kernels.drift_buckets(lean, 3)
            shape = kernels.discretized(z[past], POINTS)
            for name, law in (("gauss-discrete", lambda m: kernels.gaussian_increments(m, 1.0, POINTS)), ("fhs-discrete", lambda m: kernels.brought_to(shape, m, 1.0))):
                s = np.full((len(test), HOURS), np.nan)
                for b, m in enumerate(centres):
                    inc, mine = law(m), bucket == b
                    if len(inc) and mine.any():
                        levels, p = kernels.crossing_curve(inc, 0.0, HOURS, each=True)
                        s[mine] = np.column_stack([1 - np.interp(depth[mine], levels, row, right=0.0) for row in p])
                curves[name] = s
            train = past & usable
            at, period, died = kernels.person_periods(time[train], event[train], HOURS)
            t_hour, t_lean, t_depth = hour[train], mu[train] / sigma[train], DROP / sigma[train]
            hazard = models.logistic_hazard(models.hazard_design(period, (t_hour[at] + period) % 24, t_lean[at], t_depth[at]), died) if len(at) else None
            curves["hazard-glm"] = models.hazard_survival(hazard, hour[test], lean, depth, HOURS) if hazard else np.full((len(test), HOURS), np.nan)
            curves["fhs-hazard-blend"] = 0.5 * (curves["fhs-discrete"] + curves["hazard-glm"])
            g = kernels.censoring_curve(time[test], event[test], HOURS)
            for name in SURVIVAL_MODELS:
                if np.isfinite(curves[name]).all():
                    b = kernels.censored_brier(time[test], event[test], curves[name], g)
                    out.append((pdf.device[0], k, name, len(test), int(event[test].sum()), round(float(b.mean()), 6), round(float(b[-1]), 6)))
        return pd.DataFrame(out, columns=["device", "fold", "model", "n", "n_event", "integrated_brier", "brier_24"])

    return rows.groupBy("device").applyInPandas(study, "device string, fold int, model string, n long, n_event long, integrated_brier double, brier_24 double")


@query()
def v08_survival_grid(spark, sf_dir):
    """Survival over levels and hours by the crossing recursion."""

    def curves(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            inc = np.asarray(r.pool, float)
            if len(inc):
                levels, p = kernels.crossing_curve(inc, 0.0, HOURS, each=True)
                rows += [(r.device, h + 1, float(round(1 - np.interp(DROP, levels, p[h], right=0.0), 6))) for h in range(HOURS)]
        return pd.DataFrame(rows, columns=["device", "h", "s"])

    return _pool(spark, sf_dir).groupBy("device").applyInPandas(curves, "device string, h int, s double")


@query(f"{_VOL}, zz AS (SELECT device, ts, drift / sqrt(vol) AS z FROM ew WHERE vol > 0 AND drift IS NOT NULL) SELECT device, ts, round({phi('z')}, 6) AS p_rise FROM zz")
def x09_normal_cdf(spark, sf_dir):
    """Chance that the next change is a rise, were changes normal."""
    v = volatility(spark, sf_dir).where("sigma > 0 and drift is not null")
    return v.select("device", "ts", F.round(kernels.ndtr_udf(F.col("drift") / F.col("sigma")), 6).alias("p_rise"))


@query(f"{_VOL}, zz AS (SELECT device, ts, -2 + drift / sqrt(vol) AS z FROM ew WHERE vol > 0 AND drift IS NOT NULL) SELECT device, ts, round(ln({phi('z')}), 5) AS log_p FROM zz")
def x10_log_cdf(spark, sf_dir):
    """Logarithm of a small chance."""
    v = volatility(spark, sf_dir).where("sigma > 0 and drift is not null")
    return v.select("device", "ts", F.round(kernels.log_ndtr_udf(F.col("drift") / F.col("sigma") - 2), 5).alias("log_p"))


@query("SELECT CAST(k AS INT) AS k, round((k + 0.5) / 64, 6) AS p FROM (SELECT unnest(range(64)) AS k)")
def x11_quantiles(spark, sf_dir):
    """Normal quantiles, shown by the chances that they give back (X11, D23). All of these lie halfway between two numbers of
    six digits, so what the two kernels are off by, in the 16th, is rounded away first."""
    z = spark.createDataFrame([(k, kernels.ndtri((k + 0.5) / 64)) for k in range(64)], "k int, z double")
    return z.select("k", F.round(F.round(kernels.ndtr_udf("z"), 12), 6).alias("p"))


_D = "WITH {grid}, z AS (SELECT device, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS z FROM g), q AS (SELECT device, unnest(quantile_cont(z, [" + ", ".join(f"{(k + 0.5) / 64}" for k in range(64)) + "])) AS z FROM z WHERE z IS NOT NULL GROUP BY 1 HAVING count(*) >= 48)"


@query(_D.format(grid=GRID) + ", s AS (SELECT device, stddev_pop(z) AS s FROM q GROUP BY 1) SELECT device, CAST(least(6000, greatest(200, ceil(400 / greatest(0.1 * s, 1e-9)) + 1)) AS BIGINT) AS nodes FROM s")
def d26_level_grid(spark, sf_dir):
    """Nodes of the level grid over a span of 400."""
    nodes = lambda pdf: pd.DataFrame([(r.device, len(kernels.level_grid(0.0, 400.0, r.pool))) for r in pdf.itertuples()], columns=["device", "nodes"])
    return _pool(spark, sf_dir).groupBy("device").applyInPandas(nodes, "device string, nodes long")


@query(_D.format(grid=GRID) + "SELECT device, CAST(25 + 10 * j AS DOUBLE) AS level, round(avg(CASE WHEN 25 + 10 * j + z < 25 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS value FROM q, (SELECT unnest(range(20)) AS j) GROUP BY 1, 2")
def d27_continuation(spark, sf_dir):
    """What waiting one hour costs where nothing is lost after it."""

    def wait(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = ALERT_BELOW + 10.0 * np.arange(20)
        rows = [(r.device, x, round(float(v), 6)) for r in pdf.itertuples() for x, v in zip(levels.tolist(), kernels.mean_after(levels, np.zeros(20), r.pool, ALERT_BELOW, 1.0))]
        return pd.DataFrame(rows, columns=["device", "level", "value"])

    return _pool(spark, sf_dir).groupBy("device").applyInPandas(wait, "device string, level double, value double")


def _curve(spark, sf_dir, make, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    run = lambda pdf: pd.DataFrame([row for r in pdf.itertuples() for row in make(r)], columns=names)
    return _pool(spark, sf_dir).where("level is not null").groupBy("device").applyInPandas(run, schema)


@query()
def d15_exercise_boundary(spark, sf_dir):
    """Levels at which to act at a cost of 0.1, by hour."""
    make = lambda r: [(r.device, t, round(float(x), 6)) for t, x in enumerate(kernels.exercise_boundary(r.pool, ALERT_BELOW, 12, 0.1, ALERT_BELOW + 8 * float(np.std(r.pool))))]
    return _curve(spark, sf_dir, make, "device string, hour int, level double")


@query()
def d16_delayed_boundary(spark, sf_dir):
    """The same where acting takes six hours to take effect."""
    make = lambda r: [(r.device, t, round(float(x), 6)) for t, x in enumerate(kernels.exercise_boundary(r.pool, ALERT_BELOW, 12, 0.1, ALERT_BELOW + 8 * float(np.std(r.pool)), 6))]
    return _curve(spark, sf_dir, make, "device string, hour int, level double")


@query()
def d24_crossing_curve(spark, sf_dir):
    """Chances to cross within twelve hours along the level grid's first 20 nodes."""

    def make(r):
        levels, p = kernels.crossing_curve(r.pool, ALERT_BELOW, 12)
        return [(r.device, j, round(float(levels[j]), 6), round(float(p[j]), 6)) for j in range(20)]

    return _curve(spark, sf_dir, make, "device string, node int, level double, p double")


@query()
def d25_crossing_lookup(spark, sf_dir):
    """The curve read off at the latest level."""
    make = lambda r: [(r.device, h, round(float(kernels.empirical_crossing([r.level], ALERT_BELOW, h, r.pool)[0]), 6)) for h in (6, 12)]
    return _curve(spark, sf_dir, make, "device string, horizon_h int, p double")


@query()
def d31_unit_shape(spark, sf_dir):
    """A pool's quantile points at mean 0 and deviation 1."""
    make = lambda r: [(r.device, k, round(float(x), 6)) for k, x in enumerate(kernels.brought_to(r.pool, 0.0, 1.0))]
    return _curve(spark, sf_dir, make, "device string, k int, z double")


_FITTED = f"""WITH {FOLD_SQL}, lg AS (SELECT device, ts, i, n, fold, value AS y, lag(value, 6) OVER w AS a, lag(value, 30) OVER w AS b FROM f WINDOW w AS (PARTITION BY device ORDER BY ts)), ks AS (SELECT unnest(range(5)) AS k),
tr AS (SELECT ks.k, lg.* FROM lg CROSS JOIN ks WHERE i < n // 2 + CAST(round_even(k * (n - n // 2) / 5.0, 0) AS BIGINT) - 5)"""


def _mean(x: pd.DataFrame, y: np.ndarray, test: pd.DataFrame) -> np.ndarray:
    seen = y[np.isfinite(y)]
    return np.full(len(test), seen.mean() if len(seen) else np.nan)


def anchored(x: pd.DataFrame, y: np.ndarray, test: pd.DataFrame) -> np.ndarray:
    """The last level plus the mean change over the lead in training."""
    change = y - x["last"].to_numpy(float)
    change = change[np.isfinite(change)]
    return test["last"].to_numpy(float) + (change.mean() if len(change) else np.nan)


def _scored(pred: DataFrame, model: str, *keys: str) -> DataFrame:
    ok = pred.where(F.col("y").isNotNull() & F.col(model).isNotNull() & ~F.isnan(model))
    return ok.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col(model))), 5).alias("mae"))


@query(f"{_FITTED}, mo AS (SELECT device, k, avg(y) AS m FROM tr GROUP BY 1, 2) SELECT lg.device, CAST(fold AS INT) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - m)), 5) AS mae FROM lg JOIN mo ON mo.device = lg.device AND mo.k = lg.fold WHERE y IS NOT NULL GROUP BY 1, 2")
def m01_walk_forward(spark, sf_dir):
    """The driver itself, with the plainest model: the mean of each fold's purged past."""
    return _scored(walk_forward(feature_rows(spark, sf_dir, (6,)), {"mean": lambda h: _mean}), "mean", "device", "fold")


@query(f"{_FITTED}, mo AS (SELECT k, avg(y) AS m FROM tr GROUP BY 1) SELECT CAST(fold AS INT) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - m)), 5) AS mae FROM lg JOIN mo ON mo.k = lg.fold WHERE y IS NOT NULL GROUP BY 1")
def m09_pooled_estimator(spark, sf_dir):
    """The same, fitted on all devices at once."""
    return _scored(walk_forward(feature_rows(spark, sf_dir, (6,)), {"mean": lambda h: _mean}, pooled=True), "mean", "fold")


@query(f"{_FITTED}, mo AS (SELECT device, k, avg(y - a) AS m FROM tr GROUP BY 1, 2) SELECT lg.device, CAST(fold AS INT) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - a - m)), 5) AS mae FROM lg JOIN mo ON mo.device = lg.device AND mo.k = lg.fold WHERE y IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2")
def m16_anchored(spark, sf_dir):
    """Forecasts anchored on persistence."""
    return _scored(walk_forward(feature_rows(spark, sf_dir, (6,)), {"anchored": lambda h: anchored}), "anchored", "device", "fold")


@query(f"""{_FITTED}, mo AS (SELECT device, k, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb FROM tr WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20),
wt AS (SELECT *, ((n + 1) * n * ca / sa - n * r * n * cb / sb) / ((n + 1) ** 2 - (n * r) ** 2) AS wa, ((n + 1) * n * cb / sb - n * r * n * ca / sa) / ((n + 1) ** 2 - (n * r) ** 2) AS wb FROM mo)
SELECT lg.device, CAST(fold AS INT) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - (my + wa * (a - ma) / sa + wb * (b - mb) / sb))), 5) AS mae FROM lg JOIN wt ON wt.device = lg.device AND wt.k = lg.fold WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2""")
def m02_ridge(spark, sf_dir):
    """Ridge on two lags, standardized, penalty 1."""
    fit = lambda h: lambda x, y, test: models.ridge(1.0)(x[["last", "lag_24"]], y, test[["last", "lag_24"]])
    return _scored(walk_forward(feature_rows(spark, sf_dir, (6,)), {"ridge": fit}), "ridge", "device", "fold")


def _one(name: str, model: str, doc: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _skills(walk_forward(feature_rows(spark, sf_dir, (6,)), {model: CHALLENGERS[model]}), [model])

    run.__name__, run.__doc__ = name, doc
    return query()(run)


m03_forest = _one("m03_forest", "forest", "Averaged trees on complete rows (M03).")
m04_gbt = _one("m04_gbt", "gbt", "Boosted trees, missing values in a bin of their own (M04).")
m05_water_balance = _one("m05_water_balance", "water_balance", "Persistence corrected for water in and out (M05).")
m06_harmonic = _one("m06_harmonic", "harmonic", "Trend and harmonics: an approximate stand-in for additive seasonal models (M06).")
m08_autoregression = _one("m08_autoregression", "autoregression", "Direct autoregression: an approximate stand-in for ARIMA (M08).")


@query(f"SELECT CAST(k AS INT) AS k, round((k + 0.5) / 16, 6) AS p FROM (SELECT unnest(range(16)) AS k)")
def d23_gaussian_increments(spark, sf_dir):
    """Sixteen increments of a normal law of mean 2 and deviation 3, shown by the chances below them."""
    z = spark.createDataFrame(list(enumerate(kernels.gaussian_increments(2.0, 3.0, 16).tolist())), "k int, z double")
    return z.select("k", F.round(kernels.ndtr_udf((F.col("z") - 2) / 3), 6).alias("p"))


@query()
def d28_boundary_level(spark, sf_dir):
    """Where acting at each of three costs beats waiting one hour, between nodes of the grid."""
    make = lambda r: [(r.device, c, round(float(kernels.exercise_boundary(r.pool, ALERT_BELOW, 1, c, ALERT_BELOW + 8 * float(np.std(r.pool)))[0]), 6)) for c in (0.05, 0.1, 0.3)]
    return _curve(spark, sf_dir, make, "device string, cost double, level double")


@query()
def e21_bucketed_survival(spark, sf_dir):
    """Survival by drift class: each class's law, read off at a depth of five deviations."""
    lean = volatility(spark, sf_dir).where("sigma > 0 and drift is not null").select("device", (F.col("drift") / F.col("sigma")).alias("m"))

    def curves(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for b, m in enumerate(kernels.drift_buckets(pdf.m, 3)[1]):
            levels, p = kernels.crossing_curve(kernels.gaussian_increments(m, 1.0, POINTS), 0.0, HOURS, each=True)
            rows += [(pdf.device.iloc[0], b, h + 1, round(float(1 - np.interp(5.0, levels, p[h], right=0.0)), 6)) for h in range(HOURS)]
        return pd.DataFrame(rows, columns=["device", "bucket", "h", "s"])

    return lean.groupBy("device").applyInPandas(curves, "device string, bucket int, h int, s double")


@query()
def m14_logistic_hazard(spark, sf_dir):
    """The fitted hourly hazard at noon, by period, for the median drift and depth."""
    lab = labelled(spark, sf_dir).join(volatility(spark, sf_dir).select("device", "ts", "drift", "sigma"), ["device", "ts"]).where("drift is not null and sigma > 0")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        row, period, died = kernels.person_periods(pdf.time.to_numpy(int), pdf.event.to_numpy(bool), HOURS)
        lean, depth, hour = (pdf.drift / pdf.sigma).to_numpy(), (DROP / pdf.sigma).to_numpy(), pd.to_datetime(pdf.ts).dt.hour.to_numpy()
        hazard = models.logistic_hazard(models.hazard_design(period, (hour[row] + period) % 24, lean[row], depth[row]), died)
        steps = np.arange(1, HOURS + 1)
        at = models.hazard_design(steps, np.full(HOURS, 12), np.full(HOURS, np.median(lean)), np.full(HOURS, np.median(depth)))
        values = hazard(at) if hazard else [None] * HOURS
        return pd.DataFrame({"device": pdf.device.iloc[0], "period": steps, "hazard": [None if v is None else round(float(v), 6) for v in values]})

    return lab.groupBy("device").applyInPandas(fit, "device string, period int, hazard double")

"""The jobs that write reports: an experiment's table as CSV and its metrics as a long table, both in the shared folder.
A query here returns what its job has written, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import baselines, scoring
from ..sources import archives, parsing
from ..sources.scratch import scratch
from . import decisions, experiments, plots, scores, sensor, serving, small  # noqa: F401  registers what is run
from .experiments import _PASSAGE, passages
from .plots import _PM, _RANKED, _SEASON, BANDS, ranked, season_rows
from .registry import ORACLE_SQL, QUERIES, query
from .sensor import _DRIFT, _SCORED, folded, r6, stacked


def saved(table: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes ``table`` as CSV and its numbers as metrics, and returns the CSV."""
    spark = table.sparkSession
    folder = folder or scratch(spark, name)
    parsing.write_csv(table, f"{folder}/{name}")
    numbers = [c for c, t in table.dtypes if t in ("double", "float")]
    back = spark.read.schema(table.schema).csv(f"{folder}/{name}", header=True)
    if numbers:
        archives.log_metrics(back, f"{folder}/metrics", name, [c for c in table.columns if c not in numbers and not dict(table.dtypes)[c].startswith(("array", "struct"))])
    return back


def _runner(name: str, experiment: str, doc: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return saved(QUERIES[experiment](spark, sf_dir), name)

    run.__name__, run.__doc__ = name, doc
    return query(ORACLE_SQL.get(experiment))(run)


r01_ceiling_run = _runner("r01_ceiling_run", "d14_ceiling", "Ceilings of all probes (R01).")
r03_ecm_run = _runner("r03_ecm_run", "m12_ecm_walk_forward", "Error correction by fold (R03).")
r04_event_study_run = _runner("r04_event_study_run", "e11_event_study", "Errors in and out of events (R04).")
r08_pooled_run = _runner("r08_pooled_run", "e06_fleet_rollup", "Devices and the fleet (R08).")
r09_probabilistic_run = _runner("r09_probabilistic_run", "d08_probabilistic", "Probabilistic scores (R09).")
r10_stopping_run = _runner("r10_stopping_run", "d18_economic_value", "Value of alerts by cost (R10).")
r12_water_balance_run = _runner("r12_water_balance_run", "m05_water_balance", "The water balance against persistence (R12).")
r14_screening_run = _runner("r14_screening_run", "o02_stress_ranking", "Blocks by concern (R14).")


@query(f"""{_DRIFT}, dv AS (SELECT f.device, f.fold, f.value AS y, lag(f.value, 12) OVER w AS p, lag(f.value, 12) OVER w + drift AS d FROM f JOIN cd ON cd.device = f.device AND cd.hour = hour(f.ts) WINDOW w AS (PARTITION BY f.device ORDER BY f.ts)),
ds AS (SELECT * FROM dv WHERE fold >= 0 AND y IS NOT NULL AND p IS NOT NULL AND d IS NOT NULL) SELECT device, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - d)), 6) AS mae, round(CASE WHEN avg(abs(y - p)) = 0 THEN 0 ELSE 1 - avg(abs(y - d)) / avg(abs(y - p)) END, 6) AS skill FROM ds GROUP BY 1""")
def r02_diurnal_run(spark, sf_dir):
    """The diurnal rule against persistence, by probe."""
    g = folded(spark, sf_dir)
    f = baselines.diurnal_drift(g, g.where("fold = -1"), 12).select("device", "ts", "forecast")
    rows = g.select("device", "ts", "fold", F.col("value").alias("y"), baselines.persistence(12).alias("p")).join(f, ["device", "ts"])
    rows = rows.where("fold >= 0 and y is not null and p is not null and forecast is not null")
    mae, base = F.avg(F.abs(F.col("y") - F.col("forecast"))), F.avg(F.abs(F.col("y") - F.col("p")))
    return saved(rows.groupBy("device").agg(F.count("*").alias("n"), r6(mae, "mae"), r6(scoring.skill(mae, base), "skill")), "diurnal")


@query(f"{_PASSAGE} SELECT coalesce(device, 'ALL') AS device, horizon_h, CAST(count(*) AS BIGINT) AS n, round(avg((p - e) ** 2), 5) AS brier FROM pp GROUP BY GROUPING SETS ((device, horizon_h), (horizon_h))")
def r05_first_passage_run(spark, sf_dir):
    """Brier scores of each device and of all."""
    sets = passages(spark, sf_dir).groupingSets([["device", "horizon_h"], ["horizon_h"]], "device", "horizon_h")
    table = sets.agg(F.count("*").alias("n"), F.round(scoring.brier(F.col("e"), F.col("p")), 5).alias("brier"))
    return saved(table.select(F.coalesce("device", F.lit("ALL")).alias("device"), "horizon_h", "n", "brier"), "first-passage")


@query(f"WITH a AS ({ORACLE_SQL['e15_gated_hybrid']}), b AS ({ORACLE_SQL['e12_select_threshold']}) SELECT a.device, a.threshold, a.mae, a.skill FROM a JOIN b ON b.device = a.device AND b.threshold = a.threshold")
def r06_gated_run(spark, sf_dir):
    """Each device's hybrid at the threshold selected for it."""
    chosen = QUERIES["e12_select_threshold"](spark, sf_dir)
    return saved(QUERIES["e15_gated_hybrid"](spark, sf_dir).join(chosen, ["device", "threshold"]).select("device", "threshold", "mae", "skill"), "gated")


@query()
def r11_survival_run(spark, sf_dir):
    """Integrated Brier scores of each model over folds, weighted by rows, and skill against the product-limit curve."""
    e = QUERIES["e20_hazard_survival"](spark, sf_dir)
    by = e.groupBy("device", "model").agg(F.sum("n").alias("n"), scoring.weighted_mean(F.col("integrated_brier"), F.col("n")).alias("ibs"))
    base = F.max(F.when(F.col("model") == "km-train", F.col("ibs"))).over(Window.partitionBy("device"))
    return saved(by.select("device", "model", "n", r6("ibs", "ibs"), r6(F.when(base > 1e-9, 1 - F.col("ibs") / base), "skill")), "survival")


@query(f"""WITH {_PM}, k AS (SELECT unnest([0, 1, 2]) AS class) SELECT class, CAST(count(*) FILTER (truth = class) AS BIGINT) AS support, CAST(count(*) FILTER (truth = class AND pred = class) AS BIGINT) AS hits FROM k CROSS JOIN cl GROUP BY 1""")
def r13_pseudo_label_run(spark, sf_dir):
    """The tabular part of the classifier's job: classes, and how many are met."""
    c = plots.classified(spark, sf_dir)
    return saved(c.groupBy(F.col("truth").alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("pred")).alias("hits")), "pseudo-label")


@query(f"""WITH {_SEASON}, t AS (SELECT season, round(max(cumulative), 5) AS total, max(date) FILTER (gdd IS NOT NULL) AS last_day FROM cu GROUP BY 1), c AS (SELECT season, min(date) FILTER (cumulative >= 300) AS bloom FROM cu GROUP BY 1) SELECT t.season, total, last_day, bloom FROM t JOIN c ON c.season = t.season""")
def r15_season_run(spark, sf_dir):
    """Trajectories and crossings written, and a line for each season."""
    folder, rows = scratch(spark, "gdd"), season_rows(spark, sf_dir)
    back = saved(rows.select("season", "date", "gdd", "cumulative"), "trajectories", folder)
    lines = back.groupBy("season").agg(F.round(F.max("cumulative"), 5).alias("total"), F.max(F.when(F.col("gdd").isNotNull(), F.col("date"))).alias("last_day"), F.min(F.when(F.col("cumulative") >= BANDS["bloom"], F.col("date"))).alias("bloom"))
    return saved(lines, "seasons", folder)


@query(f"""{_SCORED}, a AS (SELECT model, horizon_h, round(avg(abs(y - pred)), 6) AS mae FROM m GROUP BY 1, 2) SELECT unnest(['| horizon_h | model |', '|---|---|'] || coalesce((SELECT list('| ' || horizon_h || ' | ' || model || ' |' ORDER BY horizon_h, mae, model) FROM a), [])) AS line""")
def r16_report(spark, sf_dir):
    """The models of each lead in order of error, as Markdown."""
    t = stacked(spark, sf_dir).groupBy("model", "horizon_h").agg(r6(scoring.mae(), "mae")).orderBy("horizon_h", "mae", "model").select("horizon_h", "model")
    return spark.createDataFrame([(x,) for x in parsing.markdown_table(t).split("\n")], "line string")


@query(f"{_RANKED}, q AS (SELECT zone, score, abs(c0 - c1) >= 0.3 AS apart, row_number() OVER (ORDER BY round(score, 9) DESC, zone) AS r FROM sc WHERE quality_ok) SELECT zone, round(score, 6) AS score, CAST((SELECT count(*) FROM q WHERE apart) AS BIGINT) AS disagreements FROM q WHERE r <= 10")
def r17_screening_report(spark, sf_dir):
    """The ten blocks of most concern, and how many blocks the two indices disagree on."""
    ok = ranked(spark, sf_dir).where("quality_ok")
    n = ok.agg(F.count_if("disagreement").alias("n")).first()["n"]
    top = ok.orderBy(F.desc(F.round("score", 9)), "zone").limit(10)
    return top.select("zone", r6("score", "score"), F.lit(n).cast("long").alias("disagreements"))


@query(f"""{_SCORED} SELECT horizon_h, CAST(count(DISTINCT device) AS BIGINT) AS probes, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - persistence)), 6) AS persistence, round(avg(abs(y - drydown)), 6) AS drydown FROM s GROUP BY 1""")
def r18_evaluation_report(spark, sf_dir):
    """The evaluation report's table: probes, rows and errors by lead."""
    err = lambda c: r6(F.avg(F.abs(F.col("y") - F.col(c))), c)
    return sensor.scored(spark, sf_dir).groupBy("horizon_h").agg(F.countDistinct("device").alias("probes"), F.count("*").alias("n"), err("persistence"), err("drydown"))


@query(f"""{_RANKED}, mp AS (SELECT zone, CASE WHEN quality_ok THEN round(score, 6) END AS score, coalesce(CASE WHEN quality_ok THEN round(score, 6) END, -1) AS shade FROM sc) SELECT zone, score, shade FROM mp""")
def r19_concern_map(spark, sf_dir):
    """Every polygon with its score; those without one are drawn apart."""
    s = ranked(spark, sf_dir).select("zone", F.when(F.col("quality_ok"), r6("score")).alias("score"))
    return s.withColumn("shade", F.coalesce("score", F.lit(-1.0)))

"""Queries on single operators that the larger ones use, or that stand by themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import baselines, scoring, screening
from ..sources import parsing, views
from .decisions import _EVENTS, found_events
from .registry import FOLDS, GRID, query
from .sensor import _SCORED, ALERT_BELOW, folded, hourly, r6, stacked


def long_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, ts, measurement, value string): readings as a service's long table; every 50th is no number."""
    e = views.table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 50 == 0, "bad").otherwise(F.col("value").cast("string"))
    return e.select(F.concat(F.lit("dev"), F.col("user_id") % 5).alias("device"), "ts", F.col("event_type").alias("measurement"), value.alias("value"))


@query("""SELECT device, ts, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'view') AS "view" FROM (SELECT 'dev' || user_id % 5 AS device, ts, event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS v FROM events)
WHERE device = 'dev1' AND event_type IN ('click', 'view') GROUP BY 1, 2""")
def s02_pivot_read(spark, sf_dir):
    """One device's measurements by time, as the service's query would answer."""
    return parsing.pivoted(long_readings(spark, sf_dir), "dev1", ["click", "view"])


@query("""SELECT device, measurement, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'dev' || user_id % 5 AS device, CASE WHEN user_id % 5 = 2 AND event_type = 'view' THEN 'vacuum' WHEN event_type = 'view' THEN 'soil_water' WHEN event_type = 'error' THEN 'fault' ELSE event_type END AS measurement FROM events) GROUP BY 1, 2""")
def s03_aliases(spark, sf_dir):
    """A device's own meaning of a name comes before the general one."""
    named = parsing.aliased(long_readings(spark, sf_dir), {"view": "soil_water", "error": "fault"}, {("dev2", "view"): "vacuum"})
    return named.groupBy("device", "measurement").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'v' || event_id % 4 || '_prev' || (event_id % 2 + 1) END AS name FROM events")
def s11_vintage_names(spark, sf_dir):
    """Suffixes that tell a forecast's age; other names give nothing."""
    e = views.table(spark, sf_dir, "events").select("event_id")
    raw = F.concat(F.lit("v"), F.col("event_id") % 4, F.when(F.col("event_id") % 3 == 0, "_total").otherwise(F.concat(F.lit("_previous_day"), F.col("event_id") % 2 + 1)))
    m = F.regexp_extract(raw, r"^(.*)_previous_day(\d+)$", 1)
    return e.select("event_id", F.when(m != "", F.concat(m, F.lit("_prev"), F.regexp_extract(raw, r"^(.*)_previous_day(\d+)$", 2))).alias("name"))


@query("SELECT 'B' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'polygon' ELSE 'point' END AS kind, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 1 END AS INT) AS n_coords, n_nationkey + 0.5::DOUBLE AS lon FROM nation WHERE n_nationkey % 5 <> 4")
def s19_placemarks(spark, sf_dir):
    """Points and polygons of KML texts; other geometry is skipped."""
    k = F.col("n_nationkey")
    x = F.concat(k, F.lit(".5,1"))
    shape = F.when(k % 5 == 4, F.lit("<LineString><coordinates>0,0</coordinates></LineString>")).when(
        k % 2 == 0, F.concat(F.lit("<Polygon><coordinates>"), x, F.lit(" 2,3 4,5 </coordinates></Polygon>"))
    ).otherwise(F.concat(F.lit("<Point><coordinates>"), x, F.lit(",0</coordinates></Point>")))
    kml = F.concat(F.lit("<kml><Placemark><name>B"), k, F.lit("</name>"), shape, F.lit("</Placemark></kml>"))
    found = parsing.placemarks(views.table(spark, sf_dir, "nation").select(kml.alias("kml")))
    return found.select("name", "kind", F.size("coords").alias("n_coords"), F.get("coords", F.lit(0))["lon"].alias("lon"))


@query("SELECT 'f ' || n_nationkey || '.tif' AS path, false AS is_dir, CAST(n_nationkey * 10 AS BIGINT) AS size FROM nation")
def s23_propfind(spark, sf_dir):
    """Entries of share listings, decoded and without the folder itself."""
    k = F.col("n_nationkey")
    xml = F.concat(
        F.lit("<d:m><d:response><d:href>/dav/r/</d:href><d:collection/></d:response><d:response><d:href>/dav/r/f%20"), k,
        F.lit(".tif</d:href><d:getcontentlength>"), k * 10, F.lit("</d:getcontentlength></d:response></d:m>"),
    )
    return parsing.propfind(views.table(spark, sf_dir, "nation").select(xml.alias("xml")), F.lit("/dav/r"))


@query(f"WITH {GRID} SELECT device, ts, coalesce(value < 25, false) AS irrigate FROM g")
def p04_threshold_rule(spark, sf_dir):
    """Irrigate below the threshold; missing and equal don't."""
    return hourly(spark, sf_dir).select("device", "ts", scoring.below("value", ALERT_BELOW).alias("irrigate"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, NULL) AS soil_water FROM events")
def p05_normalized_probe(spark, sf_dir):
    """A canonical column wins whole over a raw one that would be renamed to it."""
    e = views.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("soil_water"), F.col("value").alias("water_raw"))
    return e.drop("water_raw") if "soil_water" in e.columns else e.withColumnRenamed("water_raw", "soil_water")


def declared_features(columns: list[str], bases: tuple[str, ...], horizon: int, lead: tuple[str, ...] = ("precip_mm", "et0_mm")) -> list[str]:
    """Columns that are a declared base or begin with one and an underscore, and the lead-time sums of this horizon only."""
    sums = {f"{c}_next_{horizon}h" for c in lead}
    return [c for c in columns if c in sums or ("_next_" not in c and any(c == b or c.startswith(f"{b}_") for b in bases))]


@query(f"""{_SCORED}, a AS (SELECT device, model, horizon_h, count(*) AS w, avg(abs(y - pred)) AS x FROM m GROUP BY 1, 2, 3)
SELECT device, model, round(sum(x * w) / sum(w), 6) AS weighted_mae, round(min(x), 6) AS least_mae FROM a GROUP BY 1, 2""")
def a15_weighted_summary(spark, sf_dir):
    """Row-weighted means over leads of finite scores, and the least."""
    a = stacked(spark, sf_dir).groupBy("device", "model", "horizon_h").agg(F.count("*").alias("w"), scoring.mae().alias("x"))
    return a.groupBy("device", "model").agg(r6(F.sum(F.col("x") * F.col("w")) / F.sum("w"), "weighted_mae"), r6(F.min("x"), "least_mae"))


@query(f"""{_SCORED}, a AS (SELECT device, horizon_h, fold, model, avg(abs(y - pred)) AS x FROM m GROUP BY 1, 2, 3, 4)
SELECT a.device, a.horizon_h, CAST(a.fold AS INT) AS fold, a.model, CASE WHEN b.x > 1e-6 THEN round(1 - a.x / b.x, 6) END AS skill FROM a JOIN a b ON b.device = a.device AND b.horizon_h = a.horizon_h AND b.fold = a.fold AND b.model = 'seasonal' WHERE a.model <> 'seasonal'""")
def j09_reference_skill(spark, sf_dir):
    """Skill against a named reference by a lookup of its score; null where the reference is next to nothing."""
    a = stacked(spark, sf_dir).groupBy("device", "horizon_h", "fold", "model").agg(scoring.mae().alias("x"))
    ref = a.where("model = 'seasonal'").select("device", "horizon_h", "fold", F.col("x").alias("ref"))
    return a.where("model <> 'seasonal'").join(ref, ["device", "horizon_h", "fold"]).select("device", "horizon_h", "fold", "model", r6(F.when(F.col("ref") > 1e-6, 1 - F.col("x") / F.col("ref")), "skill"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) <= 3")
def o08_per_group_cap(spark, sf_dir):
    """At most so many rows of a group, in a stated order."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return views.table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query()
def x18_split_blocks(spark, sf_dir):
    """Blocks wholly for training or validation."""
    return screening.split_groups(views.table(spark, sf_dir, "embeddings").select("label"), "label", 0.25, 42)


@query(f"WITH {GRID} SELECT device, ts, ts - INTERVAL 7 HOUR AS local_ts FROM g")
def x20_local_time(spark, sf_dir):
    """Wall time of a zone seven hours behind, and back to plain timestamps."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "-07:00").cast("timestamp_ntz")
    return hourly(spark, sf_dir).select("device", "ts", local.alias("local_ts"))


@query(f"""{_EVENTS} SELECT device, CAST(count(*) AS BIGINT) AS events, round(quantile_cont(jump, 0.5), 6) AS median_jump, round(quantile_cont(span_h, 0.5), 6) AS median_span_h FROM ev GROUP BY 1""")
def r07_event_summary(spark, sf_dir):
    """Events of each device and their medians."""
    return found_events(spark, sf_dir).groupBy("device").agg(F.count("*").alias("events"), r6(F.percentile("jump", 0.5), "median_jump"), r6(F.percentile("span_h", 0.5), "median_span_h"))


@query(f"""{_SCORED} SELECT model, horizon_h, round(avg(abs(y - pred)), 6) AS mae FROM m WHERE model <> 'drydown' GROUP BY 1, 2 ORDER BY horizon_h, mae""")
def e25_fleet_table(spark, sf_dir):
    """The fleet's table, filtered and in order."""
    by = stacked(spark, sf_dir).where("model <> 'drydown'").groupBy("model", "horizon_h").agg(r6(scoring.mae(), "mae"))
    return by.orderBy("horizon_h", "mae")


@query(f"WITH {FOLDS}, c AS (SELECT o.device, h.h AS horizon_h, k.k AS challenger FROM (SELECT DISTINCT device FROM f) o CROSS JOIN (SELECT unnest([6, 12]) AS h) h CROSS JOIN (SELECT unnest(['a', 'b']) AS k) k) SELECT * FROM c")
def j11_config_product(spark, sf_dir):
    """Challenger x lead x device, from small configuration tables."""
    devices = hourly(spark, sf_dir).select("device").distinct()
    leads = F.explode(F.array(F.lit(6), F.lit(12)))
    return devices.withColumn("horizon_h", leads).withColumn("challenger", F.explode(F.array(F.lit("a"), F.lit("b"))))


_SHAPE = f"""WITH {GRID}, zd AS (SELECT device, i, value - lag(value) OVER (PARTITION BY device ORDER BY ts) AS d FROM g), zw AS (SELECT device, i, d, pow(0.5, (max(i) OVER (PARTITION BY device) - i) / 168.0::DOUBLE) AS w FROM zd WHERE d IS NOT NULL),
zo AS (SELECT device, d, (sum(w) OVER (PARTITION BY device ORDER BY d, i) - w / 2) / sum(w) OVER (PARTITION BY device) AS mid, count(*) OVER (PARTITION BY device) AS n FROM zw),
zl AS (SELECT *, lead(d) OVER w AS nd, lead(mid) OVER w AS nm, first_value(d) OVER w AS d0 FROM zo WINDOW w AS (PARTITION BY device ORDER BY mid)),
zt AS (SELECT device, m, unnest(range(m)) AS j FROM (SELECT device, least(256, max(n)) AS m FROM zo GROUP BY 1)), zq AS (SELECT *, (j + 0.5::DOUBLE) / m AS q FROM zt),
ws AS (SELECT zq.device, zq.j, CASE WHEN zl.d IS NULL THEN f.d0 WHEN zl.nd IS NULL THEN zl.d ELSE zl.d + (q - zl.mid) / (zl.nm - zl.mid) * (zl.nd - zl.d) END AS z FROM zq ASOF LEFT JOIN zl ON zl.device = zq.device AND zq.q >= zl.mid JOIN (SELECT device, any_value(d0) AS d0 FROM zl GROUP BY 1) f ON f.device = zq.device)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, j, z): at most 256 quantiles of each device's hourly changes, weighted by age."""
    z = baselines.hourly_deltas(folded(spark, sf_dir)).where("delta is not null").select("device", "i", "delta")

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        age = pdf["i"].max() - pdf["i"].to_numpy(float)
        s = kernels.weighted_shape(pdf["delta"].to_numpy(float), 0.5 ** (age / 168), 256)
        return pd.DataFrame({"device": pdf["device"].iloc[0], "j": np.arange(len(s)), "z": s})

    return z.groupBy("device").applyInPandas(shape, "device string, j long, z double")


@query(f"{_SHAPE} SELECT device, j, round(z, 5) AS z FROM ws")
def d13_weighted_shape(spark, sf_dir):
    """Weighted quantiles, interpolated at the midpoints of the weights."""
    return shapes(spark, sf_dir).select("device", "j", F.round("z", 5).alias("z"))


@query(f"""{_SHAPE}, wk AS (SELECT device, z, row_number() OVER (PARTITION BY device ORDER BY z) - 1 AS k, count(*) OVER (PARTITION BY device) AS n FROM ws) SELECT device, CAST(max(n) AS BIGINT) AS points,
CASE WHEN avg(abs(z)) > 0 THEN round(1 - 0.5 * (2 * sum(z * (2 * k - n + 1)) / (max(n) * max(n))::DOUBLE) / avg(abs(z)), 6) END AS ceiling FROM wk GROUP BY 1""")
def d14_ceiling(spark, sf_dir):
    """What the best reweighted shape could gain: ceilings of weighted quantile shapes of hourly changes."""
    w = Window.partitionBy("device")  # 256 rows
    k = shapes(spark, sf_dir).withColumn("k", F.row_number().over(w.orderBy("z")) - 1).withColumn("n", F.count("*").over(w))
    n, spread = F.max("n").cast("double"), F.avg(F.abs("z"))
    gmd = 2 * F.sum(F.col("z") * (2 * F.col("k") - F.col("n") + 1)) / (n * n)
    return k.groupBy("device").agg(F.max("n").alias("points"), r6(F.when(spread > 0, 1 - 0.5 * gmd / spread), "ceiling"))

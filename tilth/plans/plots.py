"""Queries on rasters, screening, phenology, parsing and small utilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import phenology, screening
from ..sources import parsing, views
from .registry import GRID, WEATHER, query
from .sensor import hourly, r6

_PX = """px AS (SELECT label AS zone, CAST(k >= 32 AS INT) AS band, vec_id * 32 + k % 32 AS pos, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding) AS v FROM embeddings)),
zs AS (SELECT DISTINCT zone FROM px UNION ALL SELECT -1)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels, and one zone that has no cell."""
    return views.pixels(spark, sf_dir).select("zone").distinct().unionByName(spark.range(1).select(F.lit(-1).alias("zone")))


@query(f"WITH {_PX} SELECT zs.zone, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, CAST(count(value) AS BIGINT) AS count FROM zs LEFT JOIN px ON px.zone = zs.zone AND band = 0 GROUP BY 1")
def a08_zonal_stats(spark, sf_dir):
    z = screening.zonal_stats(views.pixels(spark, sf_dir).where("band = 0"), zones(spark, sf_dir))
    return z.select("zone", r6("mean", "mean"), r6("std", "std"), "count")


def _dist(band: int) -> str:
    return f"""SELECT zs.zone, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS count, coalesce(count(value) / nullif(count(band), 0)::DOUBLE, 0) AS coverage, quantile_cont(value, [0.1, 0.25, 0.5, 0.75]) AS q,
avg(CASE WHEN value < 0 THEN 1.0 WHEN value >= 0 THEN 0.0 END::DOUBLE) AS fraction_below FROM zs LEFT JOIN px ON px.zone = zs.zone AND band = {band} GROUP BY 1"""


@query(f"""WITH {_PX}, d AS ({_dist(0)}) SELECT zone, round(mean, 6) AS mean, round(std, 6) AS std, CAST(count AS BIGINT) AS count, round(coverage, 6) AS coverage, round(q[1], 6) AS q10, round(q[2], 6) AS q25,
round(q[3], 6) AS q50, round(q[4], 6) AS q75, round(q[4] - q[2], 6) AS iqr, round(fraction_below, 6) AS fraction_below FROM d""")
def a09_zonal_distribution(spark, sf_dir):
    z = screening.zonal_distribution(views.pixels(spark, sf_dir).where("band = 0"), zones(spark, sf_dir), low=0.0)
    return z.select("zone", "count", *[r6(c, c) for c in ("mean", "std", "coverage", "q10", "q25", "q50", "q75", "iqr", "fraction_below")])


_RANKED = f"""WITH {_PX}, a AS ({_dist(0)}), b AS ({_dist(1)}), j AS (SELECT coalesce(a.zone, b.zone) AS zone, a.mean AS m0, b.mean AS m1, coalesce(a.coverage >= 0.8 AND a.count >= 1 AND a.mean IS NOT NULL, false) AND coalesce(b.coverage >= 0.8 AND b.count >= 1 AND b.mean IS NOT NULL, false) AS quality_ok
FROM a FULL JOIN b ON a.zone = b.zone), c AS (SELECT *, count(*) FILTER (quality_ok) OVER () AS n FROM j),
r AS (SELECT zone, quality_ok, CASE WHEN quality_ok THEN (rank() OVER (PARTITION BY quality_ok ORDER BY m0 DESC) + (count(*) OVER (PARTITION BY quality_ok, m0) - 1) / 2.0) / n END AS c0,
CASE WHEN quality_ok THEN (rank() OVER (PARTITION BY quality_ok ORDER BY m1 DESC) + (count(*) OVER (PARTITION BY quality_ok, m1) - 1) / 2.0) / n END AS c1 FROM c),
sc AS (SELECT *, 0.6 * c0 + 0.4 * c1 AS score FROM r)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, z = views.pixels(spark, sf_dir), zones(spark, sf_dir)
    return screening.rank_stress(*(screening.zonal_distribution(px.where(F.col("band") == b), z) for b in (0, 1)))


@query(f"""{_RANKED} SELECT zone, quality_ok, round(c0, 6) AS ndvi_concern, round(c1, 6) AS ndre_concern, round(score, 6) AS score, CASE WHEN quality_ok THEN CAST(rank() OVER (PARTITION BY quality_ok ORDER BY round(score, 9) DESC) AS INT) END AS rank,
CASE WHEN quality_ok THEN abs(c0 - c1) >= 0.3 END AS disagreement FROM sc""")
def o02_stress_ranking(spark, sf_dir):
    """Zones by concern."""
    return ranked(spark, sf_dir).select("zone", "quality_ok", *[r6(c, c) for c in ("ndvi_concern", "ndre_concern", "score")], F.col("rank").cast("int").alias("rank"), "disagreement").orderBy(
        F.desc("quality_ok"), F.asc_nulls_last("rank"), "zone"
    )


@query(f"{_RANKED} SELECT zone, round(score, 6) AS score FROM sc WHERE quality_ok ORDER BY round(score, 9) DESC, zone LIMIT 5")
def o04_top_concern(spark, sf_dir):
    return ranked(spark, sf_dir).where("quality_ok").orderBy(F.desc(F.round("score", 9)), "zone").limit(5).select("zone", r6("score", "score"))


@query("""SELECT vec_id, greatest(-1, least(1, (e[4] - e[1]) / (e[4] + e[1] + 1e-8::FLOAT))) AS ndvi, greatest(-1, least(1, (e[4] - e[5]) / (e[4] + e[5] + 1e-8::FLOAT))) AS ndre FROM
(SELECT vec_id, list_transform(embedding, lambda x: abs(x)) AS e FROM embeddings)""")
def x01_indices(spark, sf_dir):
    """Vegetation indices in single precision."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x)).alias("e"))
    c = screening.stacked_channels(*[F.get("e", F.lit(i)) for i in (0, 1, 2, 3, 4)])
    return e.select("vec_id", c.alias("c")).select("vec_id", F.get("c", F.lit(5)).alias("ndvi"), F.get("c", F.lit(6)).alias("ndre"))


@query(f"""WITH {_PX}, m AS (SELECT zone, avg(value) AS v FROM px WHERE band = 0 GROUP BY 1), t AS (SELECT quantile_cont(v, [0.33, 0.66]) AS q FROM m)
SELECT zone, CAST(v >= q[1] AS INT) + CAST(v >= q[2] AS INT) AS class FROM m CROSS JOIN t""")
def x12_quantile_classes(spark, sf_dir):
    """Classes by quantiles of the zones' means."""
    m = views.pixels(spark, sf_dir).where("band = 0").groupBy("zone").agg(F.avg("value").alias("v"))
    t = list(m.agg(F.percentile("v", F.array(F.lit(0.33), F.lit(0.66))).alias("q")).first()["q"] or [])
    return m.select("zone", screening.digitize(F.col("v"), t).alias("class"))


_PM = f"""{_PX}, t AS (SELECT pos, zone, max(value) FILTER (band = 0) AS a, max(value) FILTER (band = 1) AS b FROM px GROUP BY 1, 2),
cl AS (SELECT CAST(a >= -0.05 AS INT) + CAST(a >= 0.05 AS INT) AS truth, CAST(b >= -0.05 AS INT) + CAST(b >= 0.05 AS INT) AS pred FROM t)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir).groupBy("pos", "zone").pivot("band", [0, 1]).agg(F.max("value"))
    return px.select(screening.digitize(F.col("0"), [-0.05, 0.05]).alias("truth"), screening.digitize(F.col("1"), [-0.05, 0.05]).alias("pred"))


@query(f"WITH {_PM} SELECT c.truth, CAST(count(*) FILTER (cl.pred = 0) AS BIGINT) AS pred_0, CAST(count(*) FILTER (cl.pred = 1) AS BIGINT) AS pred_1, CAST(count(*) FILTER (cl.pred = 2) AS BIGINT) AS pred_2 FROM (SELECT unnest([0, 1, 2]) AS truth) c LEFT JOIN cl ON cl.truth = c.truth GROUP BY 1")
def a18_crosstab(spark, sf_dir):
    """Confusion of classes in fixed order, zeros filled."""
    t = classified(spark, sf_dir).groupBy("truth").pivot("pred", [0, 1, 2]).count()
    every = spark.range(3).select(F.col("id").cast("int").alias("truth"))
    return every.join(t, "truth", "left").fillna(0).select("truth", *[F.col(str(i)).alias(f"pred_{i}") for i in range(3)])


@query(f"""WITH {_PM}, k AS (SELECT unnest([0, 1, 2]) AS class), s AS (SELECT k.class, count(*) FILTER (truth = class) AS support, count(*) FILTER (truth = class AND pred = class) AS hit, count(*) FILTER (pred = class) AS said FROM k CROSS JOIN cl GROUP BY 1)
SELECT class, CAST(support AS BIGINT) AS support, round(coalesce(hit / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(hit / nullif(said, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(2 * hit / nullif(support + said, 0)::DOUBLE, 0), 6) AS f1 FROM s""")
def a25_class_report(spark, sf_dir):
    c = classified(spark, sf_dir).groupBy("truth", "pred").count()
    rows = c.select(F.inline(F.array(F.struct(F.col("truth").alias("class"), F.col("count").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("count").alias("said")))), (F.col("truth") == F.col("pred")).alias("same"), "count")
    s = rows.groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum(F.when(F.col("same"), F.col("support")).otherwise(0)).alias("hit"))
    from ..operators.scoring import ratio

    return s.select("class", "support", r6(ratio(F.col("hit"), F.col("support")), "recall"), r6(ratio(F.col("hit"), F.col("said")), "precision"), r6(ratio(2 * F.col("hit"), F.col("support") + F.col("said")), "f1"))


@query(f"WITH {_PX} SELECT band, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-6), 6) AS std FROM px WHERE zone % 2 = 0 GROUP BY 1")
def m20_channel_stats(spark, sf_dir):
    """Mean and deviation of each channel over training zones only."""
    return views.pixels(spark, sf_dir).where("zone % 2 = 0").groupBy("band").agg(r6(F.avg("value"), "mean"), r6(F.greatest(F.stddev_pop("value"), F.lit(1e-6)), "std"))


_SEASON = """sw AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) / 15000 AS hi, min(o_totalprice) / 15000 AS lo FROM orders GROUP BY 1),
dd AS (SELECT y AS season, unnest(generate_series(make_date(y, 4, 1), make_date(y, 10, 31), INTERVAL 1 DAY))::DATE AS date FROM (SELECT unnest(range(1995, 2002)) AS y)),
tr AS (SELECT CAST(season AS INT) AS season, dd.date, greatest((least(hi, 30) + least(lo, 30)) / 2 - 10, 0) + 0 * hi * lo AS gdd FROM dd LEFT JOIN sw ON sw.date = dd.date),
tj AS (SELECT season, date, CASE WHEN gdd IS NOT NULL AND date IN (SELECT date FROM sw) THEN gdd END AS gdd FROM tr),
cu AS (SELECT *, coalesce(sum(gdd) OVER w, 0) AS cumulative, sum(CASE WHEN gdd IS NULL THEN 1 ELSE 0 END) OVER w AS missing FROM tj WINDOW w AS (PARTITION BY season ORDER BY date))"""
BANDS = {"budbreak": 60.0, "bloom": 300.0, "veraison": 900.0, "harvest": 1600.0}


def season_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = spark.range(1995, 2002).select(F.col("id").cast("int").alias("season"))
    seasons = years.select("season", F.make_date("season", F.lit(4), F.lit(1)).alias("first"), F.make_date("season", F.lit(10), F.lit(31)).alias("last"))
    return phenology.trajectories(views.season_weather(spark, sf_dir), seasons, cap=30.0)


@query(f"WITH {_SEASON} SELECT season, date, round(gdd, 6) AS gdd, round(cumulative, 5) AS cumulative, gdd IS NULL AS is_gap, CAST(missing AS BIGINT) AS missing FROM cu")
def w26_gdd_trajectory(spark, sf_dir):
    """Degree days through each season on a full calendar."""
    return season_rows(spark, sf_dir).select("season", "date", r6("gdd", "gdd"), F.round("cumulative", 5).alias("cumulative"), "is_gap", "missing")


@query(f"""WITH {_SEASON}, b AS (SELECT unnest(['budbreak', 'bloom', 'veraison', 'harvest']) AS band, unnest([60.0, 300.0, 900.0, 1600.0]::DOUBLE[]) AS threshold)
SELECT season, band, threshold, min(date) FILTER (cumulative >= threshold) AS date FROM cu CROSS JOIN b GROUP BY 1, 2, 3""")
def o07_band_crossings(spark, sf_dir):
    return phenology.crossings(season_rows(spark, sf_dir), BANDS)


@query(f"""WITH {_SEASON}, t AS (SELECT season, sum(gdd) AS total FROM cu GROUP BY 1) SELECT season, round(total, 5) AS total,
CASE WHEN total IS NULL THEN NULL WHEN total < 1389 THEN 'I' WHEN total < 1667 THEN 'II' WHEN total < 1944 THEN 'III' WHEN total < 2222 THEN 'IV' ELSE 'V' END AS region FROM t""")
def x06_season_region(spark, sf_dir):
    t = season_rows(spark, sf_dir).groupBy("season").agg(F.sum("gdd").alias("total"))
    return t.select("season", F.round("total", 5).alias("total"), phenology.region(F.col("total")).alias("region"))


@query("SELECT o_custkey AS block_id, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders GROUP BY 1")
def g05_last_date(spark, sf_dir):
    """Last recorded date of each block."""
    return views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("block_id")).agg(F.max(F.to_date("o_orderdate")).alias("last_date"))


@query("SELECT season, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM (SELECT *, CAST(year(o_orderdate) AS INT) AS season FROM orders) GROUP BY 1")
def a27_first_per_key(spark, sf_dir):
    """First row of each key in a stated order."""
    o = views.table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate"))
    return o.groupBy("season").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("""SELECT l_returnflag AS kind, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS blocks, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS open_rows, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS open_size, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def a13_inventory(spark, sf_dir):
    """Inventory line: distinct blocks, flags, conditional sizes."""
    r = views.table(spark, sf_dir, "lineitem")
    o = F.col("l_linestatus") == "O"
    return r.groupBy(F.col("l_returnflag").alias("kind")).agg(F.countDistinct("l_suppkey").alias("blocks"), F.count_if(o).alias("open_rows"), F.round(F.sum(F.when(o, F.col("l_quantity")).otherwise(0.0)), 2).alias("open_size"), F.count("*").alias("n"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2")
def a14_exactly_two(spark, sf_dir):
    """Keys with exactly two kinds, and their sizes."""
    g = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("k"), F.count("*").alias("n"))
    return g.where("k = 2").select("o_custkey", "n")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, try_cast(user_id AS DOUBLE) AS reading FROM events")
def s10_json_fields(spark, sf_dir):
    """JSON payloads and number coercion."""
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.expr("try_cast(cast(user_id as string) as double)").alias("reading"))


@query("""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)?', 1) AS path FROM pages""")
def s27_url_parts(spark, sf_dir):
    """Parts of share links."""
    p = views.table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^(https?)://", 1).alias("scheme"), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)?", 1).alias("path"))


_CAP = """cf AS (SELECT event_id, 'DJI_' || strftime(DATE '2024-01-01' + CAST(event_id // 60 AS INT), '%Y%m%d') || '120000_' || lpad(CAST(event_id // 6 % 10000 AS VARCHAR), 4, '0') || '_' ||
CASE event_id % 6 WHEN 0 THEN 'D_point1.JPG' WHEN 1 THEN 'MS_G_point1.TIF' WHEN 2 THEN 'MS_R_point1.TIF' WHEN 3 THEN 'MS_RE_point1.TIF' WHEN 4 THEN 'MS_NIR_point1.TIF' ELSE 'PPKNAV.nav' END AS name, '/flights/' || event_id AS path FROM events),
cp AS (SELECT event_id, path, name[5:18] AS taken, name[20:23] AS seq, CASE event_id % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'MS_G' WHEN 2 THEN 'MS_R' WHEN 3 THEN 'MS_RE' WHEN 4 THEN 'MS_NIR' END AS tag FROM cf)"""


def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("event_id")
    kinds = F.array(*[F.lit(b) for b in ("D_point1.JPG", "MS_G_point1.TIF", "MS_R_point1.TIF", "MS_RE_point1.TIF", "MS_NIR_point1.TIF", "PPKNAV.nav")])
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("event_id") / 60).cast("int")), "yyyyMMdd")
    seq = F.lpad((F.floor(F.col("event_id") / 6) % 10000).cast("string"), 4, "0")
    name = F.concat(F.lit("DJI_"), day, F.lit("120000_"), seq, F.lit("_"), F.get(kinds, (F.col("event_id") % 6).cast("int")))
    return e.select("event_id", name.alias("name"), F.concat(F.lit("/flights/"), "event_id").alias("path"))


@query(f"WITH {_CAP} SELECT event_id, CASE WHEN tag IS NOT NULL THEN taken END AS taken, CASE WHEN tag IS NOT NULL THEN seq END AS seq, tag, CASE WHEN tag IS NOT NULL THEN CAST(1 AS INT) END AS point FROM cp")
def s30_capture_names(spark, sf_dir):
    """Time, sequence, kind and way point from the camera's file names; sidecars have none."""
    f = capture_files(spark, sf_dir)
    return f.select("event_id", *[c.alias(k) for k, c in parsing.capture_fields(F.col("name")).items()])


@query(f"""WITH {_CAP}, o AS (SELECT taken, seq, tag, max(path) AS path FROM cp WHERE tag IS NOT NULL GROUP BY 1, 2, 3) SELECT taken, seq, CAST(1 AS INT) AS point, CAST(count(*) FILTER (tag <> 'D') AS INT) AS n_bands, max(path) FILTER (tag = 'MS_RE') AS red_edge, max(path) FILTER (tag = 'D') AS rgb FROM o GROUP BY 1, 2""")
def a12_captures(spark, sf_dir):
    """Files grouped into captures by their names; what isn't a capture is left out."""
    return parsing.group_captures(capture_files(spark, sf_dir)).select("taken", "seq", "point", F.size("bands").alias("n_bands"), F.col("bands")["red_edge"].alias("red_edge"), "rgb")


_BLOCKS = """bl AS (SELECT * FROM (VALUES ('A', 0.0, 0.0, 4.0, 4.0), ('B', 5.0, 0.0, 9.0, 3.0), ('C', 0.0, 5.0, 3.0, 9.0)) t(block_id, x0, y0, x1, y1)),
pt AS (SELECT s_suppkey AS name, (s_suppkey * 7 % 100) / 10.0::DOUBLE + 0.03 AS lon, (s_suppkey * 13 % 100) / 10.0::DOUBLE + 0.07 AS lat FROM supplier)"""


@query(f"WITH {_BLOCKS} SELECT name, block_id FROM pt LEFT JOIN bl ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def j02_points_in_blocks(spark, sf_dir):
    """Devices placed in blocks; those outside all keep a null."""
    box = lambda n, a, b, c, d: (n, [(a, b), (c, b), (c, d), (a, d)])
    blocks = spark.createDataFrame([box("A", 0.0, 0.0, 4.0, 4.0), box("B", 5.0, 0.0, 9.0, 3.0), box("C", 0.0, 5.0, 3.0, 9.0)], "block_id string, ring array<struct<lon: double, lat: double>>")
    k = F.col("s_suppkey")
    points = views.table(spark, sf_dir, "supplier").select(k.alias("name"), (k * 7 % 100 / 10 + 0.03).alias("lon"), (k * 13 % 100 / 10 + 0.07).alias("lat"))
    return screening.assign_to_polygons(points, blocks).select("name", "block_id")


@query("SELECT p_partkey, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM (SELECT p_partkey, p_size * 4 AS h, p_size * 3 AS w FROM part) p, (SELECT unnest(range(0, 400, 32)) AS r) rr, (SELECT unnest(range(0, 400, 32)) AS c) cc WHERE r + 32 <= h AND c + 32 <= w")
def x17_tile_origins(spark, sf_dir):
    """Origins of whole tiles."""
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.inline(screening.tile_origins(F.col("p_size") * 4, F.col("p_size") * 3, 32)))


@query(f"""WITH {GRID}, t AS (SELECT max(ts) + INTERVAL 3 HOUR AS now FROM g), l AS (SELECT device, arg_max(value, ts) AS level, max(ts) AS read_at FROM g WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1)
SELECT device, round(level, 6) AS level, read_at, round((epoch(now) - epoch(read_at)) / 3600.0::DOUBLE, 4) AS age_h, CASE WHEN epoch(now) - epoch(read_at) < -900 THEN 'invalid' WHEN epoch(now) - epoch(read_at) > 4 * 3600 THEN 'stale' ELSE 'ok' END AS status FROM l CROSS JOIN t""")
def o05_latest_reading(spark, sf_dir):
    """Latest finite reading of each device, with its age and standing."""
    g = hourly(spark, sf_dir)
    now = g.agg((F.max("ts") + F.expr("INTERVAL 3 HOURS")).alias("now"))
    latest = g.where("value is not null").groupBy("device").agg(F.max_by("value", "ts").alias("level"), F.max("ts").alias("read_at"))
    age = (F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("read_at").cast("timestamp"))) / 3600.0
    s = latest.crossJoin(now).withColumn("age_h", age)
    return s.select("device", r6("level", "level"), "read_at", F.round("age_h", 4).alias("age_h"), F.when(F.col("age_h") < -0.25, "invalid").when(F.col("age_h") > 4, "stale").otherwise("ok").alias("status"))


@query(f"WITH {GRID} SELECT device, ts, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos FROM g")
def x21_cyclic_hour(spark, sf_dir):
    a = 2 * F.pi() * F.hour("ts") / 24
    return hourly(spark, sf_dir).select("device", "ts", r6(F.sin(a), "hour_sin"), r6(F.cos(a), "hour_cos"))


_RANGES = {"click": (5.0, 400.0), "view": (0.0, 300.0), "error": (10.0, 450.0)}


@query(f"""WITH {GRID}, r AS (SELECT * FROM (VALUES ('click', 5.0, 400.0), ('view', 0.0, 300.0), ('error', 10.0, 450.0)) t(device, lo, hi))
SELECT g.device, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(value) AS BIGINT) AS missing, CASE WHEN any_value(lo) IS NOT NULL THEN CAST(count(*) FILTER (coalesce(value < lo OR value > hi, false)) AS BIGINT) END AS out_of_range FROM g LEFT JOIN r ON r.device = g.device GROUP BY 1""")
def a07_quality_profile(spark, sf_dir):
    """Missing and out-of-range bins; without a known unit there is no range, and the count is null."""
    ranges = spark.createDataFrame([(d, *r) for d, r in _RANGES.items()], "device string, lo double, hi double")
    g = hourly(spark, sf_dir).join(F.broadcast(ranges), "device", "left")  # three rows
    out = F.coalesce((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), F.lit(False))
    return g.groupBy("device").agg(F.count("*").alias("n"), (F.count("*") - F.count("value")).alias("missing"), F.when(F.max("lo").isNotNull(), F.count_if(out)).alias("out_of_range"))


@query(f"WITH {WEATHER} SELECT date, precip_mm, et0_mm FROM (SELECT date, round(precip_mm, 6) AS precip_mm, round(et0_mm, 6) AS et0_mm FROM wd) EXCEPT SELECT date, precip_mm, et0_mm FROM (SELECT date, round(precip_mm, 6) AS precip_mm, round(et0_mm, 6) AS et0_mm FROM wd) WHERE precip_mm IS NULL")
def u03_set_difference(spark, sf_dir):
    """Days less those without precipitation."""
    w = views.weather_daily(spark, sf_dir).select("date", r6("precip_mm", "precip_mm"), r6("et0_mm", "et0_mm"))
    return w.exceptAll(w.where("precip_mm is null"))

"""Queries on sources and sinks: services by recorded answers, files in the shared folder, read back."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import configs
from ..operators import features, screening
from ..sources import archives, parsing, raster, services, views
from ..sources.scratch import scratch
from .plots import _SEASON
from .registry import GRID, WEATHER, query
from .sensor import _JOINED, _SCORED, hourly, r6, stacked, with_weather
from .small import long_readings

_READINGS = "SELECT event_type AS device, ts, value FROM events"


def _sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(F.col("event_type").alias("device"), "ts", "value")


def _answer(text: str):
    """An opener that gives one answer, whatever is asked."""
    return lambda request, timeout=None: io.BytesIO(text.encode())


@query("""SELECT CAST(k AS INT) AS line, t AS text FROM (VALUES (0, 'from(bucket: "probes")'), (1, '  |> range(start: -2d, stop: now())'), (2, '  |> filter(fn: (r) => r.device_name == "dev1")'), (3, '  |> filter(fn: (r) => r._measurement == "click" or r._measurement == "view")'),
(4, '  |> pivot(rowKey: ["_time"], columnKey: ["_measurement"], valueColumn: "_value")')) v(k, t)""")
def s01_flux_text(spark, sf_dir):
    """The text of a time-series query."""
    text = parsing.flux_query("dev1", ["click", "view"], "probes", "-2d", "now()")
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@query("SELECT ts, value FROM events WHERE event_type = 'click'")
def s04_sensor_csv(spark, sf_dir):
    """One sensor's CSV file, in order of time."""
    path = scratch(spark, "csv")
    _sensor(spark, sf_dir).where("device = 'click'").select(F.col("ts").alias("timestamp"), "value").write.option("timestampNTZFormat", parsing.MICROS).csv(path, header=True)
    return parsing.read_sensor_csv(spark, path, "timestamp timestamp_ntz, value double").withColumnRenamed("timestamp", "ts")


@query("SELECT ts, value FROM events WHERE event_type = 'view'")
def s05_snapshot(spark, sf_dir):
    """One device of a snapshot: a folder each, so the others aren't read."""
    path = scratch(spark, "snapshot")
    parsing.write_by_device(_sensor(spark, sf_dir), path)
    return archives.snapshot(spark, path, "view").select("ts", "value")


_WX = "SELECT date, round(temp_max_c, 6) AS temp_max_c, round(precip_mm, 6) AS precip_mm FROM wd"


def _wx(df: DataFrame) -> DataFrame:
    return df.select("date", r6("temp_max_c", "temp_max_c"), r6("precip_mm", "precip_mm"))


@query(f"WITH {WEATHER} {_WX}")
def s06_latest_weather(spark, sf_dir):
    """The last snapshot by name."""
    folder = scratch(spark, "weather")
    daily = views.weather_daily(spark, sf_dir)
    daily.limit(1).coalesce(1).write.parquet(f"{folder}/weather_2023-01-01_2023-02-01.parquet")
    daily.coalesce(1).write.parquet(f"{folder}/weather_2024-01-01_2024-02-01.parquet")
    return _wx(parsing.latest_file(spark, f"{folder}/weather_*.parquet/*.parquet"))


def _pairs(spark: SparkSession, params: dict) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in params.items()], "key string, value string")


_AT = "('latitude', '38.5'), ('longitude', '-122.5'), ('timezone', 'UTC')"


@query(f"SELECT * FROM (VALUES {_AT}, ('start_date', '2024-01-01'), ('end_date', '2024-01-31'), ('daily', 'tmax,rain')) v(key, value)")
def s07_archive_params(spark, sf_dir):
    return _pairs(spark, parsing.archive_params("2024-01-01", "2024-01-31", 38.5, -122.5, ("tmax", "rain")))


@query(f"SELECT * FROM (VALUES {_AT}, ('forecast_days', '7'), ('daily', 'tmax,rain')) v(key, value)")
def s08_forecast_params(spark, sf_dir):
    return _pairs(spark, parsing.forecast_params(7, 38.5, -122.5, ("tmax", "rain")))


@query(f"SELECT * FROM (VALUES {_AT}, ('start_date', '2024-01-01'), ('end_date', '2024-01-31'), ('hourly', 'rain_previous_day1,rain_previous_day2,et0_previous_day1,et0_previous_day2')) v(key, value)")
def s09_previous_runs_params(spark, sf_dir):
    return _pairs(spark, parsing.previous_runs_params("2024-01-01", "2024-01-31", 38.5, -122.5, ("rain", "et0")))


def _daily_answer(spark: SparkSession, sf_dir: str) -> str:
    rows = views.weather_daily(spark, sf_dir).orderBy("date").collect()  # a row a day
    return json.dumps({"daily": {"time": [str(r["date"]) for r in rows], "tmax": [r["temp_max_c"] for r in rows], "rain": [r["precip_mm"] for r in rows]}})


_NAMES = {"tmax": "temp_max_c", "rain": "precip_mm"}


@query(f"WITH {WEATHER} {_WX}")
def s12_fetch_archive(spark, sf_dir):
    """Past weather as the service answers."""
    params = parsing.archive_params("2024-01-01", "2024-01-31", 38.5, -122.5, tuple(_NAMES))
    return _wx(services.fetch_daily(spark, "https://archive.example.org/v1", params, _NAMES, _answer(_daily_answer(spark, sf_dir))))


@query(f"WITH {WEATHER} {_WX}")
def s13_fetch_forecast(spark, sf_dir):
    """Coming weather as the service answers."""
    params = parsing.forecast_params(7, 38.5, -122.5, tuple(_NAMES))
    return _wx(services.fetch_daily(spark, "https://forecast.example.org/v1", params, _NAMES, _answer(_daily_answer(spark, sf_dir))))


_HV = f"WITH {GRID} SELECT ts, round(value / 100, 6) AS rain_prev1, round(value / 50, 6) AS rain_prev2 FROM g WHERE device = 'view'"


def _vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(spark, sf_dir).where("device = 'view'").orderBy("ts").select("ts", "value").collect()  # a row an hour of one place
    raw = {f"rain_previous_day{n}": [None if r["value"] is None else r["value"] / k for r in rows] for n, k in ((1, 100), (2, 50))}
    text = json.dumps({"hourly": {"time": [r["ts"].strftime("%Y-%m-%dT%H:%M") for r in rows], **raw}})
    params = parsing.previous_runs_params("2024-01-01", "2024-01-31", 38.5, -122.5, ("rain",))
    return services.fetch_vintages(spark, "https://previous.example.org/v1", params, _answer(text))


def _vx(df: DataFrame) -> DataFrame:
    return df.select("ts", r6("rain_prev1", "rain_prev1"), r6("rain_prev2", "rain_prev2"))


@query(_HV)
def s14_fetch_vintages(spark, sf_dir):
    """Archived forecasts as the service answers."""
    return _vx(_vintages(spark, sf_dir))


def _cached(name: str, doc: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, asked = scratch(spark, "vintages"), []

        def build() -> DataFrame:
            asked.append(1)
            return _vintages(spark, sf_dir)

        archives.cached(spark, path, build)
        again = archives.cached(spark, path, build)
        if len(asked) != 1:
            raise RuntimeError("the cache asked twice")
        return _vx(again)

    run.__name__, run.__doc__ = name, doc
    return query(_HV)(run)


s15_event_study_cache = _cached("s15_event_study_cache", "Forecasts from the snapshot, fetched only once (S15).")
s16_gated_cache = _cached("s16_gated_cache", "The same for the gated runner (S16).")
s17_water_balance_cache = _cached("s17_water_balance_cache", "The same for the water-balance runner (S17).")


def _kml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a KML text for each nation, every third zipped."""
    k = F.col("n_nationkey")
    shape = F.when(k % 2 == 0, F.concat(F.lit("<Polygon><coordinates>"), k, F.lit(".5,1 2,3 4,5</coordinates></Polygon>"))).otherwise(F.concat(F.lit("<Point><coordinates>"), k, F.lit(".5,1</coordinates></Point>")))
    kml = F.concat(F.lit("<kml><Placemark><name>B"), k, F.lit("</name>"), shape, F.lit("</Placemark></kml>"))

    @F.pandas_udf("binary")
    def packed(text: pd.Series, zipped: pd.Series) -> pd.Series:
        def one(t: str, z: bool) -> bytes:
            if not z:
                return t.encode()
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as f:
                f.writestr("doc.kml", t)
            return out.getvalue()

        return pd.Series([one(t, z) for t, z in zip(text, zipped, strict=True)])

    return views.table(spark, sf_dir, "nation").select(F.concat(F.lit("/b/"), k).alias("path"), packed(kml, k % 3 == 0).alias("content"))


@query("SELECT '/b/' || n_nationkey AS path, contains('polygon', CASE WHEN n_nationkey % 2 = 0 THEN 'polygon' ELSE 'x' END) AS has_polygon FROM nation")
def s18_kmz_texts(spark, sf_dir):
    """Texts of KML files, zipped or plain."""
    return parsing.kmz_texts(_kml_files(spark, sf_dir)).select("path", F.col("kml").contains("<Polygon>").alias("has_polygon"))


@query("SELECT 'B' || n_nationkey AS name, CAST(3 AS INT) AS n_coords, n_nationkey + 0.5::DOUBLE AS lon FROM nation WHERE n_nationkey % 2 = 0")
def s20_polygons(spark, sf_dir):
    return parsing.placemarks(parsing.kmz_texts(_kml_files(spark, sf_dir))).where("kind = 'polygon'").select("name", F.size("coords").alias("n_coords"), F.get("coords", F.lit(0))["lon"].alias("lon"))


@query("SELECT 'B' || n_nationkey AS name, n_nationkey + 0.5::DOUBLE AS lon FROM nation WHERE n_nationkey % 2 = 1")
def s21_points(spark, sf_dir):
    return parsing.placemarks(parsing.kmz_texts(_kml_files(spark, sf_dir))).where("kind = 'point'").select("name", F.get("coords", F.lit(0))["lon"].alias("lon"))


@query("SELECT 'R' || r_regionkey AS block_id, CAST(4 AS INT) AS corners, r_regionkey::DOUBLE AS lon FROM region")
def s22_blocks(spark, sf_dir):
    """Blocks of a GeoJSON file."""
    keys = [r["r_regionkey"] for r in views.table(spark, sf_dir, "region").collect()]  # a row a region
    ring = lambda k: [[k, 0.0], [k + 1, 0.0], [k + 1, 1.0], [k, 1.0]]
    text = json.dumps({"features": [{"properties": {"block_id": f"R{k}"}, "geometry": {"type": "Polygon", "coordinates": [ring(float(k))]}} for k in keys]})
    path = scratch(spark, "geojson")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return archives.blocks_geojson(spark, path).select("block_id", F.size("ring").alias("corners"), F.get("ring", F.lit(0))["lon"].alias("lon"))


_DAV = '<m><response><href>/public.php/webdav/a/</href><collection/></response>' + "".join(f"<response><href>/public.php/webdav/a/f%20{i}.tif</href><getcontentlength>{10 * i}</getcontentlength></response>" for i in range(3)) + "</m>"


def _share(_: str = ""):
    return services.ShareClient("https://share.example.org/s/T0ken", opener=_answer(_DAV))


@query("SELECT 'a/f ' || i || '.tif' AS path, CAST(10 * i AS BIGINT) AS size FROM (SELECT unnest(range(3)) AS i)")
def s24_list_folder(spark, sf_dir):
    """One folder of a share."""
    return _share().ls(spark, "a").where("not is_dir").select("path", "size")


@query("SELECT 'a/f ' || i || '.tif' AS path, CAST(10 * i AS BIGINT) AS size FROM (SELECT unnest(range(3)) AS i)")
def s25_walk(spark, sf_dir):
    """Files of a share at most so many folders down."""
    return spark.createDataFrame(_share().walk(spark, "a", 1), "path string, size long")


@query("SELECT 'one' AS first, 'one' AS second, true AS same")
def s26_download(spark, sf_dir):
    """A file that is there isn't fetched again, and a part of one is never taken for the whole."""
    dest = f"{scratch(spark, 'download').removeprefix('file://')}/x.txt"
    texts = []
    for text in ("one", "two"):
        with open(archives.download("https://files.example.org/x.txt", dest, opener=lambda url, t=text: io.BytesIO(t.encode()))) as f:
            texts.append(f.read())
    return spark.createDataFrame([(texts[0], texts[1], texts[0] == texts[1])], "first string, second string, same boolean")


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || regexp_extract(url, '^https?://([^/:?#]+)', 1) || '/public.php/webdav' AS base FROM pages")
def s28_webdav_base(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", parsing.webdav_base(F.col("url")).alias("base"))


@query("SELECT event_id, event_id % 3 <> 0 AS complete FROM events")
def s31_complete_bands(spark, sf_dir):
    """Only files of exactly a whole band's size are whole."""
    size = F.lit(archives.BAND_BYTES) - F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    return archives.complete_bands(views.table(spark, sf_dir, "events").select("event_id", size.alias("length"))).select("event_id", "complete")


def _pictures(spark: SparkSession, sf_dir: str, bands: int) -> DataFrame:
    @F.pandas_udf("binary")
    def picture(cells: pd.Series) -> pd.Series:
        import numpy as np

        return cells.map(lambda c: raster.encode(np.asarray(c, np.float32).reshape(bands, 8, -1)))

    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), picture("embedding").alias("content"))


@query("SELECT CAST(vec_id AS VARCHAR) AS path, CAST(k // 8 AS INT) AS row, CAST(k % 8 AS INT) AS col, v AS value FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS v FROM embeddings)")
def s32_single_band(spark, sf_dir):
    """Pixels of single-band pictures."""
    return raster.pixels(_pictures(spark, sf_dir, 1)).select("path", "row", "col", "value")


@query("SELECT CAST(vec_id AS VARCHAR) AS path, CAST(k // 32 AS INT) AS band, CAST(k % 32 // 4 AS INT) AS row, CAST(k % 4 AS INT) AS col, v AS value FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS v FROM embeddings)")
def s33_orthomosaic(spark, sf_dir):
    """Pixels of pictures with several bands."""
    return raster.pixels(_pictures(spark, sf_dir, 2))


_CATALOGUE = json.dumps({"success": True, "result": {"name": "soil", "results": [{"name": "soil"}, {"name": "rain"}]}})


def _catalogue() -> services.CatalogueClient:
    return services.CatalogueClient("https://data.example.org", opener=_answer(_CATALOGUE))


@query("SELECT true AS good, false AS bad")
def s34_action(spark, sf_dir):
    """Answers that aren't marked as a success are errors."""
    failed = services.CatalogueClient("https://data.example.org", opener=_answer('{"success": false, "error": "no"}'))
    return spark.createDataFrame([(configs.accepted(_catalogue().action, "status"), configs.accepted(failed.action, "status"))], "good boolean, bad boolean")


@query("SELECT * FROM (VALUES ('soil'), ('rain')) v(name)")
def s35_search(spark, sf_dir):
    return spark.createDataFrame([(d["name"],) for d in _catalogue().search()], "name string")


@query("SELECT 'cells' AS text")
def s36_resource(spark, sf_dir):
    dest = f"{scratch(spark, 'resource').removeprefix('file://')}/r.csv"
    client = services.CatalogueClient("https://data.example.org", opener=lambda url, timeout=None: io.BytesIO(b"cells"))
    with open(client.download("https://data.example.org/r.csv", dest)) as f:
        return spark.createDataFrame([(f.read(),)], "text string")


@query("SELECT 'h' || n_nationkey AS md5, CAST(n_nationkey * 10 AS BIGINT) AS size, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 1 END AS BIGINT) AS nfiles FROM nation")
def s37_manifest(spark, sf_dir):
    """Hash, size and number of files from pointer files; one file where the number isn't told."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("outs:\n- md5: h"), k, F.lit("\n  size: "), k * 10, F.when(k % 2 == 0, F.concat(F.lit("\n  nfiles: "), k)).otherwise(""), F.lit("\n  path: x\n"))
    return parsing.manifest(views.table(spark, sf_dir, "nation").select(k.cast("string").alias("path"), text.alias("value"))).select("md5", "size", "nfiles")


@query("SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY 1, 2, 3, 4")
def s38_inventory(spark, sf_dir):
    """An inventory with all columns it needs, in order of four keys."""
    path, keys = scratch(spark, "inventory"), ("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    views.table(spark, sf_dir, "lineitem").select(*keys, "l_quantity").write.parquet(path)
    return archives.inventory(spark, path, (*keys, "l_quantity"), keys)


@query(f"""{_JOINED} SELECT device, ts, round(value, 6) AS value, round(lag(value, 24) OVER w, 6) AS value_lag_24, round(avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS value_mean_6h, round(precip_mm, 6) AS precip_mm, round(gdd, 6) AS gdd FROM jw WINDOW w AS (PARTITION BY device ORDER BY ts)""")
def s39_probe_frames(spark, sf_dir):
    """All probes with their features and the weather, as one table."""
    f = features.rolling_features(features.lag_features(with_weather(spark, sf_dir), lags=(24,)), hours=(6,))
    return f.select("device", "ts", r6("value", "value"), r6("value_lag_24", "value_lag_24"), r6(F.col("value_mean_6h") + 1e-9, "value_mean_6h"), r6("precip_mm", "precip_mm"), r6("gdd", "gdd"))


@query(f"WITH {WEATHER} {_WX}")
def s40_weather_csv(spark, sf_dir):
    """Daily weather from a CSV snapshot."""
    path = scratch(spark, "weather-csv")
    views.weather_daily(spark, sf_dir).select("date", "temp_max_c", "precip_mm").write.csv(path, header=True)
    return _wx(spark.read.schema("date date, temp_max_c double, precip_mm double").csv(path, header=True))


@query("SELECT * FROM (VALUES ('horizons', '[6, 24]'), ('seed', '42')) v(key, value)")
def s41_config(spark, sf_dir):
    """Settings from a YAML file."""
    import os
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".yaml", delete=False) as f:  # the driver's own settings file
        f.write("horizons: [6, 24]\nseed: 42\n")
    try:
        found = configs.load(f.name)
    finally:
        os.unlink(f.name)
    return _pairs(spark, found)


_TILES = "(SELECT p_partkey, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM (SELECT p_partkey, p_size * 4 AS h, p_size * 3 AS w FROM part) p, (SELECT unnest(range(0, 400, 32)) AS r) rr, (SELECT unnest(range(0, 400, 32)) AS c) cc WHERE r + 32 <= h AND c + 32 <= w)"


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_partkey", F.inline(screening.tile_origins(F.col("p_size") * 4, F.col("p_size") * 3, 32)))


@query(f"SELECT p_partkey, row, col FROM {_TILES}")
def s42_patch_cache(spark, sf_dir):
    """The cache of patches, built where it isn't there."""
    return archives.cached(spark, scratch(spark, "patches"), lambda: _tiles(spark, sf_dir))


@query(f"SELECT p_partkey, CAST(least(4, count(*)) AS BIGINT) AS patches FROM {_TILES} WHERE (row + col) % 64 = 0 GROUP BY 1")
def k04_patch_cache(spark, sf_dir):
    """Valid patches in seeded order, at most four a block, written and read back."""
    order = Window.partitionBy("p_partkey").orderBy(F.xxhash64(F.lit(42), "row", "col"), "row", "col")
    few = _tiles(spark, sf_dir).where("(row + col) % 64 = 0").withColumn("r", F.row_number().over(order)).where("r <= 4").drop("r")
    path = scratch(spark, "patch-cache")
    few.write.parquet(path)
    return spark.read.parquet(path).groupBy("p_partkey").agg(F.count("*").alias("patches"))


_KNOWN = ("click", "view", "error", "purchase", "signup", "nobody")


@query("SELECT ts, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-02 00:00:00'")
def k01_bounded_ingest(spark, sf_dir):
    """One device's readings within bounds, written as its folder."""
    path = scratch(spark, "ingest")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    archives.ingest(_sensor(spark, sf_dir).where("device = 'click'"), path, list(_KNOWN), at("2024-01-01 06:00:00"), at("2024-01-02 00:00:00"))
    return archives.snapshot(spark, path, "click").select("ts", "value")


@query("SELECT d AS device, CAST(count(value) AS BIGINT) AS n FROM (SELECT unnest(['click', 'view', 'error', 'purchase', 'signup', 'nobody']) AS d) k LEFT JOIN events ON event_type = d GROUP BY 1")
def k02_ingest_all(spark, sf_dir):
    """Rows written for each known device, 0 for one that sent nothing."""
    counts = archives.ingest(_sensor(spark, sf_dir).where(F.col("device").isin(*_KNOWN)), scratch(spark, "ingest-all"), list(_KNOWN))
    return spark.createDataFrame(list(counts.items()), "device string, n long")


@query(f"WITH {WEATHER} SELECT CAST(count(*) AS BIGINT) AS n, min(date) AS first_date, max(date) AS last_date FROM wd")
def k03_weather_snapshot(spark, sf_dir):
    """A weather snapshot under the name of its span."""
    folder = scratch(spark, "wx")
    n = archives.ingest_weather(views.weather_daily(spark, sf_dir), folder)
    back = parsing.latest_file(spark, f"{folder}/weather_*.parquet/*.parquet") if n else views.weather_daily(spark, sf_dir)
    return back.agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_MAE = f"{_SCORED} SELECT device, horizon_h, model, round(avg(abs(y - pred)), 6) AS mae FROM m GROUP BY 1, 2, 3"


def _mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(spark, sf_dir).groupBy("device", "horizon_h", "model").agg(r6(F.avg(F.abs(F.col("y") - F.col("p"))), "mae"))


@query(_MAE)
def k05_csv_sink(spark, sf_dir):
    """A report table as CSV, read back."""
    path, rows = scratch(spark, "report"), _mae(spark, sf_dir)
    parsing.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query(f"WITH a AS ({_MAE}) SELECT device, horizon_h, model, 'first' AS run, 'mae' AS metric, mae AS value FROM a")
def k06_metrics_sink(spark, sf_dir):
    """A run's metrics as a long table."""
    path = scratch(spark, "metrics")
    archives.log_metrics(_mae(spark, sf_dir), path, "first", ["device", "horizon_h", "model"])
    return spark.read.parquet(path)


@query("SELECT unnest(['| r_regionkey | r_name |', '|---|---|'] || (SELECT list('| ' || r_regionkey || ' | ' || r_name || ' |' ORDER BY r_regionkey) FROM region)) AS line")
def k07_markdown(spark, sf_dir):
    """A short table as Markdown."""
    text = parsing.markdown_table(views.table(spark, sf_dir, "region").orderBy("r_regionkey"))
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("SELECT sha256('field notes' || chr(10)) AS sha256, CAST(12 AS BIGINT) AS length")
def k08_file_hash(spark, sf_dir):
    path = scratch(spark, "hash")
    spark.createDataFrame([("field notes",)], "value string").coalesce(1).write.text(path)
    return archives.file_hashes(spark, f"{path}/part-*").select("sha256", "length")


@query("SELECT * FROM (VALUES ('seven', true), ('six', false), ('twins', false)) v(name, valid)")
def e05_benchmark_manifest(spark, sf_dir):
    """A frozen benchmark has exactly seven different families."""
    f = ["a", "b", "c", "d", "e", "f", "g"]
    cases = {"seven": f, "six": f[:6], "twins": [*f[:6], "a"]}
    return spark.createDataFrame([(k, configs.accepted(configs.benchmark, v)) for k, v in cases.items()], "name string, valid boolean")


@query("SELECT * FROM (VALUES ('good', true), ('short', false), ('falling', false), ('edge', false)) v(name, valid)")
def r30_classifier_settings(spark, sf_dir):
    """Channels have names, quantiles ascend within (0, 1)."""
    cases = {"good": (2, ("ndvi", "ndre"), (0.33, 0.66)), "short": (3, ("ndvi", "ndre"), (0.5,)), "falling": (1, ("ndvi",), (0.6, 0.3)), "edge": (1, ("ndvi",), (0.0, 0.5))}
    return spark.createDataFrame([(k, configs.accepted(configs.Classifier, *v)) for k, v in cases.items()], "name string, valid boolean")


@query("SELECT p_partkey, p_size % 3 + p_size % 2 > 0 AS valid FROM part")
def r31_weights(spark, sf_dir):
    """Weights that add up to nothing are refused."""
    rows = views.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("a"), (F.col("p_size") % 2).alias("b"))
    check = F.udf(lambda a, b: configs.accepted(configs.Weights, a, b), "boolean")
    few = rows.select("a", "b").distinct().withColumn("valid", check("a", "b"))  # six kinds of weights
    return rows.join(few, ["a", "b"]).select("p_partkey", "valid")


@query("SELECT * FROM (VALUES ('bloom', true), ('point', true), ('backwards', false)) v(name, valid)")
def r32_phases(spark, sf_dir):
    """A phase doesn't end before it starts."""
    cases = {"bloom": (300.0, 350.0), "point": (5.0, 5.0), "backwards": (9.0, 3.0)}
    return spark.createDataFrame([(k, configs.accepted(configs.Band, k, *v)) for k, v in cases.items()], "name string, valid boolean")


@query("SELECT false AS without_token, true AS with_token")
def r23_series_client(spark, sf_dir):
    """No series without a token."""
    make = lambda t: configs.accepted(services.SeriesClient, "https://series.example.org", t, "org", "probes")
    return spark.createDataFrame([(make(None), make("t"))], "without_token boolean, with_token boolean")


@query("SELECT 'POST' AS method, 'https://series.example.org/api/v2/query?org=field' AS url, true AS authorized")
def r24_series_request(spark, sf_dir):
    """What the series client sends."""
    r = services.SeriesClient("https://series.example.org", "t", "field", "probes").request("dev1", ["click"])
    return spark.createDataFrame([(r.get_method(), r.full_url, r.get_header("Authorization") == "Token t")], "method string, url string, authorized boolean")


@query("SELECT 'T0ken' AS token, 'https://share.example.org/public.php/webdav' AS base")
def r25_share_client(spark, sf_dir):
    c = _share()
    return spark.createDataFrame([(c.token, c.base)], "token string, base string")


@query("SELECT n_nationkey, 'https://share.example.org/public.php/webdav/a%20b/' || n_nationkey || '%2B.tif' AS url FROM nation")
def r26_quoted_urls(spark, sf_dir):
    """Paths of a share as URLs."""
    rows = views.table(spark, sf_dir, "nation").select("n_nationkey")
    path = F.concat(F.lit("a b/"), "n_nationkey", F.lit("+.tif"))
    quoted = F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return rows.select("n_nationkey", F.concat(F.lit(_share().url()), quoted).alias("url"))


@query("SELECT 'https://data.example.org/api/3/action/package_show?id=soil' AS url")
def r27_catalogue_client(spark, sf_dir):
    return spark.createDataFrame([(archives.ckan_url(_catalogue().base_url, "package_show", id="soil"),)], "url string")


@query("SELECT * FROM (VALUES ('soil'), ('rain')) v(name)")
def r28_organization(spark, sf_dir):
    return spark.createDataFrame([(d["name"],) for d in _catalogue().organization("field")], "name string")


@query("SELECT 'soil' AS name")
def r29_dataset(spark, sf_dir):
    return spark.createDataFrame([(_catalogue().dataset("soil")["name"],)], "name string")


@query("SELECT * FROM (VALUES ('events', true), ('orders', true), ('missing', false)) v(name, present)")
def r20_inputs(spark, sf_dir):
    """Which inputs are there."""
    import pyspark.errors

    def there(name: str) -> bool:
        try:
            return bool(views.table(spark, sf_dir, name).columns)
        except pyspark.errors.AnalysisException:
            return False

    return spark.createDataFrame([(n, there(n)) for n in ("events", "orders", "missing")], "name string, present boolean")


@query("SELECT 'tilth 0.1' AS version")
def g09_command_line(spark, sf_dir):
    """The command line's version."""
    import contextlib

    from .serving import main

    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        main(["version"])
    return spark.createDataFrame([(said.getvalue().strip(),)], "version string")


@query("SELECT CAST(42 AS BIGINT) AS seed, true AS repeats")
def g10_seeding(spark, sf_dir):
    """One seed, one order."""
    order = lambda seed: [r[0] for r in spark.range(20).orderBy(F.xxhash64(F.lit(seed), "id")).collect()]
    return spark.createDataFrame([(42, order(42) == order(42) and order(42) != order(43))], "seed long, repeats boolean")


@query(f"WITH {_SEASON} SELECT season, CAST(count(*) AS BIGINT) AS days, CAST(max(missing) AS BIGINT) AS missing, round(max(cumulative), 5) AS total, max(missing) > 0 AS partial FROM cu GROUP BY 1")
def g04_season_exploration(spark, sf_dir):
    """Each season's sum, and whether days of it are missing."""
    from .plots import season_rows

    return season_rows(spark, sf_dir).groupBy("season").agg(F.count("*").alias("days"), F.max("missing").alias("missing"), F.round(F.max("cumulative"), 5).alias("total"), (F.max("missing") > 0).alias("partial"))

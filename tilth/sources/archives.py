"""Snapshots, caches, shares and geometry files."""

from __future__ import annotations

import os
import tempfile
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsing import kmz_texts, placemarks, write_by_device

#: Fixed value: bytes of one complete band file of the camera in use.
BAND_BYTES = 10087424


def snapshot(spark: SparkSession, path: str, device: str | None = None) -> DataFrame:
    """A sensor snapshot; one device reads one folder."""
    rows = spark.read.parquet(path)
    return rows if device is None else rows.where(F.col("device") == device)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written first if it isn't there yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ingest(rows: DataFrame, path: str, known: list[str], start=None, stop=None) -> dict[str, int]:
    """Writes readings of known devices within bounds, a folder a device, and returns rows by device (0 for none). An
    unknown device among the rows is an error."""
    strange = [r[0] for r in rows.select("device").where(~F.col("device").isin(known)).distinct().limit(5).collect()]
    if strange:
        raise ValueError(f"unknown devices: {', '.join(map(str, strange))}")
    kept = rows.where(F.col("ts") >= start) if start is not None else rows
    kept = kept.where(F.col("ts") < stop) if stop is not None else kept
    write_by_device(kept, path)
    counts = {r["device"]: r["n"] for r in rows.sparkSession.read.parquet(path).groupBy("device").agg(F.count("*").alias("n")).collect()}
    return {d: counts.get(d, 0) for d in known}


def ingest_weather(daily: DataFrame, folder: str) -> int:
    """Writes ``weather_<first>_<last>.parquet`` and returns its rows."""
    span = daily.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n")).first()
    if span["n"]:
        daily.coalesce(1).write.mode("overwrite").parquet(f"{folder}/weather_{span['a']}_{span['b']}.parquet")
    return span["n"]


def log_metrics(results: DataFrame, path: str, run: str, keys: list[str]) -> None:
    """Appends a run's metrics as a long table (run, keys, metric, value)."""
    metrics = [c for c, t in results.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    cast = results.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    cast.unpivot(keys, metrics, "metric", "value").withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256)."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def walk(spark: SparkSession, root: str, most_depth: int = 10) -> DataFrame:
    """(path, length) of files at most ``most_depth`` folders below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    depth = F.size(F.split(F.regexp_replace("path", rf"^.*?{base}/", ""), "/")) - 1
    return files.where(depth <= most_depth)


def download(url: str, dest: str, skip_existing: bool = True, opener=urllib.request.urlopen) -> str:
    """Fetches a file under a name of its own first, so that a part of it is never taken for the whole."""
    if skip_existing and os.path.exists(dest):
        return dest
    os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
    handle, part = tempfile.mkstemp(suffix=".part", dir=os.path.dirname(dest) or ".")
    with os.fdopen(handle, "wb") as out, opener(url) as data:
        while block := data.read(1 << 20):
            out.write(block)
    os.replace(part, dest)
    return dest


def ckan_result(payload: dict):
    """The result of a catalogue answer; one that isn't marked as a success is an error."""
    if not payload.get("success"):
        raise ValueError(f"catalogue error: {payload.get('error')}")
    return payload["result"]


def ckan_url(base: str, action: str, **params) -> str:
    return f"{base.rstrip('/')}/api/3/action/{action}?{urllib.parse.urlencode(sorted(params.items()))}"


def complete_bands(files: DataFrame, size: int = BAND_BYTES) -> DataFrame:
    """``files`` (with length) with ``complete``: exactly the size of a whole band."""
    return files.withColumn("complete", F.col("length") == size)


def index_flights(paths: DataFrame, cameras: tuple[str, ...], column: str = "path") -> DataFrame:
    """(block, date, camera, path): flights of the cameras in use from ``.../<block>/<yyyymmdd...>/<camera>/...``; of
    several for one key the last path counts."""
    p = F.split(F.btrim(F.col(column), F.lit("/")), "/")
    n = F.size(p)
    rows = paths.select(F.get(p, n - 4).alias("block"), F.regexp_extract(F.get(p, n - 3), r"(\d{8})", 1).alias("date"), F.get(p, n - 2).alias("camera"), F.col(column).alias("path"))
    good = rows.where((F.col("date") != "") & F.col("block").isNotNull() & F.col("camera").isin(*cameras))
    return good.groupBy("block", "date", "camera").agg(F.max("path").alias("path"))


def blocks_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, ring) from a GeoJSON collection of polygons; features without block_id are an error."""
    schema = "features array<struct<properties: struct<block_id: string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    f = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    block = F.when(F.col("f.properties.block_id").isNull(), F.raise_error(F.lit("feature without block_id"))).otherwise(F.col("f.properties.block_id"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat")))
    return f.select(block.alias("block_id"), ring.alias("ring"))


def geometry_kmz(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(name, kind, coords) of a KML or KMZ file's polygons or points."""
    return placemarks(kmz_texts(spark.read.format("binaryFile").load(path)), "kml").where(F.col("kind") == kind)


def inventory(spark: SparkSession, path: str, required: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    rows = spark.read.parquet(path)
    if missing := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"inventory lacks {', '.join(missing)}")
    return rows.orderBy(*order)

"""Texts of the services and archives that data come from: query text, JSON, KML, WebDAV, file names."""

from __future__ import annotations

import io
import itertools
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def flux_query(device: str, measurements: list[str], bucket: str, start: str = "-1w", stop: str | None = None) -> str:
    """Flux text for one device's measurements, pivoted to a column each."""
    wanted = " or ".join(f'r._measurement == "{m}"' for m in measurements)
    until = f", stop: {stop}" if stop else ""
    return "\n".join(
        [
            f'from(bucket: "{bucket}")',
            f"  |> range(start: {start}{until})",
            f'  |> filter(fn: (r) => r.device_name == "{device}")',
            f"  |> filter(fn: (r) => {wanted})",
            '  |> pivot(rowKey: ["_time"], columnKey: ["_measurement"], valueColumn: "_value")',
        ]
    )


def pivoted(rows: DataFrame, device: str, names: list[str], start=None, stop=None) -> DataFrame:
    """What that query answers, over a long table (device, ts, measurement, value): a row a time, a column a
    measurement, values that aren't numbers missing. Of several numbers of one time the largest counts, whatever their order."""
    kept = rows.where((F.col("device") == device) & F.col("measurement").isin(names))
    kept = kept.where(F.col("ts") >= start) if start is not None else kept
    kept = kept.where(F.col("ts") < stop) if stop is not None else kept
    return kept.groupBy("device", "ts").pivot("measurement", names).agg(F.max(F.expr("try_cast(value as double)")))


def aliased(rows: DataFrame, default: dict[str, str], override: dict[tuple[str, str], str]) -> DataFrame:
    """``rows`` with measurements renamed: a device's own meaning of a raw name first, then the general one, else as is."""
    spark = rows.sparkSession
    own = spark.createDataFrame([(d, m, n) for (d, m), n in override.items()], "device string, measurement string, _own string")
    every = spark.createDataFrame(list(default.items()), "measurement string, _any string")
    named = rows.join(F.broadcast(own), ["device", "measurement"], "left").join(F.broadcast(every), "measurement", "left")  # catalogue tables
    return named.withColumn("measurement", F.coalesce("_own", "_any", "measurement")).drop("_own", "_any")


def place(lat: float, lon: float, timezone: str = "UTC") -> dict:
    """Where a weather request asks for. The keys here and below are the service's."""
    return {"latitude": lat, "longitude": lon, "timezone": timezone}


def archive_params(start: str, end: str, lat: float, lon: float, daily: tuple[str, ...], timezone: str = "UTC") -> dict:
    """Past days from ``start`` to ``end``, both included."""
    return place(lat, lon, timezone) | {"start_date": start, "end_date": end, "daily": ",".join(daily)}


def forecast_params(days: int, lat: float, lon: float, daily: tuple[str, ...], timezone: str = "UTC") -> dict:
    if days not in range(1, 17):
        raise ValueError(f"{days} days: a forecast runs for 1 to 16")
    return place(lat, lon, timezone) | {"forecast_days": days, "daily": ",".join(daily)}


def previous_runs_params(start: str, end: str, lat: float, lon: float, hourly: tuple[str, ...], lag_days: tuple[int, ...] = (1, 2), timezone: str = "UTC") -> dict:
    """Hours as forecast some days before, a column for each variable and age."""
    aged = itertools.product(hourly, lag_days)
    return place(lat, lon, timezone) | {"start_date": start, "end_date": end, "hourly": ",".join(itertools.starmap("{}_previous_day{}".format, aged))}


def daily_payload(payloads: DataFrame, names: dict[str, str], column: str = "payload") -> DataFrame:
    """(date, *names): rows of ``{"daily": {"time": [...], "<raw>": [...]}}``; a payload without that block is an error."""
    fields = ", ".join(f"`{raw}`: array<double>" for raw in names)
    block = F.from_json(column, f"struct<daily: struct<`time`: array<string>, {fields}>>")["daily"]
    found = payloads.select(F.when(block.isNull(), F.raise_error(F.lit("payload without daily block"))).otherwise(block).alias("d"))
    rows = found.select(F.inline(F.arrays_zip("d.time", *[f"d.{raw}" for raw in names])))
    return rows.select(F.to_date("time").alias("date"), *[F.col(raw).alias(n) for raw, n in names.items()])


def vintage_name(raw: str) -> str | None:
    """``precipitation_previous_day2`` -> ``precipitation_prev2``; None for other names."""
    m = re.fullmatch(r"(.+)_previous_day(\d+)", raw)
    return f"{m[1]}_prev{m[2]}" if m else None


def hourly_payload(payloads: DataFrame, raws: list[str], column: str = "payload") -> DataFrame:
    """(ts, *vintages): rows of ``{"hourly": {"time": [...], "<variable>_previous_day<n>": [...]}}``; a payload without
    that block is an error, and a name that isn't a vintage's is left out."""
    names = {r: v for r in raws if (v := vintage_name(r))}
    fields = ", ".join(f"`{raw}`: array<double>" for raw in names)
    block = F.from_json(column, f"struct<hourly: struct<`time`: array<string>, {fields}>>")["hourly"]
    found = payloads.select(F.when(block.isNull(), F.raise_error(F.lit("payload without hourly block"))).otherwise(block).alias("h"))
    rows = found.select(F.inline(F.arrays_zip("h.time", *[f"h.{raw}" for raw in names])))
    return rows.select(F.col("time").cast("timestamp_ntz").alias("ts"), *[F.col(raw).alias(n) for raw, n in names.items()])


def placemarks(texts: DataFrame, column: str = "kml") -> DataFrame:
    """(name, kind, coords array<struct<lon, lat>>) of the points and polygons of KML texts; other geometry is skipped."""
    marks = texts.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<(?:\w+:)?Placemark[\s>].*?</(?:\w+:)?Placemark>"), F.lit(0))).alias("m"))
    tag = lambda t: F.regexp_extract("m", rf"(?s)<(?:\w+:)?{t}[^>]*>(.*?)</(?:\w+:)?{t}>", 1)
    kind = F.when(F.col("m").rlike(r"<(?:\w+:)?Polygon"), "polygon").when(F.col("m").rlike(r"<(?:\w+:)?Point"), "point")
    pairs = F.filter(F.split(F.btrim(tag("coordinates"), F.lit(" \t\r\n")), r"\s+"), lambda p: p != "")

    def point(p: Column) -> Column:
        xy = F.split(p, ",")
        return F.struct(F.get(xy, F.lit(0)).cast("double").alias("lon"), F.get(xy, F.lit(1)).cast("double").alias("lat"))

    return marks.select(F.trim(tag("name")).alias("name"), kind.alias("kind"), F.transform(pairs, point).alias("coords")).where("kind is not null")


def kmz_texts(files: DataFrame) -> DataFrame:
    """(path, kml) of binaryFile rows: the first KML in a zip, or the file itself."""
    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        def one(data: bytes) -> str:
            if data[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    data = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))
            return data.decode("utf-8")

        return content.map(one)

    return files.select("path", text("content").alias("kml"))


def propfind(texts: DataFrame, root: Column, column: str = "xml") -> DataFrame:
    """(path, is_dir, size) of the entries of WebDAV answers, relative to ``root``, without the folder itself."""
    answers = texts.select(root.alias("_root"), F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<(?:\w+:)?response[\s>].*?</(?:\w+:)?response>"), F.lit(0))).alias("r"))
    href = F.url_decode(F.regexp_extract("r", r"(?s)<(?:\w+:)?href[^>]*>(.*?)</(?:\w+:)?href>", 1))
    rel = F.btrim(F.regexp_replace(href, F.concat(F.lit("^.*?"), F.col("_root")), F.lit("")), F.lit("/"))
    size = F.expr("try_cast(nullif(regexp_extract(r, '(?s)<(?:\\\\w+:)?getcontentlength[^>]*>(\\\\d+)<', 1), '') as bigint)")
    return answers.select(rel.alias("path"), F.col("r").rlike(r"<(?:\w+:)?collection\s*/?>").alias("is_dir"), size.alias("size")).where("path <> ''")


def share_token(url: Column) -> Column:
    return F.regexp_extract(F.parse_url(url, F.lit("PATH")), r"/s/([^/]+)", 1)


def webdav_base(url: Column) -> Column:
    return F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("HOST")), F.lit("/public.php/webdav"))


#: The camera's file names (time to the second, sequence, kind of picture, way point) and its bands' names.
CAPTURE = r"DJI_(\d{14})_(\d{4})_(D|MS_G|MS_R|MS_RE|MS_NIR)_point(\d+)\.(?:JPG|TIF)$"
BANDS = {"MS_G": "green", "MS_R": "red", "MS_RE": "red_edge", "MS_NIR": "nir"}


def capture_fields(name: Column) -> dict[str, Column]:
    """Time, sequence, kind and way point of a capture's file name; all null if it isn't one, as with sidecar files."""
    part = lambda i: F.when(name.rlike(CAPTURE), F.regexp_extract(name, CAPTURE, i))
    return {"taken": part(1), "seq": part(2), "tag": part(3), "point": part(4).cast("int")}


def group_captures(files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """(taken, seq, point, bands map, rgb): one row for each capture; kind D is the colour picture. Of several files for
    one band the last path counts."""
    named = F.create_map(*[F.lit(x) for pair in BANDS.items() for x in pair])
    f = capture_fields(F.col(name))
    rows = files.select(F.col(path).alias("path"), *[c.alias(k) for k, c in f.items()]).where("taken is not null").withColumn("band", named[F.col("tag")])
    each = rows.groupBy("taken", "seq", "tag", "band").agg(F.max("path").alias("path"), F.min("point").alias("point"))
    return each.groupBy("taken", "seq").agg(
        F.min("point").alias("point"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("band").isNotNull(), F.struct("band", "path"))))).alias("bands"), F.max(F.when(F.col("tag") == "D", F.col("path"))).alias("rgb")
    )


def read_sensor_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True).orderBy("timestamp")


def latest_file(spark: SparkSession, pattern: str) -> DataFrame | None:
    """The last file by name that matches, or None. Names are listed by Spark, so any store it reads will do."""
    try:
        files = spark.read.format("binaryFile").load(pattern).select("path")
    except Exception as e:  # no such path
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    last = files.agg(F.max("path").alias("p")).first()["p"]
    return spark.read.parquet(last) if last else None


def manifest(texts: DataFrame) -> DataFrame:
    """(path, md5, size, nfiles) of data-version pointer files (wholetext rows path, value); nfiles is 1 if not told."""
    get = lambda k: F.regexp_extract("value", rf"(?m)^[\s-]*{k}:\s*(\S+)", 1)
    number = lambda k: F.expr(f"try_cast(nullif(regexp_extract(value, '(?m)^[\\\\s-]*{k}:\\\\s*(\\\\S+)', 1), '') as bigint)")
    return texts.select("path", get("md5").alias("md5"), number("size").alias("size"), F.coalesce(number("nfiles"), F.lit(1)).alias("nfiles"))


def write_by_device(df: DataFrame, path: str, key: str = "device") -> None:
    """Parquet, a folder for each device, so that one device is read alone."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


#: To the microsecond; the format left unset would cut them off.
MICROS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def write_csv(df: DataFrame, path: str) -> None:
    """A report table: one CSV file with a head line."""
    df.coalesce(1).write.mode("overwrite").options(timestampNTZFormat=MICROS, timestampFormat=MICROS).csv(path, header=True)


def markdown_table(df: DataFrame, formats: dict[str, str] | None = None, rows: int = 1000) -> str:
    """A short result as Markdown."""
    cols = df.columns
    show = lambda c, v: "" if v is None else format(v, (formats or {}).get(c, ""))
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join(show(c, r[c]) for c in cols) + " |" for r in df.limit(rows).collect()])

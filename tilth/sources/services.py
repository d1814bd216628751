"""Clients of the services that data come from. Each takes an ``opener`` with urlopen's signature, so that it can be run
against a recorded answer."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, parsing

Opener = Callable


def read_json(url: str, params: dict, opener: Opener = urllib.request.urlopen, headers: dict | None = None, timeout: float = 30.0) -> str:
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}" if params else url, headers=headers or {})
    with opener(request, timeout=timeout) as answer:
        return answer.read().decode()


def fetch_daily(spark: SparkSession, url: str, params: dict, names: dict[str, str], opener: Opener = urllib.request.urlopen) -> DataFrame:
    """(date, *names) of an archive or forecast answer (parameters by parsing.archive_params or forecast_params)."""
    text = read_json(url, params, opener)
    return parsing.daily_payload(spark.createDataFrame([(text,)], "payload string"), names)


def fetch_vintages(spark: SparkSession, url: str, params: dict, opener: Opener = urllib.request.urlopen) -> DataFrame:
    """(ts, <variable>_prev<days>...) of archived forecasts (parameters by parsing.previous_runs_params)."""
    text = read_json(url, params, opener, timeout=60.0)
    return parsing.hourly_payload(spark.createDataFrame([(text,)], "payload string"), params["hourly"].split(","))


class SeriesClient:
    """A time-series service; without a token there is none."""

    def __init__(self, url: str, token: str | None, org: str, bucket: str, opener: Opener = urllib.request.urlopen):
        if not token:
            raise ValueError("a token is needed to read series")
        self.url, self.token, self.org, self.bucket, self.opener = url.rstrip("/"), token, org, bucket, opener

    def request(self, device: str, measurements: list[str], start: str = "-1w", stop: str | None = None) -> urllib.request.Request:
        text = parsing.flux_query(device, measurements, self.bucket, start, stop)
        kind = {"Authorization": f"Token {self.token}", "Content-Type": "application/vnd.flux", "Accept": "application/csv"}
        return urllib.request.Request(f"{self.url}/api/v2/query?{urllib.parse.urlencode({'org': self.org})}", text.encode(), kind)

    def read(self, spark: SparkSession, device: str, measurements: list[str], start: str = "-1w", stop: str | None = None) -> DataFrame:
        """(_time, *measurements) as numbers; bookkeeping columns are dropped."""
        with self.opener(self.request(device, measurements, start, stop), timeout=60.0) as answer:
            lines = [x for x in answer.read().decode().splitlines() if x and not x.startswith("#")]
        rows = spark.read.csv(spark.sparkContext.parallelize(lines, 1), header=True) if lines else spark.createDataFrame([], "_time string")
        wanted = [m for m in measurements if m in rows.columns]
        return rows.select(F.col("_time").cast("timestamp").alias("ts"), *[F.expr(f"try_cast(`{m}` as double)").alias(m) for m in wanted])


class CatalogueClient:
    """A data catalogue's actions."""

    def __init__(self, base_url: str, api_key: str | None = None, timeout: float = 30.0, opener: Opener = urllib.request.urlopen):
        self.base_url, self.timeout, self.opener = base_url, timeout, opener
        self.headers = {"Authorization": api_key} if api_key else {}

    def action(self, name: str, **params):
        return archives.ckan_result(json.loads(read_json(archives.ckan_url(self.base_url, name, **params), {}, self.opener, self.headers, self.timeout)))

    def search(self, query: str = "vineyard", rows: int = 50) -> list[dict]:
        return self.action("package_search", q=query, rows=rows)["results"]

    def organization(self, org: str, rows: int = 100) -> list[dict]:
        return self.action("package_search", fq=f"organization:{org}", rows=rows)["results"]

    def dataset(self, name: str) -> dict:
        return self.action("package_show", id=name)

    def download(self, url: str, dest: str) -> str:
        return archives.download(url, dest, opener=self.opener)


class ShareClient:
    """A public share, listed over WebDAV."""

    def __init__(self, share_url: str, timeout: float = 60.0, opener: Opener = urllib.request.urlopen):
        parts = urllib.parse.urlsplit(share_url)
        self.token = parts.path.rstrip("/").rsplit("/s/", 1)[-1]
        self.base, self.timeout, self.opener = f"{parts.scheme}://{parts.netloc}/public.php/webdav", timeout, opener

    def url(self, path: str = "") -> str:
        return f"{self.base}/{urllib.parse.quote(path.strip('/'))}"

    def ls(self, spark: SparkSession, path: str = "") -> DataFrame:
        """(path, is_dir, size) of a folder's entries."""
        request = urllib.request.Request(self.url(path), headers={"Depth": "1"}, method="PROPFIND")
        with self.opener(request, timeout=self.timeout) as answer:
            xml = answer.read().decode()
        root = urllib.parse.urlsplit(self.base).path
        rows = parsing.propfind(spark.createDataFrame([(xml,)], "xml string"), F.lit(root))
        return rows.where(F.col("path") != path.strip("/"))

    def walk(self, spark: SparkSession, path: str = "", most_depth: int = 10) -> list[tuple[str, int]]:
        """(path, size) of all files at most so many folders down. A listing is a request to the service, made one by one."""
        out: list[tuple[str, int]] = []
        for r in self.ls(spark, path).orderBy("path").collect():  # a folder's entries
            if not r["is_dir"]:
                out.append((r["path"], r["size"]))
            elif most_depth > 0:
                out += self.walk(spark, r["path"], most_depth - 1)
        return out

    def download(self, path: str, dest: str, skip_existing: bool = True) -> str:
        return archives.download(self.url(path), dest, skip_existing, self.opener)

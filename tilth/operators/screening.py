"""Zonal statistics of raster cells, stress ranking, and points in polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zonal_stats(cells: DataFrame, zones: DataFrame, zone: str = "zone", value: str = "value") -> DataFrame:
    """(zone, mean, std, count): population deviation; a zone without cells has nulls and 0."""
    stats = cells.groupBy(zone).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("count"))
    return zones.select(zone).join(stats, zone, "left").fillna(0, ["count"])


def zonal_distribution(cells: DataFrame, zones: DataFrame, quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75), low: float | None = None, zone: str = "zone", value: str = "value") -> DataFrame:
    """zonal_stats() with coverage (valid cells among all), quantiles named qNN, their spread q75 - q25 and the share of
    cells strictly under ``low``."""
    if any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie in [0, 1]")
    qs = sorted({*quantiles, 0.25, 0.75})
    stats = cells.groupBy(zone).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("count"), (F.count(value) / F.count("*")).alias("coverage"),
        F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("_q"), *([F.avg((F.col(value) < low).cast("double")).alias("fraction_below")] if low is not None else []),
    )
    named = {q: F.get("_q", F.lit(i)) for i, q in enumerate(qs)}
    stats = stats.select("*", *[named[q].alias(f"q{round(q * 100):02d}") for q in quantiles], (named[0.75] - named[0.25]).alias("iqr")).drop("_q")
    return zones.select(zone).join(stats, zone, "left").fillna(0, ["count"]).fillna(0.0, ["coverage"])


def concern_percentile(value: str, among: Column) -> Column:
    """Average-rank percentile among the rows ``among`` holds for; the lowest value is of highest concern. The ranked
    table has one row a zone."""
    v = F.when(among, F.col(value))
    part = Window.partitionBy(v.isNotNull())
    lower = F.rank().over(part.orderBy(v.desc()))
    ties = F.count(v).over(Window.partitionBy(v))
    n = F.count(v).over(Window.partitionBy())
    return F.when(v.isNotNull(), (lower + (ties - 1) / 2) / n)


def rank_stress(ndvi: DataFrame, ndre: DataFrame, weights: tuple[float, float] = (0.6, 0.4), least_coverage: float = 0.8, least_count: int = 1, disagree: float = 0.3, zone: str = "zone") -> DataFrame:
    """Zones by weighted concern of two indices. Zones short of coverage or cells in either index take no part: no
    percentile, score, rank or verdict. Ranks of equals are the smallest."""
    both = ndvi.select(zone, *[F.col(c).alias(f"ndvi_{c}") for c in ndvi.columns if c != zone]).join(
        ndre.select(zone, *[F.col(c).alias(f"ndre_{c}") for c in ndre.columns if c != zone]), zone, "full"
    )
    ok = F.lit(True)
    for i in ("ndvi", "ndre"):
        ok = ok & F.coalesce((F.col(f"{i}_coverage") >= least_coverage) & (F.col(f"{i}_count") >= least_count) & F.col(f"{i}_mean").isNotNull(), F.lit(False))
    gated = both.withColumn("quality_ok", ok)
    for i in ("ndvi", "ndre"):
        gated = gated.withColumn(f"{i}_concern", concern_percentile(f"{i}_mean", F.col("quality_ok")))
    score = weights[0] * F.col("ndvi_concern") + weights[1] * F.col("ndre_concern")
    scored = gated.withColumn("score", score)
    place = F.when(F.col("quality_ok"), F.rank().over(Window.partitionBy("quality_ok").orderBy(F.desc("score"))))
    return scored.withColumn("rank", place).withColumn("disagreement", F.when(F.col("quality_ok"), F.abs(F.col("ndvi_concern") - F.col("ndre_concern")) >= disagree))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b + 1e-8) within [-1, 1], in single precision."""
    a, b = a.cast("float"), b.cast("float")
    return F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), ((a - b) / (a + b + F.lit(1e-8).cast("float"))).cast("float")))


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndre(nir: Column, red_edge: Column) -> Column:
    return normalized_difference(nir, red_edge)


def stacked_channels(r: Column, g: Column, b: Column, nir: Column, re: Column) -> Column:
    """R, G, B, NIR, RE, NDVI, NDRE."""
    return F.array(*[c.cast("float") for c in (r, g, b, nir, re)], ndvi(nir, r), ndre(nir, re))


def digitize(v: Column, thresholds: list[float]) -> Column:
    """Class of a value among ascending thresholds; equal goes to the higher class."""
    if sorted(thresholds) != list(thresholds):
        raise ValueError("thresholds must ascend")
    return sum((F.when(v >= t, 1).otherwise(0) for t in thresholds), F.lit(0))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies inside a ring of (lon, lat) structs, by crossings of a ray to the right."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["lat"] > y) != (b["lat"] > y)
        at = (b["lon"] - a["lon"]) * (y - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lon"]
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, c: s + c) % 2 == 1


def assign_to_polygons(points: DataFrame, polygons: DataFrame, cell: float = 1.0, id_col: str = "name", poly_id: str = "block_id") -> DataFrame:
    """(points, block_id): each point with the polygon around it, or null. Polygons are filed under the grid cells that
    their bounding boxes touch, so points meet only polygons near them by an equi-join."""
    lo = lambda c: F.floor(F.array_min(F.transform("ring", lambda p: p[c])) / cell)
    hi = lambda c: F.floor(F.array_max(F.transform("ring", lambda p: p[c])) / cell)
    filed = polygons.withColumn("_x", F.explode(F.sequence(lo("lon"), hi("lon")))).withColumn("_y", F.explode(F.sequence(lo("lat"), hi("lat"))))
    at = points.withColumn("_x", F.floor(F.col("lon") / cell)).withColumn("_y", F.floor(F.col("lat") / cell))
    inside = at.join(filed, ["_x", "_y"]).where(contains(F.col("ring"), F.col("lon"), F.col("lat")))
    one = inside.groupBy(id_col).agg(F.min(poly_id).alias(poly_id))
    return points.join(one, id_col, "left")


def tile_origins(height: Column, width: Column, size: int) -> Column:
    """Array of (row, col) of whole tiles; partial ones at the edges are dropped."""
    rows = F.when(height >= size, F.sequence(F.lit(0), height - size, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cols = F.when(width >= size, F.sequence(F.lit(0), width - size, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("row"), c.alias("col")))))


def split_groups(keys: DataFrame, key: str, val_fraction: float, seed: int) -> DataFrame:
    """(key, split): whole groups for training or validation by seeded hash order, one at least on each side."""
    ids = keys.select(key).distinct()
    n = ids.count()
    if n < 2:
        raise ValueError("two groups are needed to split")
    k = min(max(round(n * val_fraction), 1), n - 1)
    place = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), key), key))  # a row a group
    return ids.withColumn("split", F.when(place <= k, "val").otherwise("train"))

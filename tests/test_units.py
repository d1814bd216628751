"""Kernels, folds, models and parsers against closed forms and small cases."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tilth.functions import kernels, models
from tilth.operators import features, folds, screening
from tilth.sources import parsing


@given(st.integers(20, 500), st.integers(1, 6))
def test_folds_tile_the_second_half(n, k):
    bounds = folds.fold_bounds(n, k)
    assert bounds[0][0] == n // 2 and bounds[-1][1] == n
    assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(bounds, bounds[1:]))


def test_too_few_rows_for_folds():
    with pytest.raises(ValueError):
        folds.fold_bounds(6, 5)


def test_vintage_lag():
    assert [features.freshest_age(h) for h in (1, 24, 25, 48)] == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        features.freshest_age(0)


def test_crps_of_a_gaussian_matches_its_sample():
    sample = np.random.default_rng(1).normal(2, 3, 20_000)
    a = kernels.empirical_crps(sample, [0.0, 2.0, 9.0])
    b = kernels.gaussian_crps([0.0, 2.0, 9.0], [2.0] * 3, [3.0] * 3)
    assert np.allclose(a, b, atol=0.05)
    assert kernels.gaussian_crps([3.0], [1.0], [0.0])[0] == 2.0
    with pytest.raises(ValueError):
        kernels.gaussian_crps([0.0], [0.0], [-1.0])


def test_crossing_probability_against_simulation():
    rng = np.random.default_rng(2)
    paths = 4 + np.cumsum(rng.normal(-0.1 / 20, 1 / np.sqrt(20), (4000, 24 * 20)), axis=1)
    assert abs((paths.min(1) < 0).mean() - kernels.crossing_probability([4.0], 0.0, 24, -0.1, 1.0)[0]) < 0.05
    assert kernels.crossing_probability([-1.0], 0.0, 24, 0.0, 1.0)[0] == 1.0
    assert np.isnan(kernels.crossing_probability([np.nan], 0.0, 24, 0.0, 1.0)[0])


def test_exercise_boundary_falls_as_cost_rises():
    inc = kernels.gaussian_increments(-0.1, 1.0, 64)
    cheap, dear = (kernels.exercise_boundary(inc, 0.0, 12, c, 10.0) for c in (0.05, 0.4))
    assert (cheap >= dear - 1e-9).all()
    late = kernels.exercise_boundary(inc, 0.0, 12, 0.1, 10.0, delay=4)
    assert late.shape == (12,)


def test_models_keep_the_contract():
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300)})
    y = 2 * x["a"].to_numpy() - x["b"].to_numpy() + 0.01 * rng.normal(size=300)
    x.loc[5, "a"] = np.nan
    test = x.iloc[250:]
    for make in (models.ridge(), models.gbt(rounds=60), models.forest(20)):
        p = make(x.iloc[:250], y[:250], test)
        assert np.corrcoef(p, y[250:])[0, 1] > 0.8
    assert np.isnan(models.ridge()(x.iloc[:5], y[:5], test)).all()


def test_water_balance_keeps_persistence_unless_it_wins():
    n = 200
    x = pd.DataFrame({"last": np.arange(n, dtype=float), "et0": np.zeros(n), "precip": np.zeros(n)})
    p = models.water_balance(24)(x.iloc[:150], x["last"].to_numpy()[:150], x.iloc[150:])
    assert (p == x["last"].to_numpy()[150:]).all()


def test_hazard_is_a_probability_and_none_when_all_agree():
    x = models.hazard_design(np.arange(1, 101) % 24 + 1, np.arange(100) % 24, np.zeros(100), np.ones(100))
    assert x.shape == (100, 9)
    assert models.logistic_hazard(x, np.zeros(100, bool)) is None
    h = models.logistic_hazard(x, np.arange(100) % 3 == 0)(x)
    assert ((h > 0) & (h < 1)).all()


def test_rise_needs_clear_sides(spark):
    from tilth.operators import events

    rows = [("a", f"2024-01-01 {h:02d}:00:00", v) for h, v in enumerate([5.0, 5.0, 7.0, 9.0, 9.0, None, 1.0, 3.0, 3.0])]
    g = spark.createDataFrame(rows, "device string, ts string, value double").selectExpr("device", "cast(ts as timestamp_ntz) ts", "value")
    found = events.rise_events(g).collect()
    assert [(r["trough"], r["peak"], r["span_h"]) for r in found] == [(5.0, 9.0, 2)]


def test_empty_grid(spark):
    from tilth.operators import grid

    none = spark.createDataFrame([], "device string, ts timestamp_ntz, value double")
    assert grid.resample(none).count() == 0


def test_kml_webdav_and_names(spark):
    kml = "<kml><Placemark><name>B1</name><Polygon><coordinates>0,0 4,0 4,4</coordinates></Polygon></Placemark><Placemark><name>P</name><Point><coordinates>1,2,0</coordinates></Point></Placemark><Placemark><name>L</name><LineString/></Placemark></kml>"
    rows = parsing.placemarks(spark.createDataFrame([(kml,)], "kml string")).collect()
    assert [(r["name"], r["kind"], len(r["coords"])) for r in rows] == [("B1", "polygon", 3), ("P", "point", 1)]
    from pyspark.sql import functions as F

    xml = "<d:m><d:response><d:href>/dav/a/</d:href><d:collection/></d:response><d:response><d:href>/dav/a/f%20x.tif</d:href><d:getcontentlength>12</d:getcontentlength></d:response></d:m>"
    got = parsing.propfind(spark.createDataFrame([(xml,)], "xml string"), F.lit("/dav/a")).collect()
    assert [(r["path"], r["is_dir"], r["size"]) for r in got] == [("f x.tif", False, 12)]
    assert parsing.vintage_name("rain_previous_day2") == "rain_prev2" and parsing.vintage_name("rain") is None
    assert "pivot" in parsing.flux_query("d", ["m"], "b")
    with pytest.raises(ValueError):
        parsing.forecast_params(17, 0, 0, ("a",))


def test_payload_without_block_is_an_error(spark):
    good = spark.createDataFrame([('{"daily": {"time": ["2024-01-01"], "t": [1.5]}}',)], "payload string")
    assert parsing.daily_payload(good, {"t": "temp"}).collect()[0]["temp"] == 1.5
    bad = spark.createDataFrame([('{"error": true}',)], "payload string")
    with pytest.raises(Exception, match="daily block"):
        parsing.daily_payload(bad, {"t": "temp"}).collect()


def test_pivot_and_alias(spark):
    rows = spark.createDataFrame([("d", 1, "x", "2.5"), ("d", 1, "y", "bad")], "device string, ts int, measurement string, value string")
    r = parsing.pivoted(rows, "d", ["x", "y"]).collect()[0]
    assert r["x"] == 2.5 and r["y"] is None
    many = [("d", 1, "x", "bad"), ("d", 1, "x", "2.5"), ("d", 1, "x", "10"), ("d", 1, "y", "7"), ("d", 1, "y", None)]
    for order in (many, many[::-1]):
        r = parsing.pivoted(spark.createDataFrame(order, rows.schema).coalesce(1), "d", ["x", "y"]).collect()[0]
        assert (r["x"], r["y"]) == (10.0, 7.0)
    names = {r["measurement"] for r in parsing.aliased(rows, {"x": "moisture"}, {("d", "y"): "special"}).collect()}
    assert names == {"moisture", "special"}


def test_quantiles_are_the_sql_to_the_last_digit(spark):
    import duckdb

    from tilth import plans

    got = plans.QUERIES["x11_quantiles"](spark, "").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(plans.ORACLE_SQL["x11_quantiles"]).fetchall())


def test_rounding_as_the_sql_rounds(spark):
    import duckdb

    from tilth.plans.sensor import r6_binary

    values = [s * v / 100 * 1.01 for v in (k / 1000 for k in range(5, 40_000, 10)) for s in (1, -1)] + [0.0, 1e301, 5e-324, 0.4999999999999999e-6, 1e18 + 128, None]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(r6_binary("v", "x")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(f"g{i % 5}",) for i in range(50)], "g string")
    s = screening.split_groups(df, "g", 0.2, 7)
    assert s.count() == 5 and {r["split"] for r in s.collect()} == {"train", "val"}


def test_the_rest_works_without_the_training_data_part():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "tilth"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M)


@pytest.mark.parametrize("halflife", [1.0, 3.0])
def test_weighted_mean_of_a_very_long_series(spark, halflife):
    rng = np.random.default_rng(11)
    x = np.where(rng.random(6500) < 0.05, np.nan, rng.normal(10, 3, 6500))  # over 2000 halflives
    rows = [("a", int(i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("b", 0, None), ("b", 1, 2.0)]
    df = spark.createDataFrame(rows, "device string, ts long, v double")
    got = features.ewma_frame(df, "v", "m", halflife, least=3, block=400).where("device = 'a'").orderBy("ts").toPandas()["m"]
    seen = pd.Series(x).dropna()
    want = seen.ewm(halflife=halflife).mean().where(np.arange(len(seen)) >= 2).reindex(range(len(x))).ffill()
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, equal_nan=True)
    short = features.ewma_frame(df, "v", "m", halflife, least=3, block=5).where("device = 'a'").orderBy("ts").toPandas()["m"]
    assert np.allclose(short.to_numpy(float), want.to_numpy(float), rtol=0.05, equal_nan=True)


def test_a_wrong_timestamp_makes_no_endless_grid(spark):
    from tilth.operators import grid

    rows = spark.sql("SELECT 'a' AS device, ts, 1.0D AS value FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:00:00'), (TIMESTAMP_NTZ'2924-01-01 00:00:00') t(ts)")
    with pytest.raises(Exception, match="most_bins"):
        grid.resample(rows).collect()
    assert grid.resample(rows, most_bins=10**8).limit(1).count() == 1


def test_pictures_come_back():
    from tilth.sources import raster

    cells = np.random.default_rng(12).normal(size=(3, 5, 7)).astype(np.float32)
    assert (raster.decode(raster.encode(cells)) == cells).all()
    for bad in (b"PK12", b"II*\0"[:4] + b"\0" * 3):
        with pytest.raises(Exception):  # noqa: B017, PT011
            raster.decode(bad)


def test_camera_file_names(spark):
    from pyspark.sql import functions as F

    names = ["DJI_20260108152708_0001_MS_G_point1.TIF", "DJI_20260108152708_0001_D_point12.JPG", "DJI_20260108152708_0001_MS_RE_point3.TIF", "DJI_20260108152708_0001_PPKNAV.nav", "20260108_152708_1_MSG.TIF", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(r) for r in df.select(*parsing.capture_fields(F.col("name")).values()).collect()]
    assert got[:3] == [("20260108152708", "0001", "MS_G", 1), ("20260108152708", "0001", "D", 12), ("20260108152708", "0001", "MS_RE", 3)]
    assert got[3:] == [(None,) * 4] * 3


def test_censored_curves_against_counting():
    rng = np.random.default_rng(13)
    time, event = rng.integers(1, 26, 400), rng.random(400) < 0.5
    event &= time <= 24
    s, g = kernels.product_limit(time, event, 24), kernels.censoring_curve(time, event, 24)
    a = b = 1.0
    for h in range(1, 25):
        n = (time >= h).sum()
        a *= 1 - ((time == h) & event).sum() / n
        b *= 1 - ((time == h) & ~event).sum() / n
        assert np.isclose(s[h - 1], a) and np.isclose(g[h], b)
    surv = np.tile(s, (400, 1))
    h = 10
    want = np.mean([s[h - 1] ** 2 / max(g[t - 1], 1e-6) if e and t <= h else (1 - s[h - 1]) ** 2 / max(g[h], 1e-6) if t > h else 0.0 for t, e in zip(time, event)])
    assert np.isclose(kernels.censored_brier(time, event, surv, g)[h - 1], want)
    assert (kernels.product_limit(np.zeros(0, int), np.zeros(0, bool), 5) == 1).all()


def test_services_by_recorded_answers(spark):
    import io
    import json

    from tilth.sources import services

    asked = []

    def opener(request, timeout=None):
        asked.append(request.full_url)
        return io.BytesIO(json.dumps({"daily": {"time": ["2024-01-01", "2024-01-02"], "t": [1.5, None]}}).encode())

    rows = services.fetch_daily(spark, "https://x.example.org/v1", parsing.archive_params("2024-01-01", "2024-01-02", 1.0, 2.0, ("t",)), {"t": "temp"}, opener).collect()
    assert [r["temp"] for r in rows] == [1.5, None] and "start_date=2024-01-01" in asked[0]
    with pytest.raises(Exception, match="hourly"):
        services.fetch_vintages(spark, "https://x.example.org/v1", parsing.previous_runs_params("a", "b", 1.0, 2.0, ("t",)), opener).collect()
    with pytest.raises(ValueError, match="token"):
        services.SeriesClient("https://x.example.org", None, "o", "b")
    text = "#datatype,string\n,result,_time,moisture,other\n,_r,2024-01-01T00:00:00Z,21.5,x\n,_r,2024-01-01T01:00:00Z,bad,y\n"
    client = services.SeriesClient("https://x.example.org", "t", "o", "b", opener=lambda r, timeout=None: io.BytesIO(text.encode()))
    assert [r["moisture"] for r in client.read(spark, "d", ["moisture", "absent"]).orderBy("ts").collect()] == [21.5, None]
    with pytest.raises(ValueError):
        parsing.forecast_params(17, 1.0, 2.0, ("t",))

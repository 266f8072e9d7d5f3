import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import raster
from ledgerloom.operators.scene_contracts import Affine, Season, cell_features, grid_check, iso_date, pixel_errors, scene_errors, tile_counts, utc_time


def test_times_and_dates_are_strict(spark):
    texts = ["2024-02-29T23:59:59Z", "2023-02-29T00:00:00Z", "2024-02-01T00:00:00", "2024-02-01T00:00:00.5Z", "2024-02-01 00:00:00Z", "2024-02-01T24:00:00Z", "2024-2-1T00:00:00Z", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", utc_time(F.col("t")).isNotNull().alias("ok"))
    assert [r.ok for r in df.orderBy("k").collect()] == [True] + [False] * 7
    dates = ["2024-02-29", "2023-02-29", "2024-2-9", "20240229", "2024-02-29 ", None]
    df = spark.createDataFrame(list(enumerate(dates)), "k int, t string").select("k", iso_date(F.col("t")).isNotNull().alias("ok"))
    assert [r.ok for r in df.orderBy("k").collect()] == [True] + [False] * 5


def test_transforms():
    t = Affine(("300000", "10", "0", "4100000", "0", "-10"))
    assert t.determinant == -100 and t.area == 100 and t.bbox(2, 3) == [300000.0, 4099980.0, 300030.0, 4100000.0]
    assert Affine(("0", "0", "2", "0", "3", "0")).bbox(1, 1) == [0.0, 0.0, 2.0, 3.0]
    for wrong in (("0", "1", "2", "0", "2", "4"), ("0",)):
        with pytest.raises(ValueError):
            Affine(wrong)
    for wrong in ((184, 1, 2), (30, 5, 4), (30, 0, 4)):
        with pytest.raises(ValueError):
            Season(*wrong)


def test_scenes(spark):
    good = ("EPSG:32652", "-9999", "leaf-on", "leaf-on", "2022-06-01 00:00:00", "2023-06-11 00:00:00")
    change = [(), (0, "32652"), (1, "0.5"), (1, "none"), (2, None), (3, "leaf-off"), (5, "2022-05-31 00:00:00"), (5, "2023-08-01 00:00:00"), (5, "2029-06-01 00:00:00"), (4, None)]
    rows = []
    for i, c in enumerate(change):
        row = list(good)
        if c:
            row[c[0]] = c[1]
        rows.append((i, *row))
    df = spark.createDataFrame(rows, "k int, crs string, nodata string, label_before string, label_after string, b string, a string")
    df = df.withColumns({"acquired_before": F.col("b").cast("timestamp_ntz"), "acquired_after": F.col("a").cast("timestamp_ntz")})
    got = {}
    for r in scene_errors(df, "k", Season(30, 1, 800)).collect():
        got.setdefault(r.k, []).append(r.error)
    assert got == {1: ["crs_malformed"], 2: ["nodata_within_range"], 3: ["nodata_no_number"], 4: ["label_missing"], 5: ["labels_differ"], 6: ["times_out_of_order"], 7: ["day_gap_too_wide"], 8: ["elapsed_out_of_window"], 9: ["time_missing"]}


@pytest.fixture
def pixels(spark):
    rows = [("s", 0, 0, 0.1, 0.2, 0.1, 0.2, True), ("s", 0, 1, 0.0, 0.0, 1.5, 0.2, True), ("s", 1, 0, -9999.0, 0.2, 0.1, None, False), ("s", 1, 0, 0.1, 0.2, 0.1, 0.2, False), ("s", 5, 0, 0.1, 0.2, 0.0, 0.0, True), ("t", 0, 0, 0.1, 0.2, 0.1, 0.2, True)]
    return spark.createDataFrame(rows, "scene string, row long, col long, red_before double, nir_before double, red_after double, nir_after double, valid boolean")


def test_pixels_against_a_grid(pixels):
    got = {tuple(r) for r in pixel_errors(pixels, "scene", 2, 2, -9999.0).collect()}
    assert got == {("s", 0, 1, "zero_sum:before"), ("s", 0, 1, "out_of_range:red_after"), ("s", 1, 0, "out_of_range:nir_after"), ("s", 1, 0, "repeated_cell"), ("s", 5, 0, "outside_grid"), ("s", 5, 0, "zero_sum:after")}
    grid = {r.scene: (r.inside, r.outside, r.repeated, r.missing, r.complete) for r in grid_check(pixels, "scene", 2, 2).collect()}
    assert grid == {"s": (3, 1, 1, 1, False), "t": (1, 0, 0, 3, False)}
    assert grid_check(pixels.filter("scene = 't'"), "scene", 1, 1).first().complete
    assert grid_check(pixels.limit(0), "scene", 2, 2).collect() == []


def test_empty_tiles_are_counted(pixels):
    got = {(r.scene, r.tile): (r.pixels, r.valid) for r in tile_counts(pixels, "scene", 3, 2, 2, 1).collect()}
    assert len(got) == 8 and got["s", "tile-r0000-c0000"] == (3, 1) and got["t", "tile-r0002-c0001"] == (0, 0)


def test_features(spark):
    rows = [("s", 0, 0, True, True, "0.5", "0.1"), ("s", 0, 1, True, False, "0.5", None), ("s", 1, 1, False, True, "0.5", "0.4"), ("s", 5, 5, False, False, "0.5", "0.4")]
    df = spark.createDataFrame(rows, "scene string, row long, col long, loss boolean, reference boolean, before string, after string")
    out = [json.loads(r.feature) for r in cell_features(df, raster.components(df.filter("loss"), "scene"), "scene", ("127", "36"), ("0.5", "0.25")).orderBy("row", "col").collect()]
    assert [f["properties"]["confusion_class"] for f in out] == ["tp", "fp", "fn", "tn"] and [f["properties"].get("region") for f in out] == [1, 1, None, None]
    assert out[1]["id"] == "cell-r000-c001" and out[1]["geometry"]["coordinates"] == [[[127.5, 36.0], [127.5, 35.75], [128.0, 35.75], [128.0, 36.0], [127.5, 36.0]]]

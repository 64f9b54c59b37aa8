"""Rejection rules, height formulas, polygons and the chains end to end."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from crownlake.operators import filters, height, polygons, raster, tables
from crownlake.plans import chains
from crownlake.sources import codecs, readers

RING = "ring array<struct<x:double,y:double>>"


def square(x0, y0, n):
    return [(float(x0), float(y0)), (float(x0 + n), float(y0)), (float(x0 + n), float(y0 + n)), (float(x0), float(y0 + n))]


def test_filters(spark):
    px = spark.createDataFrame([("a", 0, 0, 0), ("a", 1, 1, 1), ("b", 5, 0, 0)], "t string, r int, g int, b int")
    assert [r.t for r in filters.bright_enough(px, ["t"]).collect()] == ["b"]
    assert [r.t for r in filters.crowd_between(px, ["t"], 2).collect()] == ["a"]
    s = spark.createDataFrame([(0, x, v) for x, v in enumerate([-5.0, 70.0, 3.0, 3.0, 0.0, 2.0, 95.0])], "y int, x int, value double")
    got = {r.x: r.value for r in filters.valid_heights(s).collect()}
    assert got == {0: None, 1: 60.0, 2: 3.0, 3: None, 4: None, 5: None, 6: None}
    flat = spark.createDataFrame([(y, x, 50.0 if (y, x) == (3, 3) else 0.0) for y in range(8) for x in range(8)], "y int, x int, value double")
    left = filters.steady(flat, 1.0)
    assert 0 < left.count() < 64 and left.where("y = 7").count() == 8
    cam = spark.createDataFrame([(1920, 1080), (1280, 720), (1920, 1440)], "w int, h int")
    assert [r.c for r in cam.select(filters.camera_warning(F.col("w"), F.col("h")).alias("c")).collect()] == [None, "width 1280", "aspect 1.333"]
    assert spark.range(1).select(filters.textured(F.lit(1.0), F.lit(None).cast("double"), 0.8, 2.0).alias("k")).first().k


def test_height(spark):
    px = spark.createDataFrame([("a", i, float(i + 1), 2.0 * (i + 1), 100.0) for i in range(10)], "site string, i int, d_pred double, d_gt double, altitude_m double").withColumn("crop", F.lit(1))
    px = height.oracle_scaled(height.anchored(px, ["crop"]), ["crop"])
    r = px.where("i = 4").first()
    assert r.d_oracle == pytest.approx(r.d_gt) and r.d_anchor == pytest.approx(5 * 100 / np.percentile(range(1, 11), 95))
    overall, bins = height.depth_report(px, {"raw": "d_pred", "oracle": "d_oracle"})
    got = {r.variant: r for r in overall.collect()}
    assert got["oracle"].absrel == pytest.approx(0) and got["raw"].absrel == pytest.approx(0.5) and got["raw"].scale_error == pytest.approx(0.5)
    assert {r.bin for r in bins.collect()} == {"70-200"}
    f = spark.createDataFrame([("m", "80m", 80.0, 60.0), ("m", "x", None, 60.0), ("m", "100m", 100.0, 75.0)], "model string, folder string, altitude_known double, inv_p95 double")
    cal = height.calibrated(f)
    assert [r.fov_est is None for r in cal.collect()] == [False, True, False]
    assert {r.verdict for r in height.fov_consistency(cal).collect()} == {"good"}
    v, s = height.known_altitude(F.col("folder"), F.col("altitude_known") * 0, 50.0)
    assert [tuple(r) for r in f.select(v.alias("v"), s.alias("s")).collect()] == [(80.0, "folder"), (50.0, "default"), (100.0, "folder")]
    c = spark.createDataFrame([("r", 1, 5.0), ("r", 2, 3.0), ("q", 1, 9.0)], "route string, p int, mae_m double")
    assert {r.route: r.p for r in height.best_route(c, ["p"]).collect()} == {"r": 2, "q": 1}
    u, w, d = height.look_at((0, 0, 10), (0, 10, 10), F.lit(1.0), F.lit(5.0), F.lit(10.0), 2.0)
    assert tuple(spark.range(1).select(u, w, d).first()) == pytest.approx((0.4, 0.0, 5.0))


def test_polygons(spark):
    rings = spark.createDataFrame([("s", 1, square(2, 2, 4)), ("s", 2, square(12, 2, 4)), ("s", 3, square(8, 2, 4))], f"site string, record int, {RING}")
    tiles = polygons.tile_grid(spark, 20, 10, 10)
    assert tiles.count() == 2
    whole = polygons.rings_in_tiles(rings, tiles, 10)
    assert sorted((r.record, r.tx0, r.ring[0].x) for r in whole.collect()) == [(1, 0, 2.0), (2, 10, 2.0)]
    assert polygons.rings_in_tiles(rings, tiles, 10, whole=False).count() == 4
    runs = polygons.filled(rings, ["site", "record"], 10, 20)
    assert {r.record: r.a for r in runs.groupBy("record").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("a")).collect()} == {1: 16, 2: 16, 3: 16}
    last = polygons.class_raster(polygons.filled(spark.createDataFrame([("s", 1, square(0, 0, 4)), ("s", 2, square(2, 0, 4))], f"site string, record int, {RING}"), ["site", "record"], 9, 9), ["site"], "record", "record")
    assert {r.label: r["count"] for r in last.groupBy("label").count().collect()} == {1: 8, 2: 16}
    world = spark.range(1).select(F.array(F.struct(F.lit(105.0).alias("x"), F.lit(190.0).alias("y"))).alias("ring"))
    p = world.select(polygons.to_pixels(F.col("ring"), (0.5, 0.0, 100.0, 0.0, -0.5, 200.0)).alias("r")).first().r[0]
    assert (p.x, p.y) == (10.0, 20.0)


def test_evaluation_chain(spark, tmp_path):
    t, p = np.zeros((8, 8), np.uint16), np.zeros((8, 8), np.uint16)
    p[1:4, 2:5], p[4:8, 4:7], p[0, 7] = 1, 2, 3
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "north_01_labels.png").write_bytes(codecs.png_encode(p))
    (tmp_path / "maps" / "other_02_labels.png").write_bytes(codecs.png_encode(t))
    flat = [[c for q in square(1, 1, 3) for c in q], [c for q in square(4, 4, 4) for c in q]]
    (tmp_path / "truth.json").write_text(json.dumps({"north_01": flat, "south_09": flat}))
    (tmp_path / "large.json").write_text(json.dumps({k: [[256 * x for x in ring] for ring in flat] for k in ("north_01", "south_09")}))
    r = chains.evaluate_folder(spark, str(tmp_path / "maps"), str(tmp_path / "truth.json"), 8, truth_size=8).collect()
    assert chains.evaluate_folder(spark, str(tmp_path / "maps"), str(tmp_path / "large.json"), 8).collect() == r
    assert [(x.area, x.pred, x.gt, x.hits) for x in r] == [("north", 3, 2, 2)]
    assert (r[0].precision, r[0].recall, r[0].f1, r[0].mean_iou) == pytest.approx((2 / 3, 1, 0.8, 0.625))


def test_species_chain(spark, tmp_path):
    a = np.zeros((40, 40), np.uint16)
    a[2:20, 2:20], a[22:38, 22:38], a[0, 0] = 1, 2, 3
    (tmp_path / "80m").mkdir()
    (tmp_path / "80m" / "f_labels.png").write_bytes(codecs.png_encode(a))
    classes = tables.class_list(spark.createDataFrame([(1, "Acer"), (2, "x"), (4, "Picea"), (5, "Pinus")], "id int, name string"))
    crowns = chains.species_table(readers.label_runs(spark, str(tmp_path)), "stub_classifier", classes)
    r = {x.label: x for x in crowns.collect()}
    assert set(r) == {1, 2} and r[1].crop_px == 43 and {r[1].species_top1, r[1].species_top2, r[1].species_top3} == {"Acer", "Picea", "Pinus"}
    s = chains.species_summary(crowns).collect()
    assert sum(x.n for x in s) == 2 and all(x.folder == "80m" for x in s)


def test_label_chain(spark):
    runs = raster.runs(spark.createDataFrame([("t", y, x, 1 + x // 10) for y in range(10) for x in range(20)], "tile string, y int, x int, label int"), ["tile"])
    rings = spark.createDataFrame([("t", 1, "Pinus", square(0, 0, 10)), ("t", 2, "Acer", square(10, 0, 3)), ("t", 3, "Picea", square(13, 0, 4))], f"tile string, record int, species string, {RING}")
    r = {x.label: x for x in chains.labelled_crowns(runs, rings, ["tile"], 10, 20).collect()}
    assert (r[1].species, r[1].coverage, r[1].usable) == ("Pinus", 1.0, True)
    assert (r[2].species, r[2].usable) == ("Picea", False) and r[2].coverage == pytest.approx(0.25)

"""Operators on hand-checked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crownlake.functions import scalar as S
from crownlake.operators import instances, joins, metrics, models, rank, raster, surfaces, tables, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def grid(spark, a, value=None):
    rows = [(y, x, int(v)) for y, r in enumerate(a) for x, v in enumerate(r) if v]
    df = spark.createDataFrame(rows, "y int, x int, label int")
    if value is not None:
        df = df.join(spark.createDataFrame([(y, x, float(v)) for y, r in enumerate(value) for x, v in enumerate(r)], "y int, x int, value double"), ["y", "x"])
    return df


def maps():
    t, p = np.zeros((8, 8), int), np.zeros((8, 8), int)
    t[1:4, 1:4], t[4:8, 4:8] = 1, 2
    t = np.zeros((8, 8), int)
    t[1:4, 1:4], t[4:8, 4:8] = 1, 2
    p[1:4, 2:5], p[4:8, 4:7], p[0, 7] = 1, 2, 3
    return t, p


def test_zonal_and_iou(spark):
    t, p = maps()
    truth, found = grid(spark, t), grid(spark, p)
    for df in (raster.zonal(found), raster.zonal_runs(raster.runs(found))):
        got = {r.label: tuple(r[1:]) for r in df.collect()}
        assert got == {1: (9, 3.0, 2.0, 2, 1, 5, 4), 2: (12, 5.0, 5.5, 4, 4, 7, 8), 3: (1, 7.0, 0.0, 7, 0, 8, 1)}
    for df in (raster.overlap(found, truth), raster.run_overlap(raster.runs(found), raster.runs(truth))):
        assert {(r.p, r.t): r.iou for r in df.collect()} == {(1, 1): 0.5, (2, 2): 0.75}
    assert raster.coverage(found, F.lit(64)).first().coverage == 22 / 64
    pairs = raster.overlap(found, truth).withColumn("frame", F.lit(1))
    scores = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in (1, 2, 3)], "frame int, p int, score double")
    truths = spark.createDataFrame([(1, 2)], "frame int, n_true int")
    m = metrics.micro(instances.evaluated(instances.matched_by_score(pairs, scores, ["frame"]), truths, ["frame"]), ["frame"], iou_sum="iou_sum").first()
    assert (m.hits, m.recall, m.mean_iou) == (2, 1.0, 0.625)
    assert m.precision == pytest.approx(2 / 3) and m.f1 == pytest.approx(0.8)
    assert raster.pixels_of(raster.runs(found)).count() == 22


def test_matching_order(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.6), (1, 2, 1, 0.9), (1, 2, 2, 0.55)], "frame int, p int, t int, iou double")
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8)], "frame int, p int, score double")
    by_score = instances.matched_by_score(pairs, scores, ["frame"], 0.5).collect()
    assert {(r.p, r.t) for r in by_score} == {(1, 1), (2, 2)}
    assert {(r.p, r.t) for r in instances.matched_by_iou(pairs, ["frame"], 0.5).collect()} == {(2, 1)}
    tie = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.5)], "frame int, p int, t int, iou double")
    assert instances.matched_by_score(tie, scores.where("p = 1"), ["frame"], 0.5).first().t == 2


def test_suppression_chain_and_union(spark):
    # one-pixel-high boxes whose overlaps give IoU AB = BC = .6, AC = .3 or so
    b = spark.createDataFrame([(1, 1, 0, 0, 16, 1, 0.9), (1, 2, 4, 0, 20, 1, 0.8), (1, 3, 8, 0, 24, 1, 0.7)], "frame int, id int, x0 int, y0 int, x1 int, y1 int, score double")
    assert sorted(r.id for r in instances.suppressed(b, ["frame"], 0.5).collect()) == [1, 3]
    masks = [(1, i, s, 0, x) for i, s, r in ((1, 0.9, range(1, 11)), (2, 0.8, range(11, 21)), (3, 0.7, range(6, 16))) for x in r]
    m = spark.createDataFrame(masks, "frame int, id int, score double, y int, x int")
    assert {r.id for r in instances.unclaimed(m, ["frame"], 0.3).collect()} == {1, 2}
    left = instances.unclaimed(m.where("id <> 2"), ["frame"], subtract=True).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in left} == {1: 10, 3: 5}


def test_average_precision(spark):
    rows = spark.createDataFrame([("a", 1.0 - i / 10, h, i) for i, h in enumerate([1, 0, 1, 1, 0])], "area string, score double, hit int, n int")
    for n, ap in ((4, 0.6247524752), (5, 0.5009900990)):
        got = metrics.ap_linear101(rows, spark.createDataFrame([("a", n)], "area string, n_true int"), ["area"]).first().ap
        assert got == pytest.approx(ap, abs=1e-9)
        env, rec = np.array([1, 0.75, 0.75, 0.75, 0.6]), np.array([1, 1, 2, 3, 3]) / n
        assert got == pytest.approx(np.interp(np.linspace(0, 1, 101), rec, env, left=1.0, right=0.0).mean(), abs=1e-9)
    truths = spark.createDataFrame([("a", 0), ("b", 3)], "area string, n_true int")
    assert {r.area: r.ap for r in metrics.ap_linear101(rows, truths, ["area"]).collect()} == {"a": None, "b": 0.0}


def test_adjacency_and_renumbering(spark):
    df = grid(spark, [[1, 1, 2], [1, 3, 2], [3, 3, 2]], np.arange(1, 10).reshape(3, 3))
    assert {(r.a, r.b): r.saddle for r in raster.saddles(df).collect()} == {(1, 2): 2, (1, 3): 4, (2, 3): 8}
    low = raster.prominences(df, span=10.0, least=0.5).collect()
    assert all(r.suspicious for r in low)
    d = spark.createDataFrame([(1, x) for x in (0, 2, 5, 9)], "frame int, label int")
    assert {r.label: r.id for r in rank.renumbered(d, ["frame"]).collect()} == {0: 0, 2: 1, 5: 2, 9: 3}


def test_tiles_and_cores():
    assert raster.tile_boxes(100, 60, 2, 0.15) == [(0, 0, 57, 34), (42, 0, 100, 34), (0, 25, 57, 60), (42, 25, 100, 60)]
    assert raster.tile_boxes(100, 60, 1) == [(0, 0, 100, 60)]
    assert raster.window_cores(2048, 1024, 768) == [(0, 0, 640), (256, 640, 896), (512, 896, 1152), (768, 1152, 1408), (1024, 1408, 2048)]
    assert raster.window_cores(1500, 1024, 768) == [(0, 0, 640), (256, 640, 896), (476, 860, 1500)]
    assert raster.window_cores(800, 1024, 768) == [(0, 0, 800)]


def test_camera(spark):
    assert value(spark, S.gsd(100.0, 73.7, 1920.0)) == pytest.approx(0.0780684914)
    assert value(spark, S.gsd(80.0, 48.0, 1920.0)) == pytest.approx(0.0371023904)
    assert value(spark, S.focal_k(48.0)) == pytest.approx(1.1230183870)
    assert value(spark, S.fov_of(S.focal_k(73.7))) == pytest.approx(73.7)
    assert value(spark, S.crop_px(9.728, S.gsd(100.0, 73.7, 1920.0))) == 125
    assert value(spark, S.crop_px(0.1, 1.0)) == 16
    assert value(spark, S.centimetres(F.lit(None).cast("double"))) == 0 and value(spark, S.centimetres(1.234)) == 123


@pytest.mark.parametrize(("name", "strict", "decimal"), [("80m", 80, 80), ("100", 100, 100), ("35 M", 35, 35), ("mixed1", None, None), ("7m", None, 7), ("1000", None, 1000), ("80,5m", None, 80.5), ("dense1", None, None)])
def test_altitudes(spark, name, strict, decimal):
    assert value(spark, S.altitude(F.lit(name))) == strict
    assert value(spark, S.altitude_decimal(F.lit(name))) == decimal


def test_names(spark):
    for name, short, whole in (("Acer saccharum Marshall", "A. saccharum", "A. saccharum"), ("dead", "dead", "dead"), ("Picea", "Picea", "Picea"), ("forest floor", "forest", "forest floor")):
        assert value(spark, S.short_name(F.lit(name))) == short
        assert value(spark, S.short_name_or_whole(F.lit(name))) == whole
    assert value(spark, S.strip_suffix(F.lit("a_labels"), "_labels")) == "a"
    cases = [("A. saccharum", "Acer saccharum", True), ("Betula papyrifera", "B. papyrifera", True), ("betula x", "Betula", True), ("Picea glauca", "Picea A.Dietr.", True), ("Pinus strobus", "Picea L.", True), ("Acer rubrum", "Acer saccharum", False), ("Thuja occidentalis", "Acer", False)]
    assert [value(spark, S.species_match(F.lit(a), F.lit(b))) for a, b, _ in cases] == [c for *_, c in cases]
    assert value(spark, S.key_parts(F.lit("f__s__t"))[1]) == "s__t"


def test_majority_tie(spark):
    label = grid(spark, [[1] * 10])
    classes = spark.createDataFrame([(0, x, c) for x, c in enumerate([3] * 4 + [5] * 4 + [0] * 2)], "y int, x int, label int")
    r = raster.majority(label, classes).first()
    assert (r.class_id, r.coverage, r.purity, r.usable) == (3, 0.8, 0.5, False)


def test_scores(spark):
    probs = F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1))
    assert value(spark, S.entropy(probs)) == pytest.approx(0.8018185525)
    assert value(spark, S.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    table = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (1, 0, 2), (1, 1, 4)], "a int, b int, n long")
    r = metrics.cluster_scores(table).first()
    assert (r.purity, r.nmi_geometric, r.nmi_arithmetic, r.ari) == pytest.approx((0.75, 0.1977098188, 0.1976995982, 0.1772853186))
    w = metrics.class_weights(spark.createDataFrame([(c,) for c in "aaab"], "c string"), "c")
    assert {r.c: r.weight for r in w.collect()} == pytest.approx({"a": 0.5, "b": 1.5})
    e = metrics.error_metrics(spark.createDataFrame([(10.0, 12.0), (22.0, 20.0), (30.0, 40.0)], "pred double, truth double"), []).first()
    assert (e.absrel, e.mae, e.rmse, e.bias, e.delta125, e.scale_error) == pytest.approx((0.1722222222, 4.6666666667, 6, -3.3333333333, 0.6666666667, 1.1))
    c = metrics.correlation(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, y double"), [], "x", "y").first()
    assert c.r is None


def test_splits_bins_means(spark):
    s = rank.modulo_split(spark.createDataFrame([(f"s{i:02d}",) for i in range(20)], "site string"), "site").collect()
    assert {r.ordinal for r in s if r.split == "val"} == {0, 9, 18} and {r.ordinal for r in s if r.split == "test"} == {4, 13}
    for x, label in ((40.0, "0-40"), (40.01, "40-70"), (70.0, "40-70"), (0.0, None), (200.0, "70-200"), (201.0, None)):
        assert value(spark, tables.binned(F.lit(x), [0, 40, 70, 200])) == label
    m = tables.mean_of_means(spark.createDataFrame([("g", "A", 1.0), ("g", "A", 3.0), ("g", "B", 10.0)], "g string, site string, v double"), "g", "site", "v", 8).first()
    assert (m["mean"], m["std"]) == pytest.approx((6.0, 5.6568542495))
    with pytest.raises(ValueError):
        tables.strict_pivot(spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "k int, c string, v int"), "k", "c", ["a"], "v")


def test_cut_edges(spark):
    t = spark.createDataFrame([(0, 5, 10, 15, 100), (0, 5, 10, 15, 0)], "x0 int, y0 int, x1 int, y1 int, tx0 int")
    cut = raster.touches_inner_edge(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), (F.col("tx0"), F.lit(0), F.col("tx0") + 50, F.lit(50)), 500, 50)
    assert [r.c for r in t.select(cut.alias("c")).collect()] == [True, False]


def test_running_median_and_partners(spark):
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([5, 1, 9, 2, 7])], "g int, i int, v double")
    assert [r.running_median for r in rank.running_median(d, ["g"], "i", "v", 3).orderBy("i").collect()] == [5, 5, 2, 7, 7]
    p = joins.ordinal_partners(d, ["g"], ["i"], "i", (-1, 2)).collect()
    assert {(r.item, r.partner) for r in p} == {(1, 0), (2, 1), (3, 2), (4, 3), (0, 2), (1, 3), (2, 4)}
    with pytest.raises(ValueError):
        joins.pairs_in_group(d, ["g"], "i", most=3)


def test_merge_and_components(spark):
    e = spark.createDataFrame([(1, 1, 2, 9.9, 10.0), (1, 2, 3, 5.0, 10.0)], "frame int, a int, b int, saddle double, span double")
    r = spark.createDataFrame([(1, i, 10.0, 5.0, 50.0, 0.0, 0.0) for i in (1, 2, 3)], "frame int, label int, peak double, area double, l double, ca double, cb double")
    assert {x.label: x.root for x in instances.merged(e, r, ["frame"], most_area=100.0).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x.label: x.root for x in instances.merged(e, r, ["frame"], most_area=9.0).collect()} == {1: 1, 2: 2, 3: 3}
    assert {x.node: x.root for x in instances.components(e.select("frame", "a", "b"), ["frame"]).collect()} == {1: 1, 2: 1, 3: 1}


def test_surfaces(spark):
    y, x = np.mgrid[0:20, 0:40]
    a = np.maximum(0, 5 - np.hypot(y - 10, x - 10)) + np.maximum(0, 4 - np.hypot(y - 10, x - 28))
    markers = surfaces.prominent_peaks(a, 1.0)
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(markers), strict=True)} == {(10, 10), (10, 28)}
    labels = surfaces.watershed(a, markers, a > 0)
    assert len(np.unique(labels)) == 3 and labels[10, 10] != labels[10, 28]
    assert surfaces.labelled(a > 0).max() == 2
    assert sum(e - s for _, s, e in surfaces.polygon_runs([(1, 1), (11, 1), (11, 11), (1, 11)], 20, 20)) == 100
    h = surfaces.hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]]))
    assert surfaces.area_of(h) == 4.0
    df = spark.createDataFrame([("f", "s", 20, 40, a.ravel().tolist())], "folder string, stem string, height int, width int, values array<double>")
    got = surfaces.crowns(df, ["folder", "stem"], sigma=0.0, prominence=1.0)
    assert got.select("label").distinct().count() == 2
    assert surfaces.terrain(np.full((10, 10), 3.0), 4).min() == 3.0
    assert np.allclose(surfaces.blurred(np.full((9, 9), 2.0), 1.0), 2.0)


def test_vectors_and_models(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 5.0])], "g string, features array<double>")
    assert sorted(r.features for r in vectors.centred(d, ["g"]).collect()) == [[-1.0, -1.0], [0.0, 0.0], [1.0, 1.0]]
    s = vectors.standardised(d, d).collect()
    assert sum(r.features[0] for r in s) == pytest.approx(0)
    assert vectors.clustered(d, 2, tries=2).select("cluster").distinct().count() == 2
    c = models.apply(spark.createDataFrame([(1, 25), (2, 40)], "id int, crop_px int"), "stub_classifier", ["id"]).collect()
    assert [r.height for r in sorted(c)] == [2.5, 4.0] and all(math.isclose(sum(r.probs), 1, rel_tol=1e-6) for r in c)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    assert value(spark, S.ring_area(ring)) == 100 and value(spark, S.ring_length(ring)) == 40
    assert value(spark, S.compactness(S.ring_area(ring), S.ring_length(ring))) == pytest.approx(math.pi / 4)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "frame int, id int, x0 int, y0 int, x1 int, y1 int, score double, label int, y int, x int, value double")
    assert instances.suppressed(e, ["frame"]).count() == 0 and raster.zonal(e).count() == 0 and raster.saddles(e).count() == 0
    assert tables.value_counts(e, "id").count() == 0 and rank.even_sample(e, ["frame"], ["id"], 3).count() == 0

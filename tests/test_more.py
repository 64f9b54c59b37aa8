"""Further operators on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crownlake.operators import rank, raster, tables
from crownlake.sources import codecs, readers


def test_settings_and_counts(spark):
    assert tables.settings(["a=1", "b = 2.5"]) == {"a": 1.0, "b": 2.5}
    with pytest.raises(ValueError):
        tables.settings(["a"])
    df, seen = tables.counted_filter(spark.range(10), F.col("id") > 6)
    assert df.count() == 3 and seen.get["rows"] == 7
    assert tables.equal_quota([spark.range(10), spark.range(10, 15)], 4, "id").count() == 8
    b = spark.createDataFrame([(2.0, 4.0, 6.0, 8.0)], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(tables.rescaled(b, F.lit(2.0), dx=F.lit(10), dy=F.lit(20)).first()) == (11, 22, 13, 24)


def test_plan(spark):
    d = spark.createDataFrame([(g, i) for g in "abcd" for i in range(3)], "g string, i int")
    rows = rank.interleaved(d, "g", "i", 2, 1).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(12)) and all(a.g != b.g for a, b in zip(rows, rows[1:], strict=False))


def test_colours_and_crops(spark):
    px = spark.createDataFrame([(0, x, 1) for x in range(3)], "y int, x int, label int")
    c = spark.createDataFrame([(0, x, 255, 255, 255) for x in range(3)], "y int, x int, r int, g int, b int")
    r = raster.median_colour(px, c).first()
    assert r.l == pytest.approx(100, abs=1e-3) and r.ca == pytest.approx(0, abs=1e-2)
    s = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(4) for x in range(4)], "y int, x int, value double")
    a = np.zeros((4, 4))
    for q in raster.crop(s, 0, 0, 4, 4, 4).collect():
        a[q.v, q.u] = q.value
    assert (a == np.pad(np.add.outer(10.0 * np.arange(4), np.arange(4)), 2, mode="reflect")[:4, :4]).all()
    assert raster.masked_resample(s, 2).count() == 4
    assert raster.laplacian(s).where("texture > 0").count() > 0 and raster.hillshade(s).where("shade between 0 and 1").count() == 16
    t = raster.target_maps(px, 4, 4).collect()
    assert all(x.border == 1 for x in t) and max(x.centre for x in t) == 1.0
    p = spark.createDataFrame([("f", "s", 2.0, 0.9, 0, 0, 4.0), ("f", "s", 4.0, 0.9, 0, 0, 4.0), ("f", "s", 0.1, 0.9, 0, 0, 9.0)], "folder string, stem string, shift double, overlap double, y int, x int, value double")
    assert raster.pooled_parallax(p, 1.0, 0.5).first().value == 1.5
    ring = raster.ring_contrast(px, s.withColumn("value", F.lit(1.0)), 1, 2)
    assert ring.first().contrast == 0.0


def test_windows(spark, tmp_path):
    (tmp_path / "a__b.png").write_bytes(codecs.png_encode(np.array([[0, 255], [51, 102]]), 8))
    s = readers.depth_pngs(spark, str(tmp_path), "m")
    assert s.first()["values"] == pytest.approx([0, 1, 0.2, 0.4])
    assert readers.window(s, 0, 0, 2, 2, (1, 1)).first()["values"] == pytest.approx([0.4])
    assert readers.surface_pixels(s).where("y = 1 AND x = 0").first().value == pytest.approx(0.2)

"""File formats: byte-level round trips, and readers over files written here."""

import json
import sqlite3
import struct

import numpy as np
import pytest

from crownlake import schema
from crownlake.sources import codecs, readers, writers
from crownlake.streaming import labels


def test_png16_round_trip():
    a = np.array([[0, 1, 300], [65535, 44, 0]], np.uint16)
    assert (codecs.png_decode(codecs.png_encode(a)) == a).all()
    assert (codecs.png_decode(codecs.png_encode(a & 255, 8)) == (a & 255)).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import zlib

    r = np.random.default_rng(kind)
    a = r.integers(0, 65536, (6, 5)).astype(">u2")
    raw = a.view(np.uint8).reshape(6, -1).astype(int)
    lines = b""
    for y in range(6):
        line = []
        for x in range(10):
            left, up = (raw[y, x - 2] if x > 1 else 0), (raw[y - 1, x] if y else 0)
            c = raw[y - 1, x - 2] if y and x > 1 else 0
            p = left + up - c
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - c), 2, c))[2]
            line.append((raw[y, x] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        lines += bytes([kind, *line])

    def chunk(k, b):
        return struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))

    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (codecs.png_decode(data) == a).all()


def polygon(points, order="<"):
    return struct.pack(order + "BIII", order == "<", 3, 1, len(points)) + b"".join(struct.pack(order + "2d", *p) for p in points)


def test_wkb():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    assert codecs.wkb_rings(polygon(square)) == [square] and codecs.wkb_rings(polygon(square, ">")) == [square]
    multi = struct.pack("<BII", 1, 6, 2) + polygon(square) * 2
    assert codecs.wkb_rings(b"GP\0\x03" + b"\0" * 4 + b"\0" * 32 + multi) == [square, square]


def test_readers(spark, tmp_path):
    (tmp_path / "80m").mkdir()
    a = np.array([[0, 1, 1], [300, 300, 0]], np.uint16)
    (tmp_path / "80m" / "f1_labels.png").write_bytes(codecs.png_encode(a))
    (tmp_path / "80m" / "f1.JPG").write_bytes(b"x")
    (tmp_path / "80m" / "f1.png").write_bytes(b"x")
    (tmp_path / "80m" / "g__h.npy").write_bytes(codecs.npy_encode(np.array([[1, np.nan]], np.float32)))
    runs = readers.label_runs(spark, str(tmp_path))
    assert sorted(tuple(r) for r in runs.collect()) == [("80m", "f1", 1, 0, 1, 3), ("80m", "f1", 300, 1, 0, 2)]
    assert [(r.stem, r.path[-3:]) for r in readers.frames(spark, str(tmp_path), only=["f1"]).collect()] == [("f1", "JPG")]
    s = readers.surfaces(spark, str(tmp_path), "m").first()
    assert (s.folder, s.stem, s.height, s.width, s["values"]) == ("g", "h", 1, 2, [1.0, None])
    sizes = spark.createDataFrame([("80m", "f1", 2, 3), ("80m", "empty", 1, 1)], "folder string, stem string, height int, width int")
    out = {r.name: codecs.png_decode(bytes(r.content)).tolist() for r in writers.label_pngs(runs, sizes).collect()}
    assert out == {"80m/f1_labels.png": a.tolist(), "80m/empty_labels.png": [[0]]}
    assert writers.export(writers.label_pngs(runs, sizes), str(tmp_path / "out")) == 2
    assert (tmp_path / "out" / "80m" / "f1_labels.png").exists()


def test_json_sources(spark, tmp_path):
    coco = {"images": [{"id": 7, "file_name": "x/t1.jpg"}], "annotations": [{"image_id": 7, "segmentation": [[0, 0, 1, 0, 1, 1], [5, 5, 6, 5, 6, 6]]}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    assert [(r.stem, len(r.ring)) for r in readers.coco(spark, str(tmp_path / "c.json")).collect()] == [("t1", 3)]
    assert readers.coco(spark, str(tmp_path / "c.json"), all_parts=True).count() == 2
    (tmp_path / "a.json").write_text(json.dumps({"t1": [[0, 0, 1, 0, 1, 1]], "t2": []}))
    index = readers.annotation_index(spark, str(tmp_path / "a.json"))
    assert index.count() == 1 and json.loads(writers.annotations_json(index).first().value) == {"t1": [[0, 0, 1, 0, 1, 1]]}
    (tmp_path / "s.json").write_text(json.dumps({"s1": {"split": "val", "width_px": 3}, "s2": {"split": "test"}}))
    assert [r.site for r in readers.site_index(spark, str(tmp_path / "s.json"), "val").collect()] == ["s1"]
    (tmp_path / "k.json").write_text(json.dumps({"categories": [{"id": 1, "name": "a"}]}))
    assert readers.categories(spark, str(tmp_path / "k.json")).count() == 1
    report = writers.report_json(spark.createDataFrame([("m", 1.5)], "model string, mae double"), "model").first().value
    assert json.loads(report) == {"m": {"mae": 1.5}}


def test_polygon_files(spark, tmp_path):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    db = sqlite3.connect(tmp_path / "z.gpkg")
    db.execute('CREATE TABLE t ("Shape" BLOB, "Label" TEXT)')
    db.execute("INSERT INTO t VALUES (?, 'PIAB')", (b"GP\0\x01" + b"\0" * 4 + polygon(square),))
    db.commit()
    db.close()
    r = readers.gpkg(spark, str(tmp_path), "t").first()
    assert (r.label, r.feature, [tuple(p) for p in r.ring]) == ("PIAB", 0, square)
    body = struct.pack("<i4dii", 5, 0, 0, 4, 4, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in square)
    (tmp_path / "site.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    head = struct.pack("<B3BIHH20x", 3, 0, 0, 0, 1, 32 + 32 + 1, 11) + b"species".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 + b"\r"
    (tmp_path / "site.dbf").write_bytes(head + b" Picea     "[:11])
    got = readers.species_polygons(spark, str(tmp_path), "species").first()
    assert (got.site, got.species, len(got.ring)) == ("site", "Picea", 4)
    rings = readers.wkb(spark.createDataFrame([(bytearray(polygon(square)),), (None,)], "shape binary"), "shape").collect()
    assert len(rings[0].rings[0]) == 4 and rings[1].rings is None


def test_clouds_and_index(spark, tmp_path):
    pts = spark.createDataFrame([("k", 1.5, 2.0, 3.25, 255, 0, 7), ("k", 0.0, 0.0, 0.0, 1, 2, 3)], "key string, x double, y double, z double, r int, g int, b int")
    las = bytes(writers.cloud_files(pts, "las").first().content)
    assert las[:4] == b"LASF" and len(las) == 227 + 2 * 26 and struct.unpack_from("<I", las, 107)[0] == 2
    x, y, z = struct.unpack_from("<3i", las, 227)
    assert (x, y, z) == (1500, 2000, 3250) and struct.unpack_from("<3H", las, 227 + 20) == (255 * 257, 0, 7 * 257)
    ply = bytes(writers.cloud_files(pts, "ply").first().content)
    assert ply.startswith(b"ply\n") and len(ply.split(b"end_header\n")[1]) == 2 * 15
    path = str(tmp_path / "index")
    spark.createDataFrame([("a", 1), ("b", 2)], "site string, n int").write.parquet(path)
    writers.update_index(spark, path, spark.createDataFrame([("b", 5), ("c", 6)], "site string, n int"), ["site"])
    assert {r.site: r.n for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 5, "c": 6}


def test_canonical(spark):
    df = spark.createDataFrame([("80m", 3, float("nan"))], "ordner string, instanz int, kompaktheit double")
    r = schema.canonical(df, "crowns_shape").first()
    assert (r.folder, r.id, r.compactness, r.source) == ("80m", 3, None, None)


def test_stream(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "f_labels.png").write_bytes(codecs.png_encode(np.array([[0, 2], [2, 2]], np.uint16)))
    q = labels.arriving_zones(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("zones").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.folder, r.stem, r.label, r.area) for r in spark.table("zones").collect()] == [("d", "f", 2, 3)]


def test_geotiffs(spark, tmp_path):
    a = np.arange(7 * 5 * 2, dtype=np.int16).reshape(7, 5, 2) - 9
    affine = (0.5, 0.0, 100.0, 0.0, -0.5, 200.0)
    for k, options in enumerate(({}, {"tile": 16}, {"deflate": True}, {"tile": 32, "deflate": True})):
        back, where = codecs.tiff_decode(codecs.tiff_encode(a, affine, **options))
        assert np.array_equal(back, a) and where == affine
        (tmp_path / f"r{k}.tif").write_bytes(codecs.tiff_encode(a, affine, **options))
    rows = readers.geotiffs(spark, str(tmp_path), (1, 2, 4, 6), nodata=13).collect()
    assert len(rows) == 8
    for r in rows:
        want = [None if v == 13 else float(v) for v in a[2:6, 1:4, r.band - 1].ravel()]
        assert (r.height, r.width, r["values"]) == (4, 3, want) and r.affine == [0.5, 0.0, 100.5, 0.0, -0.5, 199.0]
    # big-endian, one strip, horizontal differences, pixel scale and tie point
    px = np.array([[3, 5, 6], [250, 1, 2]], np.uint8)
    fields = [(256, 3, [3]), (257, 3, [2]), (258, 3, [8]), (259, 3, [1]), (273, 4, [8]), (278, 3, [2]), (279, 4, [6]), (317, 3, [2])]
    body = np.diff(px.astype(np.int16), axis=1, prepend=0).astype(np.uint8).tobytes()
    scale, tie = struct.pack(">3d", 2, 2, 0), struct.pack(">6d", 0, 0, 0, 10, 20, 0)
    at = 14 + 2 + 12 * 10 + 4
    entries = b"".join(struct.pack(">HHI", t, f, 1) + (struct.pack(">HH", v[0], 0) if f == 3 else struct.pack(">I", v[0])) for t, f, v in fields)
    entries += struct.pack(">HHII", 33550, 12, 3, at) + struct.pack(">HHII", 33922, 12, 6, at + 24)
    back, where = codecs.tiff_decode(struct.pack(">2sHI", b"MM", 42, 14) + body + struct.pack(">H", 10) + entries + b"\0" * 4 + scale + tie)
    assert np.array_equal(back[:, :, 0], px) and where == (2.0, 0.0, 10.0, 0.0, -2.0, 20.0)

"""Readers: files of any store that Spark lists, as DataFrames with declared schemas.

Files come through Spark's binaryFile source, so every path that Spark can read works, and are
decoded on the executors in Arrow batches.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crownlake.operators.joins import first_match
from crownlake.sources import codecs

IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
POINT = "array<struct<x:double,y:double>>"


def _names(path: Column, suffix: str = "") -> tuple[Column, Column]:
    """folder and stem of a path, the stem without `suffix` and extension."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    if suffix:
        stem = F.regexp_replace(stem, suffix + "$", "")
    return F.element_at(F.split(path, "/"), -2), stem


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...], recursive: bool = True, content: bool = True) -> DataFrame:
    """(path, folder, stem, content) of the files whose extension, in any case, is among `suffixes`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    any_of = "|".join(s.replace(".", r"\.") for s in suffixes)
    folder, stem = _names(F.col("path"))
    out = raw.where(F.lower("path").rlike(f"({any_of})$"))
    return out.select("path", folder.alias("folder"), stem.alias("stem"), *["content"] * content)


def frames(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGES, only: list[str] | None = None) -> DataFrame:
    """Discovered frames, without their bytes; of several files with one stem the first by path."""
    found = files(spark, path, suffixes, content=False)
    if only is not None:
        found = found.where(F.col("stem").isin(only))
    keys = found.select("folder", "stem").distinct()
    return first_match(keys, found, ["folder", "stem"], ["path"])


def _decoded(df: DataFrame, schema: str, decode) -> DataFrame:
    names = [c.strip().split()[0] for c in _top_level(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                rows = list(decode(r))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def _top_level(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def label_runs(spark: SparkSession, path: str, suffix: str = "_labels") -> DataFrame:
    """Label PNGs as run rows (folder, stem, label, y, x_start, x_end); background has none."""
    import numpy as np

    def decode(r):
        a = codecs.png_decode(r["content"]).astype(np.int64)
        for y in range(a.shape[0]):
            cuts = np.flatnonzero(np.diff(np.concatenate(([-1], a[y], [-1]))))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a[y, s]:
                    yield r["folder"], r["stem"], int(a[y, s]), y, s, e

    raw = files(spark, path, (".png",))
    _, stem = _names(F.col("path"), suffix)
    own = raw.where(F.col("stem").endswith(suffix)).select("folder", stem.alias("stem"), "content")
    return _decoded(own, "folder string, stem string, label int, y int, x_start int, x_end int", decode)


def surfaces(spark: SparkSession, path: str, model: str = "") -> DataFrame:
    """NPY surfaces named folder__stem as rows (model, folder, stem, height, width, values); NaN becomes null."""
    import numpy as np

    def decode(r):
        a = np.atleast_2d(codecs.npy_decode(r["content"])).astype(float)
        folder, _, stem = r["stem"].partition("__")
        yield model, folder, stem or None, a.shape[0], a.shape[1], [None if v != v else v for v in a.ravel().tolist()]

    return _decoded(files(spark, path, (".npy",)), "model string, folder string, stem string, height int, width int, values array<float>", decode)


def coco(spark: SparkSession, path: str, all_parts: bool = False) -> DataFrame:
    """COCO annotations as rings (stem, ring_no, part, ring): the first polygon of each, or all of them."""
    shape = "images array<struct<id:bigint,file_name:string>>, annotations array<struct<image_id:bigint,segmentation:array<array<double>>>>"
    raw = spark.read.schema(shape).json(path, multiLine=True)
    images = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.regexp_replace("i.file_name", r"^.*/|\.[^.]*$", "").alias("stem"))
    notes = raw.select(F.posexplode("annotations").alias("ring_no", "a")).select("ring_no", F.col("a.image_id").alias("image_id"), "a.segmentation")
    parts = notes.select("ring_no", "image_id", F.posexplode("segmentation").alias("part", "flat"))
    if not all_parts:
        parts = parts.where("part = 0")
    return parts.join(images, "image_id").select("stem", "ring_no", "part", ring_of(F.col("flat")).alias("ring"))


def ring_of(flat: Column) -> Column:
    """[x0, y0, x1, y1, ...] as an array of points."""
    at = F.when(F.size(flat) > 1, F.sequence(F.lit(1), F.size(flat) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.element_at(flat, i).alias("x"), F.element_at(flat, i + 1).alias("y")))


def annotation_index(spark: SparkSession, path: str) -> DataFrame:
    """A prepared index {stem: [flat ring, ...]} as rings."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<array<double>>>").alias("m"))
    return raw.select(F.explode("m").alias("stem", "rings")).select("stem", F.posexplode("rings").alias("ring_no", "flat")).select("stem", "ring_no", ring_of(F.col("flat")).alias("ring"))


def site_index(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """{site: {...}} as rows, of one split if given."""
    fields = "split:string,ortho_gsd_m:double,ndsm_gsd_m:double,width_px:int,height_px:int,valid_share:double,zero_share:double,h_p50_m:double,h_p95_m:double,h_max_m:double"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{fields}>>").alias("m"))
    out = raw.select(F.explode("m").alias("site", "s")).select("site", "s.*")
    return out.where(F.col("split") == split) if split else out


def categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("categories array<struct<id:int,name:string>>").json(path, multiLine=True).select(F.inline("categories"))


def gpkg(spark: SparkSession, path: str, table: str, shape: str = "Shape", label: str = "Label") -> DataFrame:
    """Polygons of a GeoPackage table as rings (label, feature, part, ring); only two columns are read from SQLite."""

    def decode(r):
        with closing(sqlite3.connect(":memory:")) as db:
            db.deserialize(r["content"])
            for n, (blob, name) in enumerate(db.execute(f'SELECT "{shape}", "{label}" FROM "{table}"')):
                for k, ring in enumerate(codecs.wkb_rings(blob) if blob else []):
                    yield name, n, k, [{"x": x, "y": y} for x, y in ring]

    return _decoded(files(spark, path, (".gpkg",)), f"label string, feature int, part int, ring {POINT}", decode)


def wkb(df: DataFrame, column: str) -> DataFrame:
    """df with `rings`: outer rings of a WKB column."""
    kind = f"array<{POINT}>"

    @F.pandas_udf(kind)
    def rings(s: pd.Series) -> pd.Series:
        return s.map(lambda b: [[{"x": x, "y": y} for x, y in ring] for ring in codecs.wkb_rings(b)] if b is not None else None)

    return df.withColumn("rings", rings(column))


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Rings (site, record, part, ring) of the shapefiles below path; site is the file's stem."""

    def decode(r):
        for n, k, ring in codecs.shp_rings(r["content"]):
            yield r["stem"], n, k, [{"x": x, "y": y} for x, y in ring]

    return _decoded(files(spark, path, (".shp",)), f"site string, record int, part int, ring {POINT}", decode)


def dbf(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One attribute (site, record, value) of the DBF tables below path."""

    def decode(r):
        for n, row in codecs.dbf_rows(r["content"]):
            yield r["stem"], n, row.get(field)

    return _decoded(files(spark, path, (".dbf",)), "site string, record int, value string", decode)


def species_polygons(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Shapefile rings with the attribute of their record: joined by record number, which both sources carry."""
    return shapefile(spark, path).join(dbf(spark, path, field), ["site", "record"]).withColumnRenamed("value", "species")


def crown_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def depth_pngs(spark: SparkSession, path: str, model: str = "") -> DataFrame:
    """8-bit surfaces named folder__stem, already inverted and scaled to 0..255, as rows like surfaces()."""

    def decode(r):
        a = codecs.png_decode(r["content"])
        folder, _, stem = r["stem"].partition("__")
        yield model, folder, stem or None, a.shape[0], a.shape[1], (a / (255.0 if a.dtype.itemsize == 1 else 65535.0)).ravel().tolist()

    raw = files(spark, path, (".png",)).where(F.col("stem").contains("__"))
    return _decoded(raw, "model string, folder string, stem string, height int, width int, values array<float>", decode)


def geotiffs(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, nodata: float | None = None) -> DataFrame:
    """Rasters (folder, stem, band, height, width, affine, values) of the TIFF files below path, or of a window
    (x0, y0, x1, y1) of each, whose affine is moved along; nodata and NaN become null. Bands count from 1."""
    import numpy as np

    def decode(r):
        a, affine = codecs.tiff_decode(bytes(r["content"]))
        x0, y0, x1, y1 = window or (0, 0, a.shape[1], a.shape[0])
        x0, y0 = max(0, x0), max(0, y0)
        part = a[y0:y1, x0:x1].astype(float)
        if affine:
            p, q, c, s, t, f = affine
            affine = [p, q, c + p * x0 + q * y0, s, t, f + s * x0 + t * y0]
        for k in range(a.shape[2]):
            flat = part[:, :, k].ravel()
            bad = np.isnan(flat) if nodata is None else np.isnan(flat) | (flat == nodata)
            yield r["folder"], r["stem"], k + 1, part.shape[0], part.shape[1], affine, np.where(bad, None, flat).tolist()

    return _decoded(files(spark, path, (".tif", ".tiff")), "folder string, stem string, band int, height int, width int, affine array<double>, values array<double>", decode)


def window(surface_rows: DataFrame, x0: int, y0: int, x1: int, y1: int, out: tuple[int, int]) -> DataFrame:
    """A window of each pre-tiled raster row, averaged down (or repeated up) to `out` (height, width)."""
    import numpy as np

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                a = np.array([np.nan if v is None else v for v in r["values"]], float).reshape(r["height"], r["width"])[y0:y1, x0:x1]
                ys, xs = (np.linspace(0, n, k + 1) for n, k in zip(a.shape, out, strict=True))
                b = np.full(out, np.nan)
                for i in range(out[0]):
                    for j in range(out[1]):
                        c = a[int(ys[i]) : max(int(ys[i]) + 1, int(ys[i + 1])), int(xs[j]) : max(int(xs[j]) + 1, int(xs[j + 1]))]
                        b[i, j] = np.nanmean(c) if np.isfinite(c).any() else np.nan
                rows.append(r | {"height": out[0], "width": out[1], "values": [None if v != v else v for v in b.ravel().tolist()]})
            yield pd.DataFrame(rows, columns=list(pdf.columns))

    return surface_rows.mapInPandas(cut, surface_rows.schema)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Metric histories and summaries in JSON: one row an entry."""
    return spark.read.json(path, multiLine=True)


def surface_pixels(surface_rows: DataFrame) -> DataFrame:
    """Surface rows as (model, folder, stem, y, x, value); missing values have no row."""
    flat = surface_rows.select("model", "folder", "stem", "width", F.posexplode("values").alias("i", "value")).where("value IS NOT NULL")
    return flat.select("model", "folder", "stem", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "value")

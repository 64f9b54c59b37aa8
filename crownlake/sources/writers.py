"""Writers: Parquet by folder, CSV export, label PNG, NPY, PLY, LAS and JSON.

Encoders give (name, content) rows on the executors; export() puts those files into a folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crownlake.operators.tables import upsert
from crownlake.sources import codecs

FILE = "name string, content binary"


def table(df: DataFrame, path: str, by: str | None = "folder") -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """One CSV with a header, for small results."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def label_pngs(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Run rows and sizes (folder, stem, height, width) as 16-bit PNG files <folder>/<stem>_labels.png."""
    packed = runs.groupBy("folder", "stem").agg(F.collect_list(F.struct("label", "y", "x_start", "x_end")).alias("runs"))
    rows = sizes.join(packed, ["folder", "stem"], "left")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.zeros((r.height, r.width), np.uint16)
                for x in r.runs if r.runs is not None else ():
                    a[x["y"], x["x_start"] : x["x_end"]] = x["label"]
                out.append((f"{r.folder}/{r.stem}_labels.png", codecs.png_encode(a)))
            yield pd.DataFrame(out, columns=["name", "content"])

    return rows.mapInPandas(encode, FILE)


def npy_files(surfaces: DataFrame) -> DataFrame:
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                [(f"{r.folder}__{r.stem}.npy", codecs.npy_encode(np.array(r.values_, np.float32).reshape(r.height, r.width))) for r in pdf.itertuples(index=False)], columns=["name", "content"]
            )

    return surfaces.withColumnRenamed("values", "values_").mapInPandas(encode, FILE)


def cloud_files(points: DataFrame, kind: str = "las") -> DataFrame:
    """Points (key, x, y, z, r, g, b) as one PLY or LAS file for each key."""
    encode = {"las": codecs.las_encode, "ply": codecs.ply_encode}[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        content = encode(pdf[["x", "y", "z"]].to_numpy(float), pdf[["r", "g", "b"]].to_numpy())
        return pd.DataFrame([(f"{pdf['key'].iloc[0]}.{kind}", content)], columns=["name", "content"])

    return points.groupBy("key").applyInPandas(run, FILE)


def export(files: DataFrame, folder: str) -> int:
    """Write (name, content) rows below a folder that the driver can reach, one by one; returns their number."""
    n = 0
    for r in files.toLocalIterator():
        path = os.path.join(folder, r.name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(bytes(r.content))
        n += 1
    return n


def annotations_json(rings: DataFrame) -> DataFrame:
    """One row `value`: {stem: [[x0, y0, ...], ...]}."""
    flat = F.flatten(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    per = rings.groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_no", flat.alias("f")))), lambda s: s["f"]).alias("rings"))
    return per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stem", "rings"))))).alias("value"))


def report_json(df: DataFrame, key: str) -> DataFrame:
    """One row `value`: {key: {column: value}}."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), rest.alias("v")))))).alias("value"))


def update_index(spark, path: str, new: DataFrame, keys: list[str]) -> None:
    """Put rows into a Parquet index in place of those with their keys: written beside it, then swapped in."""
    fresh = f"{path}.new"
    upsert(spark.read.parquet(path), new, keys).write.mode("overwrite").parquet(fresh)
    spark.read.parquet(fresh).write.mode("overwrite").parquet(path)

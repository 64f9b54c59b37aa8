"""Polygons to rasters: tiles, affine transforms, filling, class rasters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crownlake.functions import scalar
from crownlake.operators import joins
from crownlake.operators.surfaces import polygon_runs


def to_pixels(ring: Column, affine: tuple[float, ...], scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> Column:
    """World coordinates to pixels of a (scaled, shifted) raster."""

    def one(p: Column) -> Column:
        x, y = scalar.to_pixel(p["x"], p["y"], affine)
        return F.struct((x * scale - dx).alias("x"), (y * scale - dy).alias("y"))

    return F.transform(ring, one)


def tile_grid(spark: SparkSession, width: int, height: int, tile: int, step: int | None = None) -> DataFrame:
    """(tx0, ty0, tx1, ty1) of whole tiles at every step."""
    step = step or tile
    xs = spark.sql(f"SELECT explode(sequence(0, {max(0, width - tile)}, {step})) AS tx0")
    ys = spark.sql(f"SELECT explode(sequence(0, {max(0, height - tile)}, {step})) AS ty0")
    return xs.crossJoin(ys).selectExpr("tx0", "ty0", f"tx0 + {tile} AS tx1", f"ty0 + {tile} AS ty1")


def rings_in_tiles(rings: DataFrame, tiles: DataFrame, tile: int, whole: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Rings with the tiles that hold their box (or, whole=False, that it meets), in tile coordinates."""
    boxed = rings.withColumn("__b", scalar.ring_box(F.col("ring"))).select("*", F.col("__b.x0").alias("x0"), F.col("__b.y0").alias("y0"), F.col("__b.x1").alias("x1"), F.col("__b.y1").alias("y1")).drop("__b")
    if whole:
        out = joins.contained(boxed, tiles, tile, by)
    else:
        out = joins.intersecting(boxed, tiles.selectExpr("*", "tx0 AS u0", "ty0 AS v0", "tx1 AS u1", "ty1 AS v1"), tile, by).drop("u0", "v0", "u1", "v1")
    shifted = F.transform("ring", lambda p: F.struct((p["x"] - F.col("tx0")).alias("x"), (p["y"] - F.col("ty0")).alias("y")))
    return out.withColumn("ring", shifted).drop("x0", "y0", "x1", "y1")


def filled(rings: DataFrame, keys: Sequence[str], height: int, width: int, least: int = 0) -> DataFrame:
    """Run rows (keys, y, x_start, x_end) of each ring, clipped to height * width; rings with fewer pixels than `least` go."""
    types = dict(rings.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", y int, x_start int, x_end int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                runs = polygon_runs([(p["x"], p["y"]) for p in r["ring"]], height, width)
                if sum(e - s for _, s, e in runs) >= max(1, least):
                    out += [(*[r[k] for k in keys], *x) for x in runs]
            yield pd.DataFrame(out, columns=[*keys, "y", "x_start", "x_end"])

    return rings.select(*keys, "ring").mapInPandas(run, schema)


def class_raster(runs: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Runs of ordered polygons to pixels (by, y, x, label): of several polygons the last one wins."""
    px = runs.withColumn("x", F.explode(F.sequence(F.col("x_start"), F.col("x_end") - 1)))
    return px.groupBy(*by, "y", "x").agg(F.max_by(value, order).alias("label"))

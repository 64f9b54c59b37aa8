"""Rejection rules: margins, visibility, raster validity, texture, slope, camera plausibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crownlake.operators import raster
from crownlake.operators.raster import gradient


def bright_enough(pixels: DataFrame, by: Sequence[str], most_black: float = 0.05) -> DataFrame:
    """Tiles (by) of which at most that share of pixels (r, g, b) is black: no data."""
    black = ((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)).cast("double")
    return pixels.groupBy(*by).agg(F.avg(black).alias("black")).where(F.col("black") <= most_black)


def crowd_between(members: DataFrame, by: Sequence[str], least: int, most: int | None = None) -> DataFrame:
    """Groups with `least` members or more, and `most` at most."""
    out = members.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return out.where(F.col("n") <= most) if most is not None else out


def visible_enough(full_area: Column, seen_area: Column, least: float, share: float) -> Column:
    """Whether both areas reach `least` and enough of the whole is seen."""
    return (full_area >= least) & (seen_area >= least) & (seen_area >= share * full_area)


def valid_heights(surface: DataFrame, by: Sequence[str] = (), low: float = -3.0, high: float = 90.0, cap: float = 60.0, fill_radius: int = 1) -> DataFrame:
    """Heights in (low, high) that lie off the widened exact-zero fill, clipped to 0..cap; others become null."""
    zero = surface.where("value = 0").withColumn("label", F.lit(1))
    near = raster.dilated(zero, fill_radius, by).drop("label").withColumn("__fill", F.lit(True))
    out = surface.join(near, [*by, "y", "x"], "left")
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > low) & (F.col("value") < high) & F.col("__fill").isNull()
    return out.withColumn("value", F.when(good, F.least(F.lit(cap), F.greatest(F.lit(0.0), F.col("value"))))).drop("__fill")


def textured(texture: Column, relief: Column, least_texture: float, least_relief: float | None = None) -> Column:
    """Keep what has texture; where the relief is known it must rise, too."""
    keep = texture >= least_texture
    return keep if least_relief is None else F.when(relief.isNotNull(), keep & (relief >= least_relief)).otherwise(keep)


def steady(surface: DataFrame, gsd_m: float, steepest: float = 8.0, by: Sequence[str] = ()) -> DataFrame:
    """Surface pixels off the widened places where it is steeper than `steepest`: no flying points."""
    sloped = gradient(surface, by)
    steep = sloped.where(F.hypot("gx", "gy") / gsd_m > steepest).withColumn("label", F.lit(1))
    return surface.join(raster.dilated(steep, 1, by).select(*by, "y", "x"), [*by, "y", "x"], "left_anti")


def camera_warning(width: Column, height: Column, wanted: int = 1920, aspect: float = 16 / 9, tolerance: float = 0.02) -> Column:
    """Why an image does not look like the expected camera's, else null."""
    off = F.abs(width / height - aspect) >= tolerance
    return F.when(width != wanted, F.format_string("width %d", width)).when(off, F.format_string("aspect %.3f", width / height))

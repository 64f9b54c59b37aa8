"""Height and depth: anchors, field of view from known altitudes, evaluation by variant and site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crownlake.functions import scalar
from crownlake.operators import joins, metrics, tables


def anchored(pixels: DataFrame, by: Sequence[str], depth: str = "d_pred", altitude: str = "altitude_m") -> DataFrame:
    """Depth scaled so that its 95th percentile is the altitude."""
    p = pixels.groupBy(*by).agg(F.percentile(depth, 0.95).alias("__p"))
    return pixels.join(p, list(by)).withColumn("d_anchor", F.try_divide(F.col(depth) * F.col(altitude), F.col("__p"))).drop("__p")


def oracle_scaled(pixels: DataFrame, by: Sequence[str], depth: str = "d_pred", truth: str = "d_gt") -> DataFrame:
    """Depth scaled by the ratio of medians: what no method knows in practice."""
    p = pixels.groupBy(*by).agg(F.try_divide(F.median(truth), F.median(depth)).alias("__s"))
    return pixels.join(p, list(by)).withColumn("d_oracle", F.col(depth) * F.col("__s")).drop("__s")


def known_altitude(folder: Column, override: Column, default: float | None = None) -> tuple[Column, Column]:
    """Altitude and where it comes from: override, the folder's name, the default. 0 counts as missing."""
    return joins.prioritised([("override", override), ("folder", scalar.altitude_decimal(folder)), ("default", F.lit(default).cast("double"))])


def calibrated(frames: DataFrame, ground: float = 0.917, bias: float = 0.945) -> DataFrame:
    """frames (inv_p95, altitude_known): k_est = ground / bias * altitude / p95(1 / D) ... as fov_est.

    One percentile serves every k, since p95(k / D) = k * p95(1 / D). Unknown or zero: null.
    """
    known = F.col("altitude_known").isNotNull() & (F.col("altitude_known") > 0) & (F.col("inv_p95") > 0)
    k = F.when(known, F.lit(ground / bias) * F.col("altitude_known") / F.when(F.col("inv_p95") > 0, F.col("inv_p95")))
    return frames.withColumn("k_est", k).withColumn("fov_est", F.when(k > 0, scalar.fov_of(F.when(k > 0, k))))


def fov_consistency(frames: DataFrame) -> DataFrame:
    """Per model and folder: frames, known altitude, median and deviation of fov_est; then the spread over folders of a model."""
    own = frames.where(F.col("fov_est").isNotNull()).groupBy("model", "folder").agg(
        F.count("*").alias("n"), F.min("altitude_known").alias("altitude"), F.median("fov_est").alias("fov"), F.stddev_samp("fov_est").alias("std")
    )
    wide = own.groupBy("model").agg((F.max("fov") - F.min("fov")).alias("range"))
    wide = wide.withColumn("verdict", F.when(F.col("range") < 5, "good").when(F.col("range") < 12, "fair").otherwise("poor"))
    return own.join(wide, "model")


def variants(pixels: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row for each pixel and variant: every variant sees the same pixels."""
    return pixels.withColumn("__v", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).cast("double").alias("pred")) for n, c in columns.items()]))).select("*", "__v.variant", "__v.pred").drop("__v")


def depth_report(pixels: DataFrame, columns: dict[str, str], truth: str = "d_gt", height_bins: Sequence[float] = (0, 40, 70, 200)) -> tuple[DataFrame, DataFrame]:
    """Metrics by variant: mean over sites of the sites' means with the deviation between sites, and means by bin of altitude.

    pixels: crop, site, altitude_m, the truth and the columns of the variants; the site is the statistical unit.
    """
    long = variants(pixels, columns).withColumn("truth", F.col(truth).cast("double"))
    rows = metrics.error_metrics(long, ["variant", "crop", "site", "altitude_m"])
    names = ["absrel", "mae", "rmse", "bias", "delta125", "scale_error"]
    sites = rows.groupBy("variant", "site").agg(*[F.avg(c).alias(c) for c in names])
    overall = sites.groupBy("variant").agg(F.count("*").alias("sites"), *[F.avg(c).alias(c) for c in names], F.stddev_samp("absrel").alias("absrel_std"))
    bins = rows.withColumn("bin", tables.binned(F.col("altitude_m"), list(height_bins))).where("bin is not null").groupBy("variant", "bin").agg(F.count("*").alias("crops"), *[F.avg(c).alias(c) for c in names])
    return overall, bins


def best_route(checks: DataFrame, by: Sequence[str], metric: str = "mae_m") -> DataFrame:
    """Mean metric of each parameter setting, then the best setting of each route (ties: by the settings)."""
    means = checks.groupBy("route", *by).agg(F.avg(metric).alias(metric), F.count("*").alias("n"))
    return tables.first_row(means, ["route"], [F.col(metric), *[F.col(c) for c in by]])


def look_at(eye: tuple[float, float, float], target: tuple[float, float, float], x: Column, y: Column, z: Column, focal: float) -> tuple[Column, Column, Column]:
    """Perspective projection (u, v, depth) of points seen from eye towards target, z up."""
    import numpy as np

    forward = np.subtract(target, eye) / np.linalg.norm(np.subtract(target, eye))
    right = np.cross(forward, (0.0, 0.0, 1.0))
    right = right / np.linalg.norm(right) if np.linalg.norm(right) > 1e-9 else np.array([1.0, 0.0, 0.0])
    up = np.cross(right, forward)
    rel = (x - eye[0], y - eye[1], z - eye[2])

    def along(axis) -> Column:
        return sum((r * float(a) for r, a in zip(rel, axis, strict=True)), F.lit(0.0))

    depth = along(forward)
    return F.try_divide(along(right) * focal, depth), F.try_divide(along(up) * focal, depth), depth

"""Label rasters as relations: pixels (y, x, label), runs, zones, adjacency, tiles.

Pixel tables are sparse: background has no row. `by` names the columns that tell frames apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crownlake.functions.scalar import diameter

#: Right, below, below right, below left.
FORWARD = ((0, 1), (1, 0), (1, 1), (1, -1))


def runs(pixels: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Run-length rows (label, y, x_start, x_end half-open): the recommended physical form."""
    w = W.partitionBy(*by, "y", label).orderBy("x")
    own = pixels.withColumn("__g", F.col("x") - F.row_number().over(w))
    return own.groupBy(*by, label, "y", "__g").agg(F.min("x").alias("x_start"), (F.max("x") + 1).alias("x_end")).drop("__g")


def pixels_of(run_rows: DataFrame) -> DataFrame:
    return run_rows.withColumn("x", F.explode(F.sequence(F.col("x_start"), F.col("x_end") - 1))).drop("x_start", "x_end")


def zonal(pixels: DataFrame, by: Sequence[str] = (), label: str = "label", least: int = 0) -> DataFrame:
    """Area, centroid and half-open box of each label."""
    out = pixels.groupBy(*by, label).agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"),
    )
    return out.where(F.col("area") >= least) if least else out


def zonal_runs(run_rows: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """zonal() from runs, without making pixels."""
    n = F.col("x_end") - F.col("x_start")
    mid = (F.col("x_start") + F.col("x_end") - 1) / 2
    return run_rows.groupBy(*by, label).agg(
        F.sum(n).alias("area"), (F.sum(n * mid) / F.sum(n)).alias("cx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"),
        F.min("x_start").alias("x0"), F.min("y").alias("y0"), F.max("x_end").alias("x1"), (F.max("y") + 1).alias("y1"),
    )


def region_properties(pixels: DataFrame, by: Sequence[str] = (), label: str = "label", value: str | None = None) -> DataFrame:
    """Area, centroid, equivalent diameter, axis lengths of the ellipse with the same moments, and of a value the maximum and mean."""
    aggs = [F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("__xx"), F.var_pop("y").alias("__yy"), F.covar_pop("x", "y").alias("__xy")]
    if value:
        aggs += [F.max(value).alias("value_max"), F.avg(value).alias("value_mean")]
    out = pixels.groupBy(*by, label).agg(*aggs)
    xx, yy = F.col("__xx") + 1 / 12, F.col("__yy") + 1 / 12
    half, root = (xx + yy) / 2, F.sqrt(F.pow((xx - yy) / 2, 2) + F.col("__xy") * F.col("__xy"))
    out = out.withColumn("diameter", diameter(F.col("area"))).withColumn("major", 4 * F.sqrt(half + root)).withColumn("minor", 4 * F.sqrt(F.greatest(half - root, F.lit(0.0))))
    return out.drop("__xx", "__yy", "__xy")


def coverage(pixels: DataFrame, size: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of the frame's pixels that any mask covers."""
    return pixels.select(*by, "y", "x").distinct().groupBy(*by).agg((F.count("*") / F.first(size)).alias("coverage"))


def overlap(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Co-occurrence of labels at equal pixels: (p, t, n, iou)."""
    left, right = a.select(*by, "y", "x", F.col("label").alias("p")), b.select(*by, "y", "x", F.col("label").alias("t"))
    n = left.join(right, [*by, "y", "x"]).groupBy(*by, "p", "t").agg(F.count("*").alias("n"))
    pa, ta = left.groupBy(*by, "p").agg(F.count("*").alias("pa")), right.groupBy(*by, "t").agg(F.count("*").alias("ta"))
    out = n.join(pa, [*by, "p"]).join(ta, [*by, "t"])
    return out.withColumn("iou", F.col("n") / (F.col("pa") + F.col("ta") - F.col("n"))).select(*by, "p", "t", "n", "iou")


def run_overlap(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """overlap() from run rows: intervals of equal rows, bucketed by 64 pixels, without making pixels."""

    def bucketed(df: DataFrame, name: str, s: str, e: str) -> DataFrame:
        own = df.select(*by, F.col("label").alias(name), "y", F.col("x_start").alias(s), F.col("x_end").alias(e))
        return own.withColumn("gx", F.explode(F.sequence(F.floor(F.col(s) / 64), F.floor((F.col(e) - 1) / 64))))

    both = bucketed(a, "p", "ps", "pe").join(bucketed(b, "t", "ts", "te"), [*by, "y", "gx"])
    lo, hi = F.greatest("ps", "ts"), F.least("pe", "te")
    both = both.where((hi > lo) & (F.floor(lo / 64) == F.col("gx")))
    n = both.groupBy(*by, "p", "t").agg(F.sum(hi - lo).alias("n"))

    def areas(df: DataFrame, name: str, area: str) -> DataFrame:
        return df.groupBy(*by, F.col("label").alias(name)).agg(F.sum(F.col("x_end") - F.col("x_start")).alias(area))

    out = n.join(areas(a, "p", "pa"), [*by, "p"]).join(areas(b, "t", "ta"), [*by, "t"])
    return out.withColumn("iou", F.col("n") / (F.col("pa") + F.col("ta") - F.col("n"))).select(*by, "p", "t", "n", "iou")


def majority(pixels: DataFrame, classes: DataFrame, by: Sequence[str] = (), background: Sequence[int] = (0,), least_coverage: float = 0.5, least_purity: float = 0.7) -> DataFrame:
    """Class of each label from a class raster: the most frequent one outside background (ties: the lower),
    coverage (share of pixels with a class), purity (share of the class among them) and usable."""
    both = pixels.select(*by, "y", "x", "label").join(classes.select(*by, "y", "x", F.col("label").alias("class_id")), [*by, "y", "x"], "left")
    counts = both.groupBy(*by, "label", "class_id").agg(F.count("*").alias("n"))
    area = counts.groupBy(*by, "label").agg(F.sum("n").alias("area"))
    own = counts.where(F.col("class_id").isNotNull() & ~F.col("class_id").isin(list(background)))
    own = own.withColumn("labelled", F.sum("n").over(W.partitionBy(*by, "label")))
    own = own.withColumn("__rn", F.row_number().over(W.partitionBy(*by, "label").orderBy(F.desc("n"), "class_id"))).where("__rn = 1")
    out = area.join(own.select(*by, "label", "class_id", "n", "labelled"), [*by, "label"], "left")
    out = out.withColumn("coverage", F.coalesce(F.col("labelled") / F.col("area"), F.lit(0.0))).withColumn("purity", F.coalesce(F.col("n") / F.col("labelled"), F.lit(0.0)))
    return out.withColumn("usable", (F.col("coverage") >= least_coverage) & (F.col("purity") >= least_purity)).drop("n", "labelled")


def saddles(pixels: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Neighbouring label pairs (a < b) with the highest surface value at the first pixel of a contact."""
    near = pixels.select(*by, F.col("label").alias("l1"), F.col(value).alias("s"), "y", "x", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in FORWARD])).alias("o"))
    near = near.select(*by, "l1", "s", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    both = near.join(pixels.select(*by, "y", "x", F.col("label").alias("l2")), [*by, "y", "x"]).where("l1 <> l2")
    return both.groupBy(*by, F.least("l1", "l2").alias("a"), F.greatest("l1", "l2").alias("b")).agg(F.max("s").alias("saddle"))


def prominences(pixels: DataFrame, by: Sequence[str] = (), value: str = "value", span: float = 1.0, least: float = 0.06) -> DataFrame:
    """saddles() with (lower peak - saddle) / span, and whether that separation is suspiciously low."""
    peaks = pixels.groupBy(*by, "label").agg(F.max(value).alias("peak"))
    out = saddles(pixels, by, value)
    for side in ("a", "b"):
        out = out.join(peaks.select(*by, F.col("label").alias(side), F.col("peak").alias(f"peak_{side}")), [*by, side])
    out = out.withColumn("prominence", (F.least("peak_a", "peak_b") - F.col("saddle")) / span)
    return out.withColumn("suspicious", F.col("prominence") < least).drop("peak_a", "peak_b")


def _around(pixels: DataFrame, radius: int, by: Sequence[str]) -> DataFrame:
    """Each pixel's label at every place of the square around it."""
    d = F.sequence(F.lit(-radius), F.lit(radius))
    out = pixels.withColumn("__dy", F.explode(d)).withColumn("__dx", F.explode(d))
    return out.select(*by, "label", (F.col("y") + F.col("__dy")).alias("y"), (F.col("x") + F.col("__dx")).alias("x"))


def dilated(pixels: DataFrame, radius: int = 1, by: Sequence[str] = (), height: int | None = None, width: int | None = None) -> DataFrame:
    """Highest label in the (2r + 1) square around each pixel, within the image if its size is given."""
    out = _around(pixels, radius, by)
    if height is not None:
        out = out.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < height) & (F.col("x") < width))
    return out.groupBy(*by, "y", "x").agg(F.max("label").alias("label"))


def eroded(pixels: DataFrame, height: int, width: int, radius: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Lowest label in the square around each pixel, background counting as 0 and the outside not at all; 0 has no row."""
    seen = _around(pixels, radius, by).groupBy(*by, "y", "x").agg(F.min("label").alias("label"), F.count("*").alias("n"))
    tall = F.least(F.col("y") + radius, F.lit(height - 1)) - F.greatest(F.col("y") - radius, F.lit(0)) + 1
    wide = F.least(F.col("x") + radius, F.lit(width - 1)) - F.greatest(F.col("x") - radius, F.lit(0)) + 1
    return seen.where((F.col("n") == tall * wide) & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).drop("n")


def boundary(pixels: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Label pixels whose 3 x 3 neighbourhood holds different values."""
    high, low = dilated(pixels, 1, by, height, width), eroded(pixels, height, width, 1, by)
    out = pixels.select(*by, "y", "x", "label").join(high.withColumnRenamed("label", "__h"), [*by, "y", "x"]).join(low.withColumnRenamed("label", "__l"), [*by, "y", "x"], "left")
    return out.where(F.col("__h") != F.coalesce("__l", F.lit(0))).drop("__h", "__l")


def labelled(instances: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("score", "inst_id"), ranges: int = 64) -> DataFrame:
    """Column `label`: places 1..N of instances by ascending order columns; equal ones share a place.

    Places are counted in `ranges` ranges of the keys, each a task of its own, and those of the ranges
    before are added. Cuts come from 2,000 keys by hash order; they bear on the tasks' sizes only.
    """
    keys = [*by, *order]
    types = dict(instances.dtypes)
    some = instances.select(*keys).distinct().orderBy(F.xxhash64(*keys), *keys).limit(2000).orderBy(*keys).collect()
    cuts = some[:: max(1, -(-len(some) // ranges))][1:]
    own = F.struct(*keys)
    after = [(own >= F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in keys])).cast("int") for r in cuts]
    t = instances.withColumn("__range", sum(after, F.lit(0)))
    t = t.withColumn("__at", F.dense_rank().over(W.partitionBy(*by, "__range").orderBy(*order)))
    ends = t.groupBy(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__of")).agg(F.max("__at").alias("__n"))
    before = W.partitionBy(*[f"__{c}" for c in by]).orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = t["__range"] == ends["__of"]
    for c in by:
        same = same & t[c].eqNullSafe(ends[f"__{c}"])
    # merge: sizes of files say little about rows, so a table of instances is never broadcast by estimate
    out = t.join(ends.hint("merge"), same).withColumn("label", (F.col("__at") + F.col("__before")).cast("int"))
    return out.select(*[c for c in instances.columns if c != "label"], "label")


def topmost(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The highest label of each pixel."""
    return pixels.groupBy(*by, "y", "x").agg(F.max("label").alias("label"))


def painted(instance_pixels: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("score", "inst_id")) -> DataFrame:
    """Instances to a label map: ids 1..N by ascending order columns, the last one painted wins a pixel.

    Where instances are at hand before their pixels, `labelled`, then pixels, then `topmost` moves less.
    """
    ids = labelled(instance_pixels.select(*by, *order).distinct(), by, order)
    return topmost(instance_pixels.join(ids.hint("merge"), [*by, *order]), by)


def tile_boxes(width: int, height: int, tiles: int, overlap: float = 0.15) -> list[tuple[int, int, int, int]]:
    """A tiles * tiles grid with fractional overlap; up to one tile: the whole image."""
    if tiles <= 1:
        return [(0, 0, width, height)]
    edges = []
    for size in (width, height):
        cell = size / tiles
        margin = cell * overlap
        edges.append([(max(0, int(i * cell - margin)), min(size, int((i + 1) * cell + margin))) for i in range(tiles)])
    return [(x0, y0, x1, y1) for y0, y1 in edges[1] for x0, x1 in edges[0]]


def window_cores(size: int, tile: int, overlap: int) -> list[tuple[int, int, int]]:
    """(origin, core start, core end) of sliding windows along one axis; the last origin is clamped to the image."""
    if size <= tile:
        return [(0, 0, size)]
    step, half = tile - overlap, overlap // 2
    origins = sorted({min(o, size - tile) for o in range(0, size - overlap, step)})
    return [(o, o + half if o else 0, o + tile - half if o + tile < size else size) for o in origins]


def core_owner(df: DataFrame, x: Column, y: Column, width: int, height: int, tile: int, overlap: int) -> DataFrame:
    """Each row with the windows (wx, wy) whose core holds its point."""
    for name, at, size in (("wx", x, width), ("wy", y, height)):
        owners = [F.when((at >= a) & (at < b), F.lit(o)) for o, a, b in window_cores(size, tile, overlap)]
        df = df.withColumn(name, F.explode(F.array_compact(F.array(*owners))))
    return df


def nearest(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], by: Sequence[str] = ()) -> DataFrame:
    """Nearest-neighbour resize of a label raster from (height, width) `size` to `to`."""
    (h, w), (nh, nw) = size, to

    def targets(c: str, old: int, new: int) -> Column:
        lo, hi = F.ceil(F.col(c) * new / old), F.ceil((F.col(c) + 1) * new / old) - 1
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    out = pixels.withColumn("__y", F.explode(targets("y", h, nh))).withColumn("__x", F.explode(targets("x", w, nw)))
    return out.select(*by, "label", F.col("__y").cast("int").alias("y"), F.col("__x").cast("int").alias("x"))


def masked_resample(values: DataFrame, factor: int, by: Sequence[str] = (), least: float = 0.99) -> DataFrame:
    """Mean of the valid values of each factor * factor block that is valid to the share `least`; null is invalid."""
    own = values.withColumn("y", F.floor(F.col("y") / factor)).withColumn("x", F.floor(F.col("x") / factor))
    out = own.groupBy(*by, "y", "x").agg(F.avg("value").alias("value"), (F.count("value") / (factor * factor)).alias("weight"))
    return out.where(F.col("weight") >= least)


def filled_mean(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each pixel over frames; pixels without a value get the mean of all values."""
    own = values.groupBy(*by, "y", "x").agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("value").alias("c"))
    total = own.groupBy(*by).agg(F.try_divide(F.sum("s"), F.sum("c")).alias("whole"))
    joined = own.join(total, list(by)) if by else own.crossJoin(F.broadcast(total))
    return joined.select(*by, "y", "x", F.coalesce("m", "whole").alias("value"))


def gradient(surface: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Central differences (one-sided at the border) gy and gx of a dense surface."""
    for axis, other, name in (("y", "x", "gy"), ("x", "y", "gx")):
        w = W.partitionBy(*by, other).orderBy(axis)
        before, after, here = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
        surface = surface.withColumn(name, F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2))
    return surface


def hillshade(surface: DataFrame, by: Sequence[str] = (), azimuth: float = 315, altitude: float = 45, exaggeration: float = 40) -> DataFrame:
    out = gradient(surface, by)
    slope = F.lit(1.5707963267948966) - F.atan(F.hypot(F.col("gx") * exaggeration, F.col("gy") * exaggeration))
    aspect = F.atan2(-F.col("gx"), F.col("gy"))
    az, alt = F.radians(F.lit(360.0 - azimuth + 90)), F.radians(F.lit(float(altitude)))
    shade = F.sin(alt) * F.sin(slope) + F.cos(alt) * F.cos(slope) * F.cos(az - aspect)
    return out.withColumn("shade", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (shade + 1) / 2)))


def laplacian(surface: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """|sum of the four neighbours - 4 * value|; beyond the border the inner neighbour counts again."""
    total = None
    for axis, other in (("y", "x"), ("x", "y")):
        w = W.partitionBy(*by, other).orderBy(axis)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        pair = F.coalesce(before, after, F.col("value")) + F.coalesce(after, before, F.col("value"))
        total = pair if total is None else total + pair
    return surface.withColumn("texture", F.abs(total - 4 * F.col("value")))


def ring_contrast(pixels: DataFrame, surface: DataFrame, radius: int = 4, least: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Mean surface of each label minus that of the ring around it, other labels left out; 0 if the ring has up to `least` pixels."""
    wide = _around(pixels, radius, by).distinct()
    ring = wide.join(pixels.select(*by, "y", "x"), [*by, "y", "x"], "left_anti").join(surface, [*by, "y", "x"]).groupBy(*by, "label").agg(F.avg("value").alias("__r"), F.count("*").alias("__n"))
    own = pixels.join(surface, [*by, "y", "x"]).groupBy(*by, "label").agg(F.avg("value").alias("__m"))
    out = own.join(ring, [*by, "label"], "left")
    return out.select(*by, "label", F.when(F.col("__n") > least, F.col("__m") - F.col("__r")).otherwise(F.lit(0.0)).alias("contrast"))


def touches_inner_edge(x0: Column, y0: Column, x1: Column, y1: Column, tile: tuple[Column, Column, Column, Column], width, height) -> Column:
    """Whether a mask (in tile coordinates) touches a tile border that is no image border: it is cut there."""
    tx0, ty0, tx1, ty1 = tile
    return ((x0 == 0) & (tx0 > 0)) | ((y0 == 0) & (ty0 > 0)) | ((x1 == tx1 - tx0) & (tx1 < width)) | ((y1 == ty1 - ty0) & (ty1 < height))


def median_colour(pixels: DataFrame, colours: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median L*, a* and b* of each label. colours: (by, y, x, r, g, b)."""
    from crownlake.functions.scalar import lab

    both = pixels.join(colours, [*by, "y", "x"])
    parts = lab(F.col("r").cast("double"), F.col("g").cast("double"), F.col("b").cast("double"))
    both = both.select(*by, "label", *[c.alias(n) for c, n in zip(parts, ("l", "ca", "cb"), strict=True)])
    return both.groupBy(*by, "label").agg(*[F.median(c).alias(c) for c in ("l", "ca", "cb")])


def reflected(at: Column, size: int) -> Column:
    """Index of a border mirrored without its edge pixel."""
    period = max(1, 2 * (size - 1))
    p = F.pmod(at, F.lit(period))
    return F.when(p < size, p).otherwise(period - p).cast("int")


def crop(surface: DataFrame, cx: int, cy: int, side: int, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """A side * side window around a centre; beyond the image its mirror counts. Gives (by, v, u, value)."""
    spark = surface.sparkSession
    base = spark.range(side * side).select((F.floor(F.col("id") / side)).cast("int").alias("v"), (F.col("id") % side).cast("int").alias("u"))
    base = base.withColumn("y", reflected(F.col("v") + (cy - side // 2), height)).withColumn("x", reflected(F.col("u") + (cx - side // 2), width))
    return surface.join(F.broadcast(base), ["y", "x"]).select(*by, "v", "u", "value")


def pooled_parallax(pairs: DataFrame, least_shift: float, least_overlap: float, by: Sequence[str] = ("folder", "stem")) -> DataFrame:
    """Maps of pairs with enough shift and overlap, each divided by its shift, then their mean at each pixel.

    pairs: (by, partner, shift, overlap, y, x, value).
    """
    good = pairs.where((F.col("shift") >= least_shift) & (F.col("overlap") >= least_overlap))
    return good.groupBy(*by, "y", "x").agg(F.avg(F.col("value") / F.col("shift")).alias("value"), F.count("*").alias("pairs"))


def target_maps(pixels: DataFrame, height: int, width: int, sigma: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """Training targets at each label pixel: interior, border, and a Gaussian around the label's centre."""
    zones = zonal(pixels, by)
    edge = boundary(pixels, height, width, by).select(*by, "y", "x", F.lit(1).alias("border"))
    out = pixels.join(zones.select(*by, "label", "cx", "cy", "area"), [*by, "label"]).join(edge, [*by, "y", "x"], "left")
    d2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    s = sigma * diameter(F.col("area"))
    return out.select(*by, "y", "x", "label", F.coalesce("border", F.lit(0)).alias("border"), (1 - F.coalesce("border", F.lit(0))).alias("interior"), F.exp(-d2 / (2 * s * s)).alias("centre"))

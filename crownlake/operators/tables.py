"""Operators on crown and metric tables: filters, grouped summaries, pivots, top-k, unions.

Groups follow the source's convention that rows with a null key belong to no group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all there."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])) if keys else df


def shape_filter(df: DataFrame, crown_px: float, *, low: float = 0.12, high: float = 5.0, compact: float = 0.25, solid: float | None = None, axis: float | None = None) -> DataFrame:
    """Area between low and high times the circle of crown_px, and at least so compact, solid and round."""
    expected = math.pi * (crown_px / 2) ** 2
    keep = F.col("area_px").between(low * expected, high * expected) & (F.col("compactness") >= compact)
    if solid is not None:
        keep = keep & (F.col("solidity") >= solid)
    if axis is not None:
        keep = keep & (F.coalesce(F.col("aspect_ratio"), F.lit(0.0)) >= axis)
    return df.where(keep)


def inside(x0: Column, y0: Column, x1: Column, y1: Column, width, height, closed: bool = True) -> Column:
    """Whether a crop lies in the image; closed: it may touch the far border."""
    far = (x1 <= width) & (y1 <= height) if closed else (x1 < width) & (y1 < height)
    return (x0 >= 0) & (y0 >= 0) & far


def detection_flags(df: DataFrame, least_score: float, least_side: float, most: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """kept: score and both sides pass, and the row is among the `most` best of its group; no row goes."""
    passes = (F.col("score") >= least_score) & (F.col("box_w") >= least_side) & (F.col("box_h") >= least_side)
    w = W.partitionBy(*by, "__passes").orderBy(F.desc("score"), *order)
    out = df.withColumn("__passes", F.coalesce(passes, F.lit(False))).withColumn("__rank", F.row_number().over(w))
    return out.withColumn("kept", F.col("__passes") & (F.col("__rank") <= most)).drop("__passes", "__rank")


def keep_frequent(df: DataFrame, column: str, least: int) -> DataFrame:
    """Rows whose value has `least` rows or more: counts are summed up before rows move."""
    many = df.groupBy(column).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(column)
    return df.join(many, column, "left_semi")


def group_summary(df: DataFrame, keys: Sequence[str], *, medians: dict[str, str] | None = None, means: dict[str, str] | None = None, digits: int = 2) -> DataFrame:
    """Count, and medians and means (result name -> column), rounded."""
    aggs = [F.count("*").alias("n")]
    aggs += [F.round(F.median(c), digits).alias(n) for n, c in (medians or {}).items()]
    aggs += [F.round(F.avg(c), digits).alias(n) for n, c in (means or {}).items()]
    return keyed(df, keys).groupBy(*keys).agg(*aggs)


def per_distinct(df: DataFrame, key: str, unit: str, digits: int = 1) -> DataFrame:
    """Rows, distinct units, and rows a unit."""
    out = keyed(df, [key]).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(unit).alias("units"))
    return out.withColumn("per_unit", F.round(F.try_divide("n", "units"), digits))


def condition_counts(df: DataFrame, keys: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    return keyed(df, keys).groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence) -> DataFrame:
    """Cross-table of counts over declared values; absent pairs are 0."""
    return keyed(df, [key]).groupBy(key).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def pivot_value(df: DataFrame, key: str, column: str, values: Sequence, value: Column) -> DataFrame:
    return keyed(df, [key]).groupBy(key).pivot(column, list(values)).agg(value)


def strict_pivot(df: DataFrame, key: str, column: str, values: Sequence, value: str) -> DataFrame:
    """A pivot in which each pair has one row; ValueError if a pair has more."""
    if df.groupBy(key, column).count().where("count > 1").limit(1).count():
        raise ValueError(f"several rows for one pair of {key} and {column}")
    return pivot_value(df, key, column, values, F.max(value))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows and share of each value, most frequent first; equal counts by value."""
    total = keyed(df, [column]).groupBy(column).agg(F.count("*").alias("n"))
    whole = total.agg(F.sum("n").alias("__all"))
    out = total.crossJoin(F.broadcast(whole)).select(column, "n", (F.col("n") / F.col("__all")).alias("share"))
    return out.orderBy(F.desc("n"), column).limit(k) if k else out


def top_values(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, with their rank; equal counts by value."""
    counts = keyed(df, [group, value]).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("rank") <= k)


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group in an explicit order."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, by, order, 1).drop("rank")


def binned(x: Column, edges: Sequence[float]) -> Column:
    """Label of the bin (a, b] that x falls in, else null."""
    out = F.lit(None).cast("string")
    for a, b in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when((x > a) & (x <= b), f"{a:g}-{b:g}").otherwise(out)
    return out


def histogram(df: DataFrame, column: str, edges: Sequence[float], mean_of: str | None = None, digits: int = 4) -> DataFrame:
    """Rows of each bin, and the mean of another column; bins without rows don't come out."""
    aggs = [F.count("*").alias("n")] + ([F.round(F.avg(mean_of), digits).alias("mean")] if mean_of else [])
    return df.withColumn("bin", binned(F.col(column), edges)).where("bin is not null").groupBy("bin").agg(*aggs)


def mean_of_means(df: DataFrame, outer: str, inner: str, value: str, digits: int = 4) -> DataFrame:
    """Mean and sample deviation, over the inner groups of each outer group, of the inner means."""
    means = keyed(df, [outer, inner]).groupBy(outer, inner).agg(F.avg(value).alias("m"))
    return means.groupBy(outer).agg(F.count("*").alias("groups"), F.round(F.avg("m"), digits).alias("mean"), F.round(F.stddev_samp("m"), digits).alias("std"))


def spread(df: DataFrame, key: str, value: str, first: str, order: Sequence[Column], good: float = 5, fair: float = 12, digits: int = 4) -> DataFrame:
    """Per group: rows, first value in order, median, deviation, range and the verdict on the range."""
    own = keyed(df, [key])
    out = own.groupBy(key).agg(
        F.count("*").alias("n"), F.min_by(F.col(first), F.struct(*order)).alias("first"), F.round(F.median(value), digits).alias("median"),
        F.round(F.stddev_samp(value), digits).alias("std"), F.round(F.max(value) - F.min(value), digits).alias("range"),
    )
    return out.withColumn("verdict", F.when(F.col("range") < good, "good").when(F.col("range") < fair, "fair").otherwise("poor"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """0 if all weights are 0."""
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(0.0))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_row(df, keys, order)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def to_do(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done.select(*keys), list(keys), "left_anti")


def percentiles(df: DataFrame, keys: Sequence[str], column: str, percents: Sequence[float], digits: int = 4) -> DataFrame:
    """Exact, linearly interpolated percentiles in one pass, as columns p01, p50 ..."""
    p = F.percentile(column, F.array(*[F.lit(float(x) / 100) for x in percents]))
    out = keyed(df, keys).groupBy(*keys).agg(p.alias("__p"))
    return out.select(*keys, *[F.round(F.col("__p")[i], digits).alias(f"p{x:02g}") for i, x in enumerate(percents)])


def robust_unit(df: DataFrame, keys: Sequence[str], column: str, low: float = 2, high: float = 98) -> DataFrame:
    """Column scaled to 0..1 between two percentiles of its group; a constant group gives 0."""
    p = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(low / 100), F.lit(high / 100))).alias("__p"))
    unit = F.try_divide(F.col(column) - F.col("__p")[0], F.col("__p")[1] - F.col("__p")[0])
    return df.join(p, list(keys)).withColumn("unit", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(unit, F.lit(0.0))))).drop("__p")


def class_list(categories: DataFrame, exclude: Sequence[int] = (2, 3, 10)) -> DataFrame:
    """(id, name, index): categories left, numbered from 0 by id."""
    left = categories.where(~F.col("id").isin(list(exclude)))
    return left.withColumn("index", F.row_number().over(W.orderBy("id")) - 1)


def hash_order(column: str, seed: int = 0) -> Column:
    """A sort key that looks random, is the same in every engine and at any partitioning."""
    return F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))))


def hashed_sample(df: DataFrame, by: Sequence[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group, chosen by a hash of their key: the same at any partitioning."""
    w = W.partitionBy(*by).orderBy(hash_order(key, seed), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def group_split(df: DataFrame, group: str, share: float = 0.25, seed: int = 0) -> DataFrame:
    """Whole groups held out by hash order, at least one: column `held_out`."""
    groups = df.select(group).distinct().withColumn("__n", F.row_number().over(W.orderBy(hash_order(group, seed), group)))
    groups = groups.withColumn("held_out", F.col("__n") <= F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy()) * share)))
    return df.join(groups.select(group, "held_out"), group)




def encoded(df: DataFrame, column: str, start: int = 0, name: str = "class_id") -> DataFrame:
    """Class ids by sorted value, from `start`; the dictionary is a small table."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ids = values.withColumn(name, (F.row_number().over(W.orderBy(column)) - 1 + start).cast("int"))
    return df.join(ids, column, "left")


def rescaled(df: DataFrame, factor: Column, boxes: Sequence[str] = ("x0", "y0", "x1", "y1"), dx: Column | None = None, dy: Column | None = None) -> DataFrame:
    """Box columns divided by a factor, then moved by a tile's origin."""
    for c in boxes:
        move = (dx if c[0] == "x" else dy) if dx is not None else None
        df = df.withColumn(c, F.col(c) / factor + (move if move is not None else F.lit(0)))
    return df


def counted_filter(df: DataFrame, keep: Column, name: str = "skipped"):
    """(rows that pass, observation with the number of those that do not): no second pass over df."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count_if(~F.coalesce(keep, F.lit(False))).alias("rows")).where(keep), seen


def settings(pairs: Sequence[str]) -> dict[str, float]:
    """['a=1', 'b=2.5'] as a map; ValueError for a part without '='."""
    out = {}
    for p in pairs:
        key, sign, number = p.partition("=")
        if not sign:
            raise ValueError(f"{p!r} is not KEY=VALUE")
        out[key.strip()] = float(number)
    return out


def binned_share(df: DataFrame, by: Sequence[str], condition: Column, digits: int = 6) -> DataFrame:
    return keyed(df, by).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(condition.cast("double")), digits).alias("share"))


def equal_quota(frames: Sequence[DataFrame], rows: int, key: str, seed: int = 0) -> DataFrame:
    """The same number of rows of every source, chosen by hash order."""
    own = [f.orderBy(hash_order(key, seed), key).limit(rows) for f in frames]
    return union_all(own)

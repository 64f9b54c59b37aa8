"""Window and sequence operators; every order is explicit, ties included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crownlake.operators.tables import hash_order


def numbered(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "id") -> DataFrame:
    """Row number from 1 in each group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def renumbered(df: DataFrame, by: Sequence[str], label: str = "label", name: str = "id") -> DataFrame:
    """Labels 1..K without gaps, in ascending order; background 0 stays."""
    own = df.where(F.col(label) > 0).select(*by, label).distinct()
    own = own.withColumn(name, F.dense_rank().over(W.partitionBy(*by).orderBy(label)))
    return df.join(own, [*by, label], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def even_sample(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """Every (n // k)-th row in order, k at most."""
    w = W.partitionBy(*by)
    out = df.withColumn("__rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    out = out.withColumn("__step", F.greatest(F.lit(1), F.floor(F.col("__n") / k)))
    return out.where((F.col("__rn") % F.col("__step") == 0) & (F.col("__rn") / F.col("__step") < k)).drop("__rn", "__n", "__step")


def head(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    out = df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out.where(F.col("__rn") <= k).drop("__rn")


def modulo_split(df: DataFrame, key: str, modulus: int = 9, val: int = 0, test: int = 4) -> DataFrame:
    """(key, ordinal, split) of the whole list of distinct keys: filter afterwards, so that a partial run keeps the split."""
    keys = df.select(key).distinct().withColumn("ordinal", F.row_number().over(W.orderBy(key)) - 1)
    at = F.pmod(F.col("ordinal"), F.lit(modulus))
    return keys.withColumn("split", F.when(at == val, "val").when(at == test, "test").otherwise("train"))


def running_median(df: DataFrame, by: Sequence[str], order: str, value: str, window: int) -> DataFrame:
    """Median of an odd window; at the ends the edge value is repeated."""
    half = window // 2
    w = W.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    around = F.collect_list(value).over(w.rowsBetween(-half, half))
    rn, n = F.row_number().over(w), F.count("*").over(W.partitionBy(*by))
    out = df.withColumn("__a", around).withColumn("__f", F.first(value).over(whole)).withColumn("__l", F.last(value).over(whole))
    before, after = F.greatest(F.lit(0), half - (rn - 1)), F.greatest(F.lit(0), half - (n - rn))
    out = out.withColumn("__b", before).withColumn("__e", after.cast("int"))
    padded = F.array_sort(F.concat(F.array_repeat("__f", F.col("__b")), "__a", F.array_repeat("__l", F.col("__e"))))
    return out.withColumn("running_median", padded[half]).drop("__a", "__f", "__l", "__b", "__e")


def average_rank(x: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1 in which equal values share the mean of their places."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(W.partitionBy(*by, x)) - 1) / 2


def cumulative_hits(df: DataFrame, by: Sequence[str], score: str, hit: str, order: Sequence) -> DataFrame:
    """rank, tp and fp so far, by descending score."""
    w = W.partitionBy(*by).orderBy(F.desc(score), *order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("rank", F.row_number().over(w)).withColumn("tp", F.sum(F.col(hit).cast("long")).over(run))
    return out.withColumn("fp", F.col("rank") - F.col("tp"))


def densest_window(pixels: DataFrame, size: int, by: Sequence[str] = ()) -> DataFrame:
    """The window of `size` at steps of a quarter with most different labels; ties: top, then left."""
    step = max(1, size // 4)
    offsets = F.sequence(F.lit(0), F.lit((size - 1) // step))
    wide = pixels.withColumn("__i", F.explode(offsets)).withColumn("__j", F.explode(offsets))
    wide = wide.withColumn("top", (F.floor(F.col("y") / step) - F.col("__i")) * step).withColumn("left", (F.floor(F.col("x") / step) - F.col("__j")) * step)
    fits = (F.col("top") >= 0) & (F.col("left") >= 0) & (F.col("y") < F.col("top") + size) & (F.col("x") < F.col("left") + size)
    counts = wide.where(fits).groupBy(*by, "top", "left").agg(F.count_distinct("label").alias("n"))
    w = W.partitionBy(*by).orderBy(F.desc("n"), "top", "left")
    return counts.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def strided(df: DataFrame, by: Sequence[str], order: Sequence, start: int = 0, stride: int = 1, count: int | None = None) -> DataFrame:
    """Every stride-th row from `start` on, `count` at most: frame selection of a video."""
    w = W.partitionBy(*by).orderBy(*order)
    out = df.withColumn("__i", F.row_number().over(w) - 1 - start).where((F.col("__i") >= 0) & (F.col("__i") % stride == 0))
    return (out.where(F.col("__i") < count * stride) if count is not None else out).drop("__i")


def best_setting(df: DataFrame, by: Sequence[str], gain: Column, order: Sequence) -> DataFrame:
    """The row with the highest gain of each group; ties go by an explicit order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(gain), *order))).where("__rn = 1").drop("__rn")


def early_best(df: DataFrame, by: Sequence[str], epoch: str, metric: str, lower: bool = False) -> DataFrame:
    """The first epoch that reaches the best metric, and how many epochs are done."""
    w = W.partitionBy(*by)
    out = df.withColumn("__rn", F.row_number().over(w.orderBy(F.asc(metric) if lower else F.desc(metric), epoch))).withColumn("epochs", F.count("*").over(w))
    return out.where("__rn = 1").drop("__rn")


def interleaved(df: DataFrame, group: str, item: str, groups: int, block: int, seed: int = 0) -> DataFrame:
    """A reading plan: groups in hash order, `groups` of them at a time, each giving `block` items in turn.

    Column `place` orders the rows; neighbours come from different groups while several have items left.
    """
    ranked = df.select(group).distinct().withColumn("__g", F.row_number().over(W.orderBy(hash_order(group, seed), group)) - 1)
    own = df.join(ranked, group).withColumn("__i", F.row_number().over(W.partitionBy(group).orderBy(hash_order(item, seed), item)) - 1)
    own = own.withColumn("__t", F.floor(F.col("__g") / groups))
    # places count within the groups that come together; the rows before them are one number each
    before = own.groupBy("__t").agg(F.count("*").alias("__n"))
    before = before.select("__t", F.coalesce(F.sum("__n").over(W.orderBy("__t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__n"))
    turn = W.partitionBy("__t").orderBy(F.floor(F.col("__i") / block), F.col("__i") % block, "__g")
    out = own.withColumn("place", F.row_number().over(turn)).join(before, "__t")
    return out.withColumn("place", (F.col("place") + F.col("__n") - 1).cast("int")).drop("__g", "__i", "__t", "__n")

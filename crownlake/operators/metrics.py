"""Evaluation algebra: precision and recall, average precision, clustering scores, error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def precision(hits: Column, found: Column) -> Column:
    return hits / F.greatest(F.lit(1), found)


def recall(hits: Column, truth: Column) -> Column:
    return hits / F.greatest(F.lit(1), truth)


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(F.lit(1e-9), p + r)


def micro(df: DataFrame, by: Sequence[str], n_pred: str = "n_pred", n_true: str = "n_true", hits: str = "hits", iou_sum: str | None = None) -> DataFrame:
    """Counts summed over tiles, then precision, recall, f1 and the mean IoU of hits; 0 where nothing is."""
    aggs = [F.sum(n_pred).alias("pred"), F.sum(n_true).alias("gt"), F.sum(hits).alias("hits")]
    if iou_sum:
        aggs.append(F.coalesce(F.try_divide(F.sum(iou_sum), F.sum(hits)), F.lit(0.0)).alias("mean_iou"))
    out = df.groupBy(*by).agg(*aggs)
    out = out.withColumn("precision", precision(F.col("hits"), F.col("pred"))).withColumn("recall", recall(F.col("hits"), F.col("gt")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def ap_linear101(rows: DataFrame, truths: DataFrame, by: Sequence[str], score: str = "score", hit: str = "hit", order: Sequence[str] = (), bins: int = 64) -> DataFrame:
    """Average precision over pooled predictions, linear between recall points at 101 recalls.

    rows: predictions; truths: (by, n_true). Precision is its running maximum from the right; left of
    the first recall stands the first precision, right of the last 0; of equal recalls the last
    counts. No truth: null; no prediction: 0.

    Predictions are ranked in `bins` ranges of score, each a task of its own; counts of the ranges
    before and maxima of those behind are carried over, which takes a few rows a group.
    """
    cuts = rows.groupBy(*by).agg(F.percentile_approx(score, [k / bins for k in range(1, bins)], 1000).alias("__cuts"))
    bin_ = F.when(F.col(score).isNull(), bins).otherwise(F.size(F.filter("__cuts", lambda c: c > F.col(score))))
    run = rows.join(cuts, list(by)).select(*dict.fromkeys([*by, score, *order]), F.col(hit).cast("long").alias("__hit"), bin_.alias("__bin"))
    before = W.partitionBy(*by).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    size = run.groupBy(*by, "__bin").agg(F.count("*").alias("__n"), F.sum("__hit").alias("__hits"))
    size = size.select(*by, "__bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__n", "__hits")])
    own = W.partitionBy(*by, "__bin").orderBy(F.desc(score), *order)
    run = run.withColumn("rank", F.row_number().over(own)).withColumn("tp", F.sum("__hit").over(own.rowsBetween(W.unboundedPreceding, 0)))
    run = run.join(size, [*by, "__bin"]).withColumn("rank", F.col("rank") + F.col("__n")).withColumn("tp", F.coalesce("tp", F.lit(0)) + F.col("__hits"))
    run = run.select(*by, "__bin", "rank", "tp", (F.col("tp") / F.col("rank")).alias("p"))
    behind = W.partitionBy(*by).orderBy(F.desc("__bin")).rowsBetween(W.unboundedPreceding, -1)
    most = run.groupBy(*by, "__bin").agg(F.max("p").alias("__p")).select(*by, "__bin", F.max("__p").over(behind).alias("__later"))
    from_right = W.partitionBy(*by, "__bin").orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    run = run.join(most, [*by, "__bin"]).withColumn("env", F.greatest(F.max("p").over(from_right), "__later"))
    ends = run.groupBy(*by, "tp").agg(F.max_by("env", "rank").alias("p_end"), F.min_by("env", "rank").alias("p_start"))
    top = ends.groupBy(*by).agg(F.max("tp").alias("most"), F.min("tp").alias("least"), F.min_by("p_start", "tp").alias("p_first")).join(truths.where("n_true > 0"), list(by))
    # recall rises by one hit at a time: a piece holds the grid points from its recall up to the next one's
    pieces = ends.select(*by, "tp", "p_end").join(top.select(*by, "most", "n_true"), list(by))
    r, r2 = F.col("tp") / F.col("n_true"), (F.col("tp") + 1) / F.col("n_true")
    low, high, end = F.ceil(F.round(r * 100, 9)), F.ceil(F.round(r2 * 100, 9)), F.col("tp") == F.col("most")
    last_point = F.when(end, F.floor(F.round(r * 100, 9))).otherwise(high - 1)
    pieces = pieces.where(last_point >= low).select(*by, "tp", r.alias("r"), r2.alias("r2"), end.alias("end"), "p_end", F.explode(F.sequence(low, last_point)).alias("k"))
    pieces = pieces.join(ends.select(*by, (F.col("tp") - 1).alias("tp"), F.col("p_start").alias("p2")), [*by, "tp"], "left")
    value = F.when(F.col("end"), F.col("p_end")).otherwise(F.col("p_end") + (F.col("p2") - F.col("p_end")) * (F.col("k") / 100 - F.col("r")) / (F.col("r2") - F.col("r")))
    grid = top.select(*by, (F.col("least") / F.col("n_true")).alias("r_min"), "p_first", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("k"))
    both = grid.join(pieces.select(*by, F.col("k").cast("int").alias("k"), value.alias("p")), [*by, "k"], "left")
    p = F.when(F.col("p").isNotNull(), F.col("p")).when(F.col("k") / 100 < F.col("r_min"), F.col("p_first")).otherwise(F.lit(0.0))
    ap = both.groupBy(*by).agg((F.sum(p) / 101).alias("ap"))
    return truths.join(ap, list(by), "left").select(*by, F.when(F.col("n_true") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cluster_scores(table: DataFrame) -> DataFrame:
    """From (a cluster, b truth, n): purity, NMI with geometric and arithmetic normaliser, adjusted Rand index."""
    n = table.agg(F.sum("n").alias("t"))
    a = table.groupBy("a").agg(F.sum("n").alias("na"), F.max("n").alias("top"))
    b = table.groupBy("b").agg(F.sum("n").alias("nb"))

    def pairs(c: str) -> Column:
        return F.col(c) * (F.col(c) - 1) / 2

    def entropy(df: DataFrame, c: str, name: str) -> DataFrame:
        p = F.col(c) / F.col("t")
        return df.crossJoin(F.broadcast(n)).agg(F.sum(-p * F.ln(p)).alias(f"h_{name}"), F.sum(pairs(c)).alias(f"c_{name}"))

    mutual = table.join(a, "a").join(b, "b").crossJoin(F.broadcast(n))
    p = F.col("n") / F.col("t")
    mutual = mutual.agg(F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(pairs("n")).alias("c_ab"))
    top = a.agg(F.sum("top").alias("top"))
    out = mutual.crossJoin(entropy(a, "na", "a")).crossJoin(entropy(b, "nb", "b")).crossJoin(top).crossJoin(n)
    expected = F.try_divide(F.col("c_a") * F.col("c_b"), pairs("t"))
    return out.select(
        (F.col("top") / F.col("t")).alias("purity"),
        F.coalesce(F.try_divide(F.col("mi"), F.sqrt(F.col("h_a") * F.col("h_b"))), F.lit(0.0)).alias("nmi_geometric"),
        F.coalesce(F.try_divide(F.col("mi"), (F.col("h_a") + F.col("h_b")) / 2), F.lit(0.0)).alias("nmi_arithmetic"),
        F.coalesce(F.try_divide(F.col("c_ab") - expected, (F.col("c_a") + F.col("c_b")) / 2 - expected), F.lit(1.0)).alias("ari"),
    )


def class_recall(df: DataFrame, truth: str, found: str) -> DataFrame:
    """(truth, n, hits, recall, most_frequent prediction) of each class that is present."""
    table = contingency(df, truth, found)
    first = F.row_number().over(W.partitionBy("a").orderBy(F.desc("n"), "b"))
    best = table.withColumn("__rn", first).where("__rn = 1").select("a", F.col("b").alias("most_frequent"))
    out = table.groupBy("a").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("hits"))
    return out.withColumn("recall", F.col("hits") / F.col("n")).join(best, "a").withColumnRenamed("a", "truth")


def accuracy(df: DataFrame, truth: str, found: str) -> DataFrame:
    """accuracy and balanced accuracy (mean recall over the classes that are present)."""
    r = class_recall(df, truth, found)
    return r.agg((F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.sum("n").alias("n"))


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """C / n_c / sum of 1 / n_c: rare classes weigh more, the mean weight is 1."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    whole = counts.agg(F.count("*").alias("classes"), F.sum(1 / F.col("n")).alias("inverse"))
    return counts.crossJoin(F.broadcast(whole)).select(column, "n", (F.col("classes") / F.col("n") / F.col("inverse")).alias("weight"))


def error_metrics(df: DataFrame, by: Sequence[str], found: str = "pred", truth: str = "truth") -> DataFrame:
    """AbsRel, MAE, RMSE, log RMSE, bias, share within a factor of 1.25, ratio of medians; one pass."""
    p, g = F.col(found), F.col(truth)
    ratio = F.greatest(F.try_divide(p, g), F.try_divide(g, p))
    logs = F.when((p > 0) & (g > 0), F.pow(F.ln(F.when(p > 0, p)) - F.ln(F.when(g > 0, g)), 2))
    return df.where(p.isNotNull() & g.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.try_divide(F.abs(p - g), g)).alias("absrel"), F.avg(F.abs(p - g)).alias("mae"), F.sqrt(F.avg((p - g) * (p - g))).alias("rmse"),
        F.sqrt(F.avg(logs)).alias("log_rmse"), F.avg(p - g).alias("bias"), F.avg((ratio < 1.25).cast("double")).alias("delta125"),
        F.try_divide(F.median(p), F.median(g)).alias("scale_error"),
    )


def correlation(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson r; null if either side is constant."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.covar_pop(x, y).alias("__c"), F.stddev_pop(x).alias("__sx"), F.stddev_pop(y).alias("__sy")
    )
    r = F.try_divide(F.col("__c"), F.nullif(F.col("__sx") * F.col("__sy"), F.lit(0.0)))
    return own.select(*by, "n", r.alias("r"))


def ceiling(hits: Column, extra: Column, found: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and f1 if `extra` more objects were found and right."""
    p, r = precision(hits + extra, found + extra), recall(hits + extra, truth)
    return p, r, f1(p, r)

"""Connected components by alternating large-star and small-star steps on the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crownlake.llm.common import stored


def smallest_reachable(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the smallest node that it reaches.

    Each round is written to the shared folder. A node with many neighbours is summed up by its
    minimum before rows move, and neighbours stay rows of the edge table. Nodes without an edge to
    another node don't come out; no edges, no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    done = _mark(now)
    for _ in range(rounds):
        if not done[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        was, done = done, _mark(now)
        if was == done:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

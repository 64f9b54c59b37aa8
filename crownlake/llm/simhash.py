"""SimHash near-duplicates: fingerprints, links within a radius by BK-trees, connected classes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crownlake.llm.bktree import Forest
from crownlake.llm.common import arrow, claim, steps, stored
from crownlake.llm.components import smallest_reachable

WORDS, RADIUS, SEED, BLOCKS = 4, 4, 42, 6
#: Prints of one bucket that go into one tree; those of a bucket with more are dealt to smaller ones.
TREE = 16_384
#: Prints that one forest is built over.
FOREST = 200_000
_PRINT = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def gram_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each word shingle, repeats included, A-Z in lower case; fewer words are one shingle, none are none."""
    own = text.encode().lower().split() if text else []
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    h = xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; no hash, no bit."""
    by = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(by[:, k], minlength=256) @ _BITS
        out |= sum(1 << (8 * k + j) for j in np.flatnonzero(2 * ones > len(hashes)).tolist())
    return out


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return majority_bits(gram_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, print) for each row; print is the unsigned fingerprint in a signed long. Null and wordless texts: 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            for b in steps(batch, "text"):
                prints = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
                yield arrow(_PRINT, b.column("doc_id"), prints.view(np.int64))

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return out.mapInArrow(hashed, "doc_id long, print long")


def bucket_keys(print_: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Prints within the radius agree on at least blocks - radius of the blocks: one key for each choice of those."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for choice in combinations(range(blocks), blocks - radius):
        m = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in choice)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return F.array(*[F.struct(F.lit(i).cast("long").alias("choice"), print_.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])


def _trees(radius: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        held: list[np.ndarray] = []  # rows of choice, bits, print in key order
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if not n:
                return
            rows = np.concatenate(held)
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            cut = len(rows) if last else int(new[-1]) if len(new) else 0
            held, n = [rows[cut:]], len(rows) - cut
            rows, new = rows[:cut], new[new < cut]
            size = np.diff(np.concatenate(([0], new, [cut])))
            rows = rows[np.repeat(size > 1, size)]
            size = size[size > 1]
            if len(rows):
                prints = rows[:, 2].view(np.uint64)
                label = Forest(np.ascontiguousarray(prints), np.repeat(np.arange(len(size)), size)).components(radius)
                moved = np.flatnonzero(label != np.arange(len(label)))
                if len(moved):
                    yield arrow(_EDGE, rows[moved, 2], rows[label[moved], 2])

        for b in batches:
            if b.num_rows:
                held.append(np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1))
                n += b.num_rows
            if n >= FOREST:
                yield from flush(False)
        yield from flush(True)

    return linked


#: Keys a print of the finest buckets that over-full ones are split into.
MOST_KEYS = 256


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """Edges (a, b) that join the same prints as all pairs within the radius do, few for each bucket.

    prints: distinct, one column `print`. Each bucket of prints that agree on some blocks has a
    BK-tree; the edges of a bucket join each print to the first of its class. The prints of a bucket
    above `tree` are dealt anew by more and smaller blocks, of which they must agree on more bits, to
    further trees; no pair is lost, since prints within the radius agree on all blocks but `radius`
    however many there are. Only where over `tree` prints agree on some 38 bits do pairs meet
    otherwise: for a radius up to 4 at the midpoints of their links, all prints within half the radius
    of a print; for a larger radius the bucket is cut up and each two cuts share a tree.
    """
    spark = prints.sparkSession
    session_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    many = prints.count()
    edges: list[DataFrame] = []

    def search(rows: DataFrame, keys: int) -> None:
        dealt = rows.repartition(max(session_parts, many * keys // 2_000_000), "choice", "bits").sortWithinPartitions("choice", "bits", "print")
        edges.append(dealt.select("choice", "bits", "print").mapInArrow(_trees(radius), "a long, b long"))

    while True:
        keys = comb(blocks, radius)
        rows = prints.select("print", F.explode(bucket_keys(F.col("print"), radius, blocks)).alias("key")).select("key.choice", "key.bits", "print")
        full = stored(rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > tree), "over-full")
        if full.isEmpty():
            search(rows, keys)
            break
        search(rows.join(full, ["choice", "bits"], "left_anti"), keys)
        prints = stored(rows.join(full, ["choice", "bits"], "left_semi").select("print").distinct(), "dense")
        if comb(blocks + 2, radius) <= MOST_KEYS:
            blocks += 2
            continue
        if radius <= 4:
            half = (radius + 1) // 2
            masks = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)]
            flips = F.lit([m - (1 << 64) if m >> 63 else m for m in masks]).cast("array<long>")
            met = prints.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("mid"))
            met = met.groupBy("mid").agg(F.min("print").alias("b"), F.collect_list("print").alias("all")).where(F.size("all") > 1)
            edges.append(met.select(F.explode("all").alias("a"), "b").where("a <> b").distinct())
        else:
            cut = rows.join(full.select("choice", "bits", F.ceil(F.col("n") / (tree // 2)).alias("cuts")), ["choice", "bits"])
            own = F.pmod(F.xxhash64("print"), F.col("cuts"))
            cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
            pair = 1 + F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")
            search(cut.select((F.col("choice") + 1000 * pair).alias("choice"), "bits", "print"), keys)
        break
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def near_duplicates(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """(doc_id, print, component_id) for each row of docs (doc_id, text).

    component_id: smallest doc_id that links of at most `radius` differing bits reach, the row's
    own included. Equal texts share a print and are one node. Null doc_ids keep their row and don't
    name a component unless it has no other. Repeated rows stay; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, words), "prints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes.select("print"), radius, blocks, tree)
    classes = smallest_reachable(edges)  # (node, root)
    named = nodes.join(classes.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("print", "root").join(roots, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")

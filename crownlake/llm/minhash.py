"""Near copies by whole shingle sets: SimHash classes and MinHash bands name candidates, the Jaccard
similarity of the sets decides.

Sets of similarity 0.8 have prints that differ in ten bits on average, more than BK-trees can search
at scale, so the bands supply what lies beyond the trees' radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crownlake.llm.common import arrow, claim, steps, stored
from crownlake.llm.components import smallest_reachable
from crownlake.llm.simhash import gram_hashes, links, majority_bits

#: Two sets of similarity s agree on a band with s**ROWS: at 0.8 a pair misses all bands with a chance of 1.2e-7.
BANDS, ROWS = 40, 5
#: Rounds in which a bucket's first set alone is compared with its others, and sets of a bucket of rare
#: shingles that are compared with the others in each round after.
STAR_ROUNDS, MOST_HEADS = 2, 500
_r = np.random.default_rng(42)
_ODD = (_r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MARKED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("print", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("grams", pa.list_(pa.int64()))])


def bands(grams: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set; none for the empty set, which only equals itself."""
    if not len(grams):
        return np.zeros(0, np.int64)
    x = grams.view(np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(x), 2000):
        mixed = x[None, at : at + 2000] * _ODD[:, None] + _ADD[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


def gram_set(text: str | None, words: int) -> np.ndarray:
    """Sorted, different hashes of a text's word shingles; none for a wordless text."""
    return np.unique(gram_hashes(text, words)).view(np.int64)


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _marked(words: int):
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            for b in steps(batch, "text"):
                hashes = [gram_hashes(t, words) for t in b.column(2).to_pylist()]
                sets = [np.unique(h).view(np.int64) for h in hashes]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                prints = np.array([majority_bits(h) for h in hashes], np.uint64).view(np.int64)
                yield arrow(_MARKED, b.column(0), b.column(1), node, prints, pa.array([bands(s) for s in sets], pa.list_(pa.int64())))

    return marked


def _gathered(words: int):
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            for b in steps(batch, "text"):
                yield arrow(_SETS, b.column(0), pa.array([gram_set(t, words) for t in b.column(1).to_pylist()], pa.list_(pa.int64())))

    return gathered


def _round(keys: DataFrame, sets: DataFrame, similarity: float, heads: int) -> tuple[DataFrame, DataFrame]:
    """(place) that stay and (place) that go, from keys (key, place, at, size) of open nodes.

    In each bucket the first `heads` places are held against those behind them. A node stays if it is
    among the first of all its buckets, so that it was held against every other one there, and no
    smaller one is similar; a node goes if it is similar to one that stays. at: place of the key in the node's order of shingles; a pair whose sizes and
    places leave no room for the similarity is not compared.
    """
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where(F.col("rank") <= heads)
    # stored, so that a small one is broadcast by its size and the join with a large one may split a crowded bucket
    first = stored(ranked.select(F.col("key").alias("key1"), F.col("place").alias("head"), F.col("at").alias("at1"), F.col("size").alias("size1")), "heads")
    room = 1 + F.least(F.col("size") - F.col("at"), F.col("size1") - F.col("at1")) - 1
    fits = room + 1e-6 >= similarity / (1 + similarity) * (F.col("size") + F.col("size1"))
    pairs = keys.join(first, (F.col("key") == F.col("key1")) & (F.col("head") < F.col("place")) & fits).select("head", "place").distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("n2"), "grams"), F.col("place.node") == F.col("n2"))
    pairs = pairs.join(sets.select(F.col("node").alias("n1"), F.col("grams").alias("led")), F.col("head.node") == F.col("n1"))
    both = F.size(F.array_intersect("grams", "led"))
    alike = stored(pairs.where(both / (F.size("grams") + F.size("led") - both) >= similarity).select("head", "place"), "alike")
    known = keys.groupBy("place").agg(F.count("*").alias("n")).join(first.groupBy(F.col("head").alias("place")).agg(F.count("*").alias("m")), "place").where("n = m")
    stays = stored(known.select("place").join(alike.select("place"), "place", "left_anti"), "stay")
    drops = stored(alike.join(stays.select(F.col("place").alias("head")), "head", "left_semi").select("place").distinct(), "drop")
    return stays, drops


def _crowded(keys: DataFrame) -> DataFrame:
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return stored(keys.join(many, "key", "left_semi"), "buckets")


def rare_shingles(sets: DataFrame, places: DataFrame, similarity: float) -> DataFrame:
    """(key, place, at, size): the rarest shingles of each set, by which all pairs of the similarity meet.

    Shingles are ordered by the number of these sets that hold them. Two sets of similarity s share
    one of the first n - ceil(s n) + 1 of either, n its size. A shingle that one set alone holds comes
    first and meets nothing, so only the others are counted out.
    """
    long = sets.join(places, F.col("place.node") == F.col("node")).select("place", F.size("grams").alias("size"), F.explode("grams").alias("key"))
    counts = long.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    of = Window.partitionBy("place")
    held = long.join(counts, "key").withColumn("own", F.count("*").over(of)).withColumn("at", F.row_number().over(of.orderBy("many", "key")))
    held = held.withColumn("at", F.col("size") - F.col("own") + F.col("at") - 1)
    return held.where(F.col("at") <= F.col("size") - F.ceil(F.round(F.col("size") * similarity, 9))).select("key", "place", "at", "size")


def survivors(docs: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash) of the rows that no earlier kept one resembles, one for each different shingle set.

    Rows go by rising doc_id, then text_hash: one stays unless the Jaccard similarity of its shingles
    with those of one that stays is `similarity` or more (0.8 at least, for which the bands are made).
    Equal sets are one node (64-bit digest), so wordless texts are. Null doc_ids are left out.

    Candidates share a band or the class of their SimHash prints (links of 4 bits, by BK-trees). First
    each bucket's first node is compared with the others, which settles most copies of one original.
    What is open then, sets that resemble each other less, meets by rare shingles instead, so
    that a large family whose members share its common part alone is not compared pair by pair.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = stored(own.mapInArrow(_marked(words), "doc_id long, text_hash long, node long, print long, bands array<long>"), "shingle-sets")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "node")).alias("place"), F.first("bands").alias("bands"), F.first("print").alias("print"))
    nodes = stored(nodes, "nodes")
    classes = smallest_reachable(links(nodes.select("print").distinct())).withColumnRenamed("node", "print")
    near = nodes.join(classes, "print", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "print")).alias("key"), "place")
    keys = nodes.select(F.explode("bands").alias("key"), "place").unionByName(near)
    keys = _crowded(keys.select("key", "place", F.lit(0).alias("at"), F.lit(0).alias("size")))
    open_ = keys.select("place").distinct()
    picked = own.join(open_.select("place.doc_id", "place.text_hash", F.col("place.node").alias("node")), ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "text")
    sets = stored(picked.mapInArrow(_gathered(words), "node long, grams array<long>"), "sets")
    gone, rounds = nodes.select("place").limit(0), 0
    while not keys.isEmpty():
        if rounds == STAR_ROUNDS:
            keys = _crowded(rare_shingles(sets, keys.select("place").distinct(), similarity))
        stays, drops = _round(keys, sets, similarity, 1 if rounds < STAR_ROUNDS else MOST_HEADS)
        gone = gone.unionByName(drops)
        keys = stored(keys.join(stays.unionByName(drops), "place", "left_anti"), "buckets")
        rounds += 1
    return nodes.select("place").join(gone, "place", "left_anti").select("place.doc_id", "place.text_hash")

"""Interpolated Kneser-Ney character models of several classes, kept in sorted hash arrays.

A text becomes symbols: letters in lower case (one byte each, letters beyond Latin-1 by a hash of
their code point), and one boundary symbol for each run of other characters. A gram of up to
seven symbols is packed into 64 bits, which serves as its hash; grams of all classes share one
sorted array an order, with a row of log probabilities, one a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crownlake.llm.common import claim, steps, stored, utf8

STEP = 128 << 10
#: Numbers (grams times classes) up to which a model is built on the driver and goes to the workers whole;
#: a larger one is built by Spark and goes out in shards of about so many.
WHOLE = 6_000_000
_symbols: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """The symbol of each code point; 0 for what is no letter."""
    if not _symbols:
        out = np.zeros(0x110000, np.uint8)
        for start in range(0, len(out), 1 << 14):
            for c in map(chr, range(start, start + (1 << 14))):
                if c.isalpha():
                    low = ord(c.lower()[0])
                    out[ord(c)] = low if low < 256 else 1 + (low * 2654435761 >> 7) % 255
        _symbols.append(out)
    return _symbols[0]


def symbols(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: symbols with order - 1 boundaries before each text, the places of
    the texts' own symbols among them, and n + 1 offsets of the texts into those places."""
    n = len(off) - 1
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    own = symbol_table()[cps]
    before = np.concatenate((np.zeros(1, np.uint8), own[:-1]))
    starts = chars[:-1]
    before[starts[starts < len(own)]] = 0
    keep = (own != 0) | (before != 0)
    kept = np.concatenate(([0], np.cumsum(keep)))[chars]
    place = np.arange(kept[-1]) + (order - 1) * (1 + np.repeat(np.arange(n), np.diff(kept)))
    out = np.zeros(kept[-1] + (order - 1) * n, np.uint8)
    out[place] = own[keep]
    return out, place, kept


def grams(sym: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """The gram that ends at each place, first symbol highest."""
    key = np.zeros(len(place), np.int64)
    for k in range(order - 1, -1, -1):
        key = key << 8 | sym[place - k]
    return key


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(n, new) if len(new) else n


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """texts (text, class int) -> (key, class, n) over all texts; each task sums its own before rows move."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("knlm")
        held: dict[int, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for c, parts in sorted(held.items()):
                key, n = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), c, np.int32)), pa.array(n.astype(np.int64))], names=["key", "class", "n"])

        for batch in batches:
            for b in steps(batch, "text", STEP):
                sym, place, kept = symbols(*utf8(b.column(b.schema.get_field_index("text"))), order)
                key = grams(sym, place, order)
                own = np.repeat(b.column(b.schema.get_field_index("class")).to_numpy(), np.diff(kept))
                for c in np.unique(own).tolist():
                    k, n = np.unique(key[own == c], return_counts=True)
                    held.setdefault(c, []).append((k, n))
                    size += len(k)
                if size > 1_500_000:
                    for c, parts in held.items():
                        held[c] = [_summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > 1_000_000:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    return texts.mapInArrow(counted, "key long, class int, n long").groupBy("key", "class").agg(F.sum("n").alias("n"))


def gathered(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, classes and counts of all rows on the driver."""
    t = counts.toArrow()
    return tuple(t.column(c).to_numpy() for c in ("key", "class", "n"))


def sampled(df: DataFrame, on: list[str], rows: int, total: int, seed: int = 7) -> DataFrame:
    """About `rows` of `total` rows, or fewer where rows repeat: a hash of the columns `on` decides, and copies count once."""
    if total > rows:
        df = df.where(F.pmod(F.xxhash64(*on, F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * rows / total))
    return df.dropDuplicates(on)


class Model:
    """Log probabilities of a symbol after the order - 1 before it, one for each class.

    p(w | h) = max(c(hw) - D, 0) / c(h) + D * kinds(h) / c(h) * p(w | h without its first symbol);
    below the top order c counts the different symbols before a gram, and at the bottom stands the
    uniform distribution. With shared=True lower orders use the counts of all classes together.
    """

    def __init__(self, key: np.ndarray, cls: np.ndarray, n: np.ndarray, classes: int, order: int, shared: bool = False):
        self.order, self.classes = order, classes
        self.keys, self.logp, self.heads, self.back = {}, {}, {}, {}
        table = {order: self._wide(key, cls, n.astype(np.float64), classes)}
        for k in range(order - 1, 0, -1):
            above, count = table[k + 1]
            kinds = (count > 0).astype(np.float64)
            if shared and k == order - 1:
                kinds = np.repeat(kinds.max(axis=1, keepdims=True), classes, axis=1)
            low = above & ((1 << 8 * k) - 1)
            keys, at = np.unique(low, return_inverse=True)
            sums = np.stack([np.bincount(at, kinds[:, c], len(keys)) for c in range(classes)], axis=1)
            table[k] = keys, sums
        p = None
        for k in range(1, order + 1):
            keys, count = table[k]
            once, twice = (count == 1).sum(axis=0), (count == 2).sum(axis=0)
            d = np.clip(once / np.maximum(1, once + 2 * twice), 0.1, 0.95)
            heads, at = np.unique(keys >> 8, return_inverse=True)
            total = np.stack([np.bincount(at, count[:, c], len(heads)) for c in range(classes)], axis=1)
            kinds = np.stack([np.bincount(at, count[:, c] > 0, len(heads)) for c in range(classes)], axis=1)
            lam = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            lower = np.full((len(keys), classes), 1 / 256) if k == 1 else p[np.searchsorted(table[k - 1][0], keys & ((1 << 8 * (k - 1)) - 1))]
            p = np.maximum(count - d, 0) / np.maximum(total[at], 1) + lam[at] * lower
            self.keys[k], self.logp[k] = keys, np.log(p).astype(np.float32)
            self.heads[k], self.back[k] = heads, np.log(lam).astype(np.float32)

    @staticmethod
    def _wide(key, cls, n, classes):
        keys, at = np.unique(key, return_inverse=True)
        out = np.zeros((len(keys), classes))
        np.add.at(out, (at, cls), n)
        return keys, out

    def score(self, key: np.ndarray) -> np.ndarray:
        """Log probabilities [grams, classes] of packed grams of the model's order; each different gram is looked up once."""
        kinds, which = np.unique(key, return_inverse=True)
        return self._looked_up(kinds)[which]

    def _looked_up(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros((len(key), self.classes), np.float32)
        todo = np.arange(len(key))
        for k in range(self.order, 0, -1):
            own = key[todo] & ((1 << 8 * k) - 1)
            keys = self.keys[k]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                if k == self.order and hit.all():
                    return self.logp[k][at]
                out[todo[hit]] += self.logp[k][at[hit]]
                todo, own = todo[~hit], own[~hit]
                if not len(todo):
                    return out
                head = own >> 8
                at = np.minimum(np.searchsorted(self.heads[k], head), len(self.heads[k]) - 1)
                seen = self.heads[k][at] == head
                out[todo[seen]] += self.back[k][at[seen]]
        out[todo] += np.float32(np.log(1 / 256))
        return out

    @classmethod
    def of(cls, order: int, classes: int, rows: pa.Table) -> Model:
        """A model from finished rows (k, head, key, values): its log probabilities are the values."""
        out = cls.__new__(cls)
        out.order, out.classes = order, classes
        out.keys, out.logp, out.heads, out.back = {}, {}, {}, {}
        k, head, key = (rows.column(c).to_numpy() for c in ("k", "head", "key"))
        values = rows.column("values").combine_chunks().flatten().to_numpy().reshape(-1, classes)
        for at in range(1, order + 1):
            for names, numbers, is_head in ((out.keys, out.logp, False), (out.heads, out.back, True)):
                own = np.flatnonzero((k == at) & (head == is_head))
                own = own[np.argsort(key[own])]
                names[at], numbers[at] = key[own], values[own]
        return out


@dataclass
class Shards:
    """A model whose size is not bounded: rows (k, head, key, pair, values) of a stored table, and ranges of pairs.

    A gram's score hangs on its last two context symbols only as far as tables are concerned: all grams
    and contexts that a backoff from it visits end alike. So these two symbols, the pair, cut the model
    into parts that score their grams alone; tables of one and two symbols (pair -1) are in every part.
    """

    rows: DataFrame
    cuts: list[tuple[int, int]]
    order: int
    classes: int

    def load(self, low: int, high: int) -> Model:
        return Model.of(self.order, self.classes, self.rows.where((F.col("pair") == -1) | (F.col("pair") >= low) & (F.col("pair") < high)).drop("pair").toArrow())


def build(counts: DataFrame, classes: int, order: int, shared: bool = False, *, whole: int = WHOLE) -> Shards:
    """The model of class Model from counts (key, class, n), by joins and sums over all grams."""
    cols = [f"c{i}" for i in range(classes)]
    per_class = [F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)).cast("double").alias(c) for i, c in enumerate(cols)]
    table = {order: stored(counts.groupBy("key").agg(*per_class), "grams")}
    for k in range(order - 1, 0, -1):
        kinds = [(F.col(c) > 0).cast("double") for c in cols]
        if shared and k == order - 1 and classes > 1:
            kinds = [F.greatest(*kinds)] * classes
        low = table[k + 1].select(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key"), *[x.alias(c) for x, c in zip(kinds, cols, strict=True)])
        table[k] = stored(low.groupBy("key").agg(*[F.sum(c).alias(c) for c in cols]), "grams")
    finished, below = [], None
    for k in range(1, order + 1):
        t = table[k]
        once = t.agg(*[F.count_if(F.col(c) == n) for c in cols for n in (1, 2)]).first()
        d = [min(0.95, max(0.1, once[2 * i] / max(1, once[2 * i] + 2 * once[2 * i + 1]))) for i in range(classes)]
        both = t.withColumn("head", F.shiftright("key", 8))
        heads = both.groupBy("head").agg(*[F.sum(c).alias(f"n_{c}") for c in cols], *[F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in cols])
        lam = [F.when(F.col(f"n_{c}") > 0, F.lit(d[i]) * F.col(f"k_{c}") / F.col(f"n_{c}")).otherwise(1.0).alias(f"l_{c}") for i, c in enumerate(cols)]
        heads = stored(heads.select("head", *[f"n_{c}" for c in cols], *lam), "contexts")
        both = both.join(heads, "head")
        if below is not None:
            both = both.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "low")
        lower = [F.lit(1 / 256) if below is None else F.col(f"p_{c}") for c in cols]
        p = [(F.greatest(F.col(c) - d[i], F.lit(0.0)) / F.greatest(F.col(f"n_{c}"), F.lit(1.0)) + F.col(f"l_{c}") * lower[i]).alias(f"q_{c}") for i, c in enumerate(cols)]
        now = stored(both.select("key", *p), "probabilities")
        below = now.select(F.col("key").alias("low"), *[F.col(f"q_{c}").alias(f"p_{c}") for c in cols])
        for rows, key, name, is_head in ((now, "key", "q_", False), (heads, "head", "l_", True)):
            values = F.array(*[F.ln(name + c).cast("float") for c in cols]).alias("values")
            pair = F.col(key) if is_head else F.shiftright(key, 8)
            pair = pair.bitwiseAND(F.lit(0xFFFF)).cast("int") if k > 2 else F.lit(-1)
            finished.append(rows.select(F.lit(k).alias("k"), F.lit(is_head).alias("head"), F.col(key).alias("key"), pair.alias("pair"), values))
    rows = finished[0]
    for x in finished[1:]:
        rows = rows.unionByName(x)
    rows = stored(rows.repartitionByRange("pair").sortWithinPartitions("pair"), "model")  # a shard is read from few files
    cuts, low, held = [], 0, 0
    for r in rows.where("pair >= 0").groupBy("pair").agg(F.count("*").alias("n")).orderBy("pair").toLocalIterator():  # 65,536 pairs at most
        if held and (held + r.n) * classes > whole:
            cuts.append((low, r.pair))
            low, held = r.pair, 0
        held += r.n
    return Shards(rows, [*cuts, (low, 1 << 16)], order, classes)


def with_sums(docs: DataFrame, model: Model | Shards | None, reduce: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """docs as they are for a whole model; for shards with a column __sums: what `reduce` makes of the log
    probabilities [places, classes] and the offsets of the texts into them, an array a text, added up.

    Each shard is a pass over docs, written to the shared folder, so a worker holds one shard at a time.
    """
    if not isinstance(model, Shards):
        return docs
    docs = docs.withColumn("__sums", F.lit(None).cast("binary"))
    for low, high in model.cuts:
        sent = docs.sparkSession.sparkContext.broadcast(model.load(low, high))

        def add(batches: Iterator[pa.RecordBatch], sent=sent, low=low, high=high) -> Iterator[pa.RecordBatch]:
            claim("knlm")
            part = sent.value
            for batch in batches:
                at = batch.schema.get_field_index("__sums")
                for b in steps(batch, "text", STEP):
                    sym, place, kept = symbols(*utf8(b.column(b.schema.get_field_index("text"))), part.order)
                    key = grams(sym, place, part.order)
                    own = np.flatnonzero(((key >> 8 & 0xFFFF) >= low) & ((key >> 8 & 0xFFFF) < high))
                    logp = np.zeros((len(key), part.classes), np.float32)
                    logp[own] = part.score(key[own])
                    sums = [x if o is None else x + np.frombuffer(o, x.dtype) for x, o in zip(reduce(logp, kept), b.column(at).to_pylist(), strict=True)]
                    yield b.set_column(at, b.schema.field(at), pa.array([x.tobytes() for x in sums], pa.binary()))

        docs = stored(docs.mapInArrow(add, docs.schema), "scores")
        sent.unpersist()
    return docs

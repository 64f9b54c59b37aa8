"""Exact substring dedup: windows of words that also start elsewhere, found in FM-index shards.

Equal windows have the same minimiser (the smallest hash of their word 8-grams), so a shard that
holds all passages of a minimiser decides their windows alone. Passages whose minimiser stands at
one place in the corpus are never moved. Passages travel as words, not as hashes, and a shard
compares the words themselves: hashes only choose where equal windows meet.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crownlake.llm.common import arrow, claim, keeps, steps, stored, utf8
from crownlake.llm.fmindex import FMIndex

WINDOW, GRAM = 35, 8
#: Words of one FM-index shard, beyond which the next minimiser opens another.
SHARD_WORDS = 600_000
#: A minimiser at more places than this is hot, whatever the size of the corpus: its windows are counted one by one.
HOT = 2048
#: Hot minimisers up to which they are broadcast; beyond, passages are joined with the counts.
HOT_KEYS = 1_000_000
#: Bytes of the bitmap of repeated minimisers up to which it is broadcast; beyond, passages are joined with them.
BITMAP_BYTES = 64 << 20
#: Repeated windows of hot minimisers up to which they are broadcast; beyond, places are joined with them.
BROADCAST_KEYS = 1_000_000
MULTIPLIER = 0xD6E8FEB86659FD93

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
keeps("substring", _powers.clear)
#: Text bytes that one step of hashing works on.
STEP = 256 << 10
_PASSAGE = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("row2", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])
PASSAGE_DDL = "key long, row long, row2 long, start int, words binary"
_WINDOWS = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("n", pa.int64())])
_MARK = pa.schema([("row", pa.int64()), ("row2", pa.int64()), ("start", pa.int32()), ("mask", pa.int64())])
MARK_DDL = "row long, row2 long, start int, mask long"
FOUND_DDL = "key long, row long, row2 long, start int, mask long, words binary"
_FOUND = pa.schema([("key", pa.int64()), *_MARK, ("words", pa.binary())])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP)
        _powers[:] = [np.cumprod(np.full(size, m, np.uint64)) for m in (np.uint64(MULTIPLIER), np.uint64(pow(MULTIPLIER, -1, 1 << 64)))]
    return _powers


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of all words in texts laid end to end."""
    n = len(raw)
    word = ~_SPACE[raw]
    before, after = np.concatenate(([False], word[:-1])), np.concatenate((word[1:], [False]))
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    return np.flatnonzero(word & ~before[:n]), np.flatnonzero(word & ~after[:n])  # no bytes: no words


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, given their first and last bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(raw)
    up, down = _power_tables(n)
    run = np.cumsum(_BYTE[raw] * up[:n])
    h = (run[end] - np.where(start > 0, run[start - 1], np.uint64(0))) * down[start]
    return _mixed(h + (end - start).astype(np.uint64))


def laid(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words joined by one space, and where each begins; the last number is the end of the whole."""
    size = end - start + 1
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(at[-1], 0x20, np.uint8)
    out[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = raw[~_SPACE[raw]]
    return out.tobytes(), at


def pieces(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, length: np.ndarray) -> list[bytes]:
    """The `length` words from each word `first` on, joined by one space."""
    data, at = laid(raw, start, end)
    return [data[a:b] for a, b in zip(at[first].tolist(), (at[first + length] - 1).tolist(), strict=True)]


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbours of x."""
    size = 1
    while size * 2 <= n:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Minimisers:
    """Of one step of texts: g, hashes of word grams; least, the minimiser of each window; doc, the window's text."""

    def __init__(self, h: np.ndarray, woff: np.ndarray, window: int, gram: int):
        n = len(h) - window + 1
        self.h = h
        if n <= 0:
            self.g = self.least = np.zeros(0, np.uint64)
            self.inside = self.doc = np.zeros(0, np.int64)
            return
        g, size = h, 1
        while size < gram:
            g = g[:-size] * np.uint64(pow(MULTIPLIER, size, 1 << 64)) + g[size:]
            size *= 2
        self.g = _mixed(g) | np.uint64(1)
        self.least = _sliding(self.g, window - gram + 1, np.minimum)
        doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
        self.inside = doc[:n] == doc[window - 1 :]
        self.doc = doc[:n]
        self.least = np.where(self.inside, self.least, np.uint64(0))

    def places(self, span: int) -> np.ndarray:
        """The minimiser at each place that is the smallest of a window: equal windows have theirs at different places."""
        if not len(self.least):
            return self.least
        pad = np.zeros(span - 1, np.uint64)
        most = _sliding(np.concatenate((pad, self.least, pad)), span, np.maximum)
        return self.g[most[: len(self.g)] == self.g]

    def runs(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run with one minimiser in one text, at most `span` long."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(len(self.least), bool)
        new[1:] = (self.least[1:] != self.least[:-1]) | (self.doc[1:] != self.doc[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(self.least)))
        inside = self.inside[start]
        start, size = start[inside], size[inside]
        cuts = -(-size // span)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.repeat(start, cuts) + nth * span
        return start, np.minimum(np.repeat(size, cuts) - nth * span, span)


def _shards(window: int, shard_words: int, tell: bool):
    """Builds FM-index shards over a partition that is sorted by key and gives the repeated windows of each passage.

    With `tell`, passages of a key of which not all have repeated windows come with their words.
    """

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held).combine_chunks()
        kinds = t.column("words").combine_chunks().dictionary_encode()
        which = kinds.indices.to_numpy().astype(np.int64)
        many = len(kinds.dictionary)
        weights = np.bincount(which, weights=t.column("weight").to_numpy(), minlength=many).astype(np.int64)
        own = pc.split_pattern(kinds.dictionary, " ")
        lengths = pc.list_value_length(own).to_numpy().astype(np.int64)
        index = FMIndex(own.flatten().dictionary_encode().indices.to_numpy(), lengths, weights, window)
        seq, count = index.window_counts()
        nth = np.arange(len(seq)) - np.searchsorted(seq, seq)
        mask = np.zeros(many, np.int64)
        np.bitwise_or.at(mask, seq, np.where(count > 1, np.int64(1) << nth, 0))
        mask = mask[which]
        keep = np.flatnonzero(mask)
        if not len(keep):
            return None
        told = pa.nulls(len(keep), pa.binary())
        if tell:
            _, key = np.unique(t.column("key").to_numpy(), return_inverse=True)
            unsure = (np.bincount(key, mask == 0) > 0)[key[keep]]
            if unsure.any():
                words = t.column("words").combine_chunks().take(pa.array(keep)).cast(pa.binary())
                told = pc.if_else(pa.array(unsure), words, pa.scalar(None, pa.binary()))
        return arrow(_FOUND, *(t.column(c).combine_chunks().take(pa.array(keep)) for c in ("key", "row", "row2", "start")), mask[keep], told)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            at = batch.schema.get_field_index("words")
            batch = batch.set_column(at, "words", batch.column(at).cast(pa.large_binary()))
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                key = b.column(b.schema.get_field_index("key")).to_numpy()
                if n >= shard_words:
                    last = held[-1].column(held[-1].schema.get_field_index("key"))[-1].as_py()
                    cut = int(np.searchsorted(key, last, "right"))
                    if cut:
                        held.append(b.slice(0, cut))
                    if cut < b.num_rows:
                        if out := shard(held):
                            yield out
                        held, n, b = [], 0, b.slice(cut)
                    else:
                        continue
                held.append(b)
                n += b.num_rows + pc.sum(pc.count_substring(b.column(b.schema.get_field_index("words")), " ")).as_py()
        if held and (out := shard(held)):
            yield out

    return searched


def repeated_windows(
    texts: DataFrame, *, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT, hot_keys: int = HOT_KEYS,
    bitmap_bytes: int = BITMAP_BYTES, broadcast_keys: int = BROADCAST_KEYS, hash_bits: int = 64,
) -> DataFrame:
    """texts (row, row2, text) -> (row, row2, start, mask): bit i says that the window at word start + i stands elsewhere too.

    row and row2 name a text together; texts that share both must be equal. Shards compare words. The
    windows of a hot minimiser are counted one by one before they are dealt out, so that no shard
    holds all passages of one. `hash_bits` below 64 weakens the hashes of words, which changes no result.
    """
    spark = texts.sparkSession
    span = window - gram + 1
    part_of_hash = np.uint64((1 << hash_bits) - 1)
    own = ("row", "row2", "start")

    def step_minimisers(batches: Iterator[pa.RecordBatch]):
        claim("substring")
        for batch in batches:
            for b in steps(batch, "text", STEP):
                raw, off = utf8(b.column(b.schema.get_field_index("text")))
                start, end = word_spans(raw, off)
                h, woff = word_hashes(raw, start, end) & part_of_hash, np.searchsorted(start, off)
                rows = [b.column(b.schema.get_field_index(c)).to_numpy() for c in own]
                yield rows, woff, Minimisers(h, woff, window, gram), (raw, start, end)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, m, _ in step_minimisers(batches):
            keys, n = np.unique(m.places(span), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    none = F.lit(0).cast("long")
    texts = texts.select("row", "row2", F.lit(0).alias("start"), "text")
    counts = texts.select("text", none.alias("row"), none.alias("row2"), F.lit(0).alias("start")).mapInArrow(counted, "key long, n long")
    counts = stored(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "minimisers")
    hottest = counts.where(F.col("n") > hot).select("key")
    n_keys, n_places, n_hot = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > hot)).first()
    bits = 1 << max(16, int(10 * max(1, n_keys)).bit_length())
    sent, hot_sorted = None, np.zeros(0, np.uint64)
    if bits // 8 <= bitmap_bytes and n_hot <= hot_keys:
        sent = spark.sparkContext.broadcast(_bitmap(counts.select("key"), bits))
        hot_sorted = np.sort(hottest.toArrow().column("key").to_numpy().view(np.uint64)) if n_hot else hot_sorted

    def known(keys: np.ndarray) -> np.ndarray:
        if sent is None:
            return np.ones(len(keys), bool)
        at = keys & np.uint64(bits - 1)
        return (sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def is_hot(keys: np.ndarray) -> np.ndarray:
        return np.isin(keys, hot_sorted) if len(hot_sorted) else np.zeros(len(keys), bool)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, woff, m, words in step_minimisers(batches):
            start, size = m.runs(span)
            key = m.least[start]
            use = known(key) & ~is_hot(key)
            start, size, key = start[use], size[use], key[use]
            if len(start):
                doc = m.doc[start]
                yield arrow(_PASSAGE, key.view(np.int64), rows[0][doc], rows[1][doc], (start - woff[doc]).astype(np.int32), pieces(*words, start, size + window - 1))

    def hot_windows(m: Minimisers) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of hot minimisers, and a hash of the words of each. Without a broadcast all are hot."""
        start = np.flatnonzero(m.inside & is_hot(m.least) if sent else m.inside)
        key = np.zeros(len(start), np.uint64)
        for i in range(window):
            key = key * np.uint64(MULTIPLIER) + m.h[start + i]
        return start, _mixed(key).view(np.int64)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different windows of hot minimisers in each step, and how often they stand there."""
        for _, _, m, words in step_minimisers(batches):
            start, key = hot_windows(m)
            if len(start):
                text = pieces(*words, start, np.full(len(start), window))
                n, of = Counter(text), dict(zip(text, key.tolist(), strict=True))
                yield arrow(_WINDOWS, [of[t] for t in n], list(n), list(n.values()))

    def placed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, woff, m, words in step_minimisers(batches):
            start, key = hot_windows(m)
            if len(start):
                doc = m.doc[start]
                yield arrow(_PASSAGE, key, rows[0][doc], rows[1][doc], (rows[2][doc] + start - woff[doc]).astype(np.int32), pieces(*words, start, np.full(len(start), window)))

    def marked_by(repeated: DataFrame):
        keys = spark.sparkContext.broadcast(np.sort(repeated.toArrow().column("key").to_numpy()))

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, woff, m, _ in step_minimisers(batches):
                start, key = hot_windows(m)
                start = start[np.isin(key, keys.value)]
                if len(start):  # up to `span` windows of a text that begin near each other share a mask
                    doc = m.doc[start]
                    at = start - woff[doc]
                    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] // span != at[:-1] // span))))
                    base = at // span * span
                    mask = np.bitwise_or.reduceat(np.int64(1) << (at - base), new)
                    yield arrow(_MARK, rows[0][doc[new]], rows[1][doc[new]], (rows[2][doc[new]] + base[new]).astype(np.int32), mask)

        return marked

    # passages of about 50 words: tasks of some 32 MB, however many the session's setting gives
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, n_places // 100_000)

    def search(passages: DataFrame, tell: bool = False) -> DataFrame:
        dealt = passages.repartition(parts, "key").sortWithinPartitions("key")
        return dealt.mapInArrow(_shards(window, shard_words, tell), FOUND_DDL)

    cold, source = texts.mapInArrow(whole, PASSAGE_DDL), texts
    if sent is None:
        joined = cold.join(counts, "key")
        cold = joined.where(F.col("n") <= hot).drop("n")
        if n_hot:
            source = stored(joined.where(F.col("n") > hot).select(*own, F.col("words").cast("string").alias("text")), "hot-passages")
    one = F.lit(1).cast("long")
    found = search(cold.withColumn("weight", one)).select(*_MARK.names)
    if not n_hot:
        return found
    summed = source.mapInArrow(single, "key long, words binary, n long").groupBy("key", "words").agg(F.sum("n").alias("weight"))
    repeated = search(summed.select("key", none.alias("row"), none.alias("row2"), F.lit(0).alias("start"), "words", "weight"), tell=True)
    repeated = stored(repeated.select("key", "words"), "hot-windows")
    sure, unsure = repeated.where("words is null").select("key").distinct(), repeated.where("words is not null")
    placed = source.mapInArrow(placed_windows, PASSAGE_DDL)
    if sure.count() <= broadcast_keys:
        found = found.unionByName(source.mapInArrow(marked_by(sure), MARK_DDL))
    else:
        found = found.unionByName(placed.join(sure, "key").select(*own, one.alias("mask")))
    if not unsure.isEmpty():  # windows that share a hash with one that stands once
        found = found.unionByName(placed.join(unsure, ["key", "words"], "left_semi").select(*own, one.alias("mask")))
    return found


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bit (key mod bits) is set for each key; built in blocks of 8 kB on the executors."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(b.schema.get_field_index("key")).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            block = (at >> np.uint64(16)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            kinds, first = np.unique(block[order], return_index=True)
            for k, own in zip(kinds.tolist(), np.split(at[order] & np.uint64(0xFFFF), first[1:]), strict=True):
                np.bitwise_or.at(blocks.setdefault(k, np.zeros(8192, np.uint8)), (own >> np.uint64(3)).astype(np.int64), np.uint8(1) << (own & np.uint64(7)).astype(np.uint8))
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([x.tobytes() for x in blocks.values()])], names=["block", "bytes"])

    parts = max(1, min(64, bits >> 22))
    dealt = keys.withColumn("block", F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit(bits - 1)), 16)).repartition(parts, "block")
    out = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(built, "block long, bytes binary").collect():
        out[r.block * 8192 : r.block * 8192 + 8192] |= np.frombuffer(r.bytes, np.uint8)[: bits // 8]
    return out


def drop_repeats(docs: DataFrame, *, keep: list[str] | None = None, window: int = WINDOW, **options) -> DataFrame:
    """keep (all columns by default) with kept_text, n_words, n_removed, kept_sha256, removed spans of words.

    A word goes if a window of `window` words covers it that also starts anywhere else, in the same
    text or another; words are runs of bytes without ASCII white space; kept words are joined by one
    space. Null texts have no words. Repeated rows are each other's copies. What goes from a text
    depends on the corpus and the text alone, so findings come back to it by a 128-bit digest of its
    text and doc_id: nothing hangs on the order of rows, and null or repeated ids do no harm. Result
    columns replace columns of their names; an empty table gives no rows.
    """
    new = ["kept_text", "n_words", "n_removed", "kept_sha256"]
    names = [c for c in (keep or docs.columns) if c not in new]
    base = docs.select(*dict.fromkeys([*names, "text"]))
    content = [F.coalesce(F.col("text").cast("string"), F.lit("")), *[F.col("doc_id").cast("string")] * ("doc_id" in names)]
    named = base.withColumn("__row", F.xxhash64(*content)).withColumn("__row2", F.xxhash64(F.lit(1), *content))
    texts = named.select(F.col("__row").alias("row"), F.col("__row2").alias("row2"), F.col("text").cast("string").alias("text"))
    found = repeated_windows(texts, window=window, **options)
    by_row = found.groupBy(F.col("row").alias("__row"), F.col("row2").alias("__row2")).agg(F.collect_set(F.struct("start", "mask")).alias("__found"))
    both = named.join(by_row, ["__row", "__row2"], "left").drop("__row", "__row2")
    schema = both.select(*names).schema
    for f, kind in zip(new, ("string", "long", "long", "string"), strict=True):
        schema = schema.add(f, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                rows = []
                for t, marks in zip(b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.schema.get_field_index("__found")).to_pylist(), strict=True):
                    own = t.encode().split() if t else []
                    gone = 0
                    if marks:
                        edge = np.zeros(len(own) + 1, np.int64)
                        for m in marks:
                            hit = np.array([i for i in range(m["mask"].bit_length()) if m["mask"] >> i & 1]) + m["start"]
                            np.add.at(edge, hit, 1)
                            np.add.at(edge, hit + window, -1)
                        stays = np.cumsum(edge[:-1]) == 0
                        gone = len(own) - int(np.count_nonzero(stays))
                        kept = b" ".join([own[i] for i in np.flatnonzero(stays).tolist()])
                    else:
                        kept = b" ".join(own)
                    rows.append((kept.decode(), len(own), gone, hashlib.sha256(kept).hexdigest()))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *cols], names=[*names, *new])

    return both.mapInArrow(cut, schema)

"""Benchmark decontamination: an Aho-Corasick automaton over the words of test items.

Its patterns are sequences of word numbers. Each window of an item holds one of the blocks that
begin at multiples of half a window, so only these blocks are patterns: the automaton has about one
node a word of the benchmark, and a hit is held against the item's words around the block. Items
shorter than a window are patterns themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crownlake.llm.common import claim, steps, stored

WINDOW = 13
#: Bytes of item text that one automaton is made of (about six times as much memory a worker); more
#: items make further automata, each a pass of its own over the documents.
BLOCK_BYTES = 32 << 20
#: Words of one lane: texts are cut into lanes that the automaton reads side by side.
LANE = 128
#: Occurrences of blocks that are held against their items at a time.
CHECKED = 200_000
#: ASCII letters in lower case, digits and bytes from 0x80 on stay; all other bytes part words.
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
HITS = "array<struct<word:int,length:int,begin:int,end:int,items:array<string>>>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after the other."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - first, length)


class Automaton:
    """Patterns: sequences of numbers from 1 up, laid end to end. Node i + 1 is the end of edge i; edges are
    parent * kinds + number, in rising order, since each level's nodes come after those of the level above."""

    def __init__(self, numbers: np.ndarray, length: np.ndarray, kinds: int):
        first = np.cumsum(length) - length
        self.kinds = kinds  # all numbers, those of texts too, are smaller
        self.most = int(length.max(initial=1))
        at, levels, n = np.zeros(len(length), np.int64), [], 1
        for d in range(self.most):
            own = np.flatnonzero(length > d)
            edge, which = np.unique(at[own] * self.kinds + numbers[first[own] + d], return_inverse=True)
            at[own] = n + which
            levels.append(edge)
            n += len(edge)
        self.edges = np.concatenate(levels) if levels else np.zeros(0, np.int64)
        self.root = np.zeros(self.kinds, np.int32)  # the children of node 0, by number
        self.root[levels[0]] = np.arange(1, len(levels[0]) + 1)
        self.ends = np.argsort(at, kind="stable").astype(np.int32)  # patterns by the node that they end at
        self.end_of = np.searchsorted(at[self.ends], np.arange(n + 1)).astype(np.int32)
        self.fail, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        whole = np.diff(self.end_of) > 0
        node = 1 + len(levels[0])
        for edge in levels[1:]:
            own = np.arange(node, node + len(edge))
            self.fail[own] = fail = self.step(self.fail[edge // self.kinds].astype(np.int64), edge % self.kinds)
            self.link[own] = np.where(whole[fail], fail, self.link[fail])  # the next shorter pattern that ends here
            node += len(edge)
        self.speaks = whole | (self.link > 0)

    def step(self, node: np.ndarray, number: np.ndarray) -> np.ndarray:
        out = np.zeros(len(node), np.int64)
        todo = np.arange(len(node))
        while len(todo):
            at = node[todo] == 0
            out[todo[at]] = self.root[number[todo[at]]]
            todo = todo[~at]
            if not len(todo):
                break
            edge = node[todo] * self.kinds + number[todo]
            i = np.searchsorted(self.edges, edge)
            hit = self.edges[np.minimum(i, len(self.edges) - 1)] == edge
            out[todo[hit]] = i[hit] + 1
            todo = todo[~hit]
            node[todo] = self.fail[node[todo]]
        return out

    def scan(self, numbers: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of each occurrence in texts laid end to end; off: n + 1 offsets of the texts.
        Number 0 stands in no pattern. A lane begins so many words early that its state is right where it counts."""
        size = np.diff(off)
        lanes = -(-size // LANE)
        low = np.repeat(off[:-1], lanes)
        counts = low + LANE * ranges(np.zeros(len(size), np.int64), lanes)
        end = np.minimum(counts + LANE, np.repeat(off[1:], lanes))
        begin = np.maximum(counts - self.most + 1, low)
        order = np.argsort(begin - end, kind="stable")
        begin, counts, length = begin[order], counts[order], (end - begin)[order]
        node = np.zeros(len(order), np.int64)
        where, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in range(int(length.max(initial=0))):
            on = int(np.searchsorted(-length, -t, "left"))
            node = self.step(node[:on].copy(), numbers[begin[:on] + t])
            told = np.flatnonzero(self.speaks[node] & (begin[:on] + t >= counts[:on]))
            told_at, told_node = begin[told] + t, node[told]
            while len(told_at):
                n = self.end_of[told_node + 1] - self.end_of[told_node]
                where.append(np.repeat(told_at, n))
                what.append(self.ends[ranges(self.end_of[told_node].astype(np.int64), n.astype(np.int64))])
                told_node = self.link[told_node].astype(np.int64)
                told_at, told_node = told_at[told_node > 0], told_node[told_node > 0]
        return np.concatenate(where), np.concatenate(what)


class Items:
    """Test items as word numbers, with the automaton of their blocks."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.block = window, (window + 1) // 2
        self.number: dict[bytes, int] = {}
        names, laid = [], []
        for name, text in items:
            own = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int32)
            if len(own):
                names.append(name)
                laid.append(own)
        self.names = names
        self.size = np.array([len(x) for x in laid], np.int64)
        self.words = np.concatenate(laid) if laid else np.zeros(0, np.int32)
        self.first = np.cumsum(self.size) - self.size
        blocks = np.where(self.size < window, 1, self.size // self.block)
        self.item = np.repeat(np.arange(len(names)), blocks)  # of each pattern
        self.at = self.block * ranges(np.zeros(len(names), np.int64), blocks)  # its first word in the item
        self.length = np.where(self.size[self.item] < window, self.size[self.item], self.block)
        self.automaton = Automaton(self.words[ranges(self.first[self.item] + self.at, self.length)].astype(np.int64), self.length, len(self.number) + 1) if names else None

    def find(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word in it, words, item) of all different occurrences of windows, in this order."""
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        none = np.zeros(0, np.int64)
        if self.automaton is None or not off[-1]:
            return none, none, none, none
        get = self.number.get
        numbers = np.fromiter((n for t in texts for n in map(get, t, repeat(0))), np.int32, off[-1])
        last, pattern = self.automaton.scan(numbers, off)
        start = last - self.length[pattern] + 1
        item, text = self.item[pattern], np.searchsorted(off, last, "right") - 1
        whole = self.size[item] < self.window
        found = [np.stack((text[whole], start[whole] - off[text[whole]], self.length[pattern[whole]], item[whole]))]
        part = np.flatnonzero(~whole)
        before = self.window - self.block
        span = np.arange(-before, self.window)
        for k in range(0, len(part), CHECKED):
            own = part[k : k + CHECKED]
            doc, of, at = text[own], item[own], self.at[pattern[own]]
            here, there = start[own, None] + span, at[:, None] + span
            inside = (here >= off[doc, None]) & (here < off[doc + 1, None]) & (there >= 0) & (there < self.size[of, None])
            same = inside & (numbers[np.where(inside, here, 0)] == self.words[np.where(inside, self.first[of, None] + there, 0)])
            run = np.cumsum(np.concatenate((np.zeros((len(own), 1), np.int32), same), axis=1), axis=1)
            hit, shift = np.nonzero(run[:, self.window :] - run[:, : before + 1] == self.window)
            found.append(np.stack((doc[hit], start[own[hit]] + shift - before - off[doc[hit]], np.full(len(hit), self.window), of[hit])))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans in the original text of (first word, words) hits."""
    raw = text.encode()
    kept = np.frombuffer(raw.translate(NORMAL), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], kept, [False])).astype(np.int8)))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[edge[2 * a]]), int(chars[edge[2 * (a + n - 1) + 1]])) for a, n in hits]


def _scan(docs: DataFrame, items: DataFrame, window: int, block_bytes: int, schema: StructType, finish: Callable) -> DataFrame:
    """finish(batch, hits, words of each text) makes the rows of `schema` once all blocks of items are through."""
    spark = docs.sparkSession
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).distinct()
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total * 5 // (block_bytes * 4))) if total > block_bytes else 1
    out = docs.withColumn("hits", F.array().cast(HITS))
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast(Items([(r.i, r.t) for r in rows], window))
        last = k + 1 == blocks

        def scanned(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            claim("decontam")
            tests = sent.value
            for batch in batches:
                for b in steps(batch, "text"):
                    texts = b.column(b.schema.get_field_index("text")).to_pylist()
                    split = [words(t) for t in texts]
                    hits = b.column(b.schema.get_field_index("hits")).to_pylist()
                    rows: dict[int, dict[tuple[int, int], list[str]]] = {}
                    for d, at, n, item in zip(*(x.tolist() for x in tests.find(split)), strict=True):
                        rows.setdefault(d, {}).setdefault((at, n), []).append(tests.names[item])
                    for d, by in rows.items():
                        new = [{"word": at, "length": n, "begin": a, "end": e, "items": sorted(set(by[at, n]))} for (at, n), (a, e) in zip(by, spans(texts[d], list(by)), strict=True)]
                        hits[d] = sorted(hits[d] + new, key=lambda h: (h["word"], h["length"]))
                    if last:
                        yield finish(b, hits, [len(w) for w in split])
                    else:
                        yield b.set_column(b.schema.get_field_index("hits"), b.schema.field("hits"), pa.array(hits, b.schema.field("hits").type))

        out = out.mapInArrow(scanned, schema if last else out.schema)
        if not last:
            out = stored(out, "hits")
    return out


def find(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with `hits`: first word, words, character span in the original text, and item ids of each
    window found, in the order of the text.

    items: (item_id, text). All columns of docs stay; one named `hits` is replaced. Null texts have
    no words; a null item_id counts as the id ''. Items come to the driver a block of about
    block_bytes at a time, and documents are written to the shared folder between two blocks, so a
    worker holds one automaton at a time whatever the size of the benchmark. Nothing is shuffled.
    """
    schema = docs.drop("hits").withColumn("hits", F.array().cast(HITS)).schema

    def finish(b: pa.RecordBatch, hits: list, _) -> pa.RecordBatch:
        cols = [b.column(b.schema.get_field_index(c)) for c in schema.names[:-1]]
        return pa.RecordBatch.from_arrays([*cols, pa.array(hits, b.schema.field("hits").type)], names=schema.names)

    return _scan(docs, items, window, block_bytes, schema, finish)


_REPORT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def report(docs: DataFrame, items: DataFrame, *, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep (all columns of docs by default) and n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if a twentieth of its words or more lie in a window; one without words
    isn't. Repeated rows are judged alike. Columns of docs with the name of a result column are
    replaced. Empty tables: no rows, or no hits.
    """
    names = [c for c in (keep or docs.columns) if c not in {"hits", *_REPORT.names}]
    base = docs.select(*dict.fromkeys([*names, "text"]))
    schema = base.select(*names).schema
    for f, kind in zip(_REPORT.names, ("long", "long", "long", "string", "boolean"), strict=True):
        schema = schema.add(f, kind)

    def finish(b: pa.RecordBatch, found: list, n_words: list[int]) -> pa.RecordBatch:
        rows = []
        for n, hits in zip(n_words, found, strict=True):
            n_hit = upto = 0
            for h in hits:  # by rising first word
                n_hit += max(0, h["word"] + h["length"] - max(upto, h["word"]))
                upto = max(upto, h["word"] + h["length"])
            ids = sorted({i for h in hits for i in h["items"]})
            rows.append((n, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n))
        new = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _REPORT, strict=True)]
        return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *new], names=[*names, *_REPORT.names])

    return _scan(base, items, window, block_bytes, schema, finish)

"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crownlake.llm.bpe import default_path, encoder
from crownlake.llm.common import arrow, steps, stored

#: Remainders that one differencing works on.
GROUP = 128
_PIECE = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("part", pa.int32()), ("local_sequence", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
    ]
)
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_sequence long, offset long, ids binary"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into k sets with near-equal sums: the two partial partitions of the widest
    spread are merged, largest set on smallest, until one is left. Ties go by insertion order."""
    if k <= 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [[i], *[[]] * (k - 1)]))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, sa = heapq.heappop(heap)
        _, _, b, sb = heapq.heappop(heap)
        s = a + b[::-1]
        sets = [x + y if x and y else x or y for x, y in zip(sa, reversed(sb), strict=True)]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        heapq.heappush(heap, (int(s[-1] - s[0]), number, s - s[-1], [sets[j] for j in order.tolist()]))
        number += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def fill(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in the item, length), each at most `capacity` long.

    Differencing deals whole items (whole windows of longer ones are cut off first) to near-equal
    windows. Their number starts at the fewest that could hold all and rises, by what lies over the
    capacity, until no window exceeds it. Items may be cut freely, so the emptiest windows above the
    fewest are dissolved then into the room of the others, and all windows but one are full.
    """
    parts = [(i, at, min(capacity, n - at)) for i, n in enumerate(sizes) for at in range(0, n, capacity)]
    total = sum(sizes)
    if not total:
        return []
    fewest = k = -(-total // capacity)
    while True:
        windows = [[parts[j] for j in items] for items in differencing([n for _, _, n in parts], k)]
        over = sum(max(0, sum(n for _, _, n in w) - capacity) for w in windows)
        if not over:
            break
        k += max(1, over // capacity)
    windows.sort(key=lambda w: -sum(n for _, _, n in w))
    spare = [x for w in windows[fewest - 1 :] for x in w]
    windows = [*windows[: fewest - 1], []]
    for w in windows:
        room = capacity - sum(n for _, _, n in w)
        while spare and room:
            i, start, n = spare.pop()
            m = min(n, room)
            w.append((i, start, m))
            room -= m
            if m < n:
                spare.append((i, start + m, n - m))
    return windows


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """Pack every text of docs (doc_id, text) into sequences; one row a piece of a document.

    Columns: doc_id, start, length, ids_crc32, doc_tokens (with end_id), sequence_id (from 0,
    without gaps), offset in the sequence, and ids (4 bytes each) if keep_ids. A document's whole
    windows are sequences of their own; remainders are packed `group` at a time as they come in a
    task, and the piece set of the emptiest window waits for the next group, so each task pads one
    sequence. Null or empty text: the end id alone. Rows that share a doc_id or have none are
    packed like any others; an empty table gives no rows.
    """
    tokenizer = tokenizer or default_path()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        width, part = enc.dtype.itemsize, TaskContext.get().partitionId()
        rows: list[tuple] = []
        waiting: list[tuple] = []  # doc_id, doc_tokens, start, ids
        sequence = 0

        def put(doc_id, tokens, start, ids, seq, offset):
            full = np.frombuffer(ids, enc.dtype).astype("<u4").tobytes()
            rows.append((doc_id, start, len(full) // 4, zlib.crc32(full), tokens, part, seq, offset, full if keep_ids else None))

        def close(last: bool) -> None:
            nonlocal sequence, waiting
            windows = fill([len(x[3]) // width for x in waiting], capacity)
            held: list[tuple] = []
            if windows and not last:
                room = [sum(n for _, _, n in w) for w in windows]
                w = windows.pop(room.index(min(room)))
                held = [(d, t, s + a, ids[a * width : (a + n) * width]) for i, a, n in w for d, t, s, ids in [waiting[i]]]
            for w in windows:
                offset = 0
                for i, a, n in w:
                    d, t, s, ids = waiting[i]
                    put(d, t, s + a, ids[a * width : (a + n) * width], sequence, offset)
                    offset += n
                sequence += 1
            waiting = held

        for batch in batches:
            for b in steps(batch, "text"):
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                    ids += end
                    tokens = len(ids) // width
                    whole = tokens // capacity * capacity
                    for at in range(0, whole, capacity):
                        put(doc_id, tokens, at, ids[at * width : (at + capacity) * width], sequence, 0)
                        sequence += 1
                    if whole < tokens:
                        waiting.append((doc_id, tokens, whole, ids[whole * width :]))
                        if len(waiting) >= group:
                            close(False)
                if rows:
                    yield arrow(_PIECE, *zip(*rows, strict=True))
                    rows.clear()
        close(True)
        if rows:
            yield arrow(_PIECE, *zip(*rows, strict=True))

    spark = docs.sparkSession
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(out.mapInArrow(packed, PIECE_DDL), "pieces")
    before, bases = 0, []  # one number a task
    for part, n in sorted(pieces.groupBy("part").agg(F.max("local_sequence") + 1).collect()):
        bases.append((part, before))
        before += n
    bases_df = spark.createDataFrame(bases, "part int, base long")
    return pieces.join(F.broadcast(bases_df), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local_sequence")).alias("sequence_id"), "offset", *["ids"] * keep_ids
    )

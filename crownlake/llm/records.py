"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard is a file of records in ascending doc_id order; shard k holds smaller ids than shard
k + 1. A record:

    u64 length of the payload | u32 masked CRC of those 8 bytes | payload | u32 masked CRC of it | \\n

All numbers are little-endian. The CRC is CRC-32, masked by a rotation and a constant so that a
checksum of data which holds checksums stays sound. Payload: u8 bytes an id (2 or 4), u8 1 if
the doc_id is null, 6 zero bytes, i64 doc_id, then the ids. The closing line feed is the record
mark of Spark's text writer, which puts the shards into any store that Spark can write to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crownlake.llm.bpe import default_path, encoder
from crownlake.llm.common import arrow, scratch, steps

#: Bytes of text of a shard; where that makes more shards than SHARDS they grow, to LARGEST bytes at most.
SHARD_BYTES, SHARDS, LARGEST = 16 << 20, 100_000, 128 << 20
LEAST = -(1 << 63)
_FRAMED = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("frame", pa.binary())])
_INDEX = pa.schema(
    [("doc_id", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)
INDEX_DDL = "doc_id long, shard int, offset long, n_bytes long, local_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    x = zlib.crc32(data)
    return ((x >> 15 | x << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its closing line feed."""
    payload = struct.pack("<BB6xq", width, doc_id is None, doc_id or 0) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the end of the record that begins at `at`; ValueError if it is damaged."""
    data = memoryview(data)
    head = data[at : at + 12]
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError(f"damaged length at byte {at}")
    n = struct.unpack("<Q", head[:8])[0]
    payload, tail = data[at + 12 : at + 12 + n], data[at + 12 + n : at + n + 17]
    if len(tail) < 5 or struct.unpack("<I", tail[:4])[0] != masked(payload) or tail[4] != 10:
        raise ValueError(f"damaged record at byte {at}")
    width, null, doc_id = struct.unpack("<BB6xq", payload[:16])
    return None if null else doc_id, np.frombuffer(payload[16:], f"<u{width}"), at + n + 17


def write_records(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> int:
    """Encode every text of docs (doc_id, text) and write the shards below `path`; returns their number.

    Null or empty text: the end id alone. Rows that share a doc_id, or have none (they come
    first), are all kept, in an order that depends on their content only; a doc_id that holds
    many rows is spread over the shards that its quantiles cover.
    """
    tokenizer = tokenizer or default_path()
    keys = docs.select(F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    total, rows = keys.agg(F.sum("n"), F.count("*")).first()
    size = (total or 0) + 8 * rows
    shards = int(max(1, min(SHARDS, -(-size // shard_bytes)), -(-size // LARGEST)))
    cuts = np.array(keys.approxQuantile("k", [i / shards for i in range(1, shards)], max(1e-5, 0.1 / shards)) if shards > 1 and rows else [], np.float64)
    cuts = np.clip(cuts, -(2.0**63), 2.0**63 - 1024).astype(np.int64)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for b in steps(batch, "text"):
                texts, doc_ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
                ids = enc.encode(texts)
                key = np.array([LEAST if i is None else i for i in doc_ids], np.int64)
                lo, hi = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
                spread = np.array([zlib.crc32(x) for x in ids], np.int64)
                shard = lo + spread % (hi - lo + 1)
                yield arrow(_FRAMED, shard.astype(np.int32), b.column("doc_id"), [frame(i, x + end, enc.dtype.itemsize) for i, x in zip(doc_ids, ids, strict=True)])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = out.mapInArrow(framed, "shard int, doc_id long, frame binary").repartitionById(shards, "shard")
    out = out.sortWithinPartitions(F.asc_nulls_first("doc_id"), "frame")
    out.select(F.col("frame").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", 0).text(path)
    return shards


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = memoryview(content.as_buffer())
            shard = int(path.rpartition("/part-")[2].split("-")[0])
            at = start = 0
            rows: list[tuple] = []
            while at < len(data):
                doc_id, ids, to = unframe(data, at)
                rows.append((doc_id, shard, at, to - at, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                start, at = start + len(ids), to
                if len(rows) == 20_000:
                    yield arrow(_INDEX, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield arrow(_INDEX, *zip(*rows, strict=True))


def read_index(spark, path: str) -> DataFrame:
    """Read the shards back, verify every checksum and return the offset index with global starts.

    Columns: doc_id, shard, offset and n_bytes of the record in its shard, start (ids of all
    documents before it), n_tokens, ids_crc32. An empty table gives an empty index.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    index_path = scratch(spark, "offset-index")
    files.mapInArrow(_parse, INDEX_DDL).write.parquet(index_path)
    index = spark.read.schema(INDEX_DDL).parquet(index_path)
    before, bases = 0, []  # one number a shard of 16 MB or more
    for shard, n in sorted(index.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        bases.append((shard, before))
        before += n
    bases_df = spark.createDataFrame(bases, "shard int, base long")
    return index.join(F.broadcast(bases_df), "shard").select("doc_id", "shard", "offset", "n_bytes", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_records(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write docs as binary records and return the index read back from them (see read_index).

    Other columns of docs are ignored, whatever their names.
    """
    path = path or scratch(docs.sparkSession, "records")
    write_records(docs, path, **options)
    return read_index(docs.sparkSession, path)

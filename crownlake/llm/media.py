"""Texts stored as 8-bit audio samples and read back through the signature sniffer."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crownlake.llm.common import arrow, steps, stored
from crownlake.llm.sniff import sniff

RATE, UNIT = 8000, 64
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("content", pa.binary())])
_FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media_type", pa.string()), ("corrected", pa.bool_()),
    ]
)
FEATURES_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean"


def to_wav(payload: bytes) -> bytes:
    """A mono RIFF/WAVE file with one unsigned 8-bit sample for each byte of the payload."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk."""
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def feature(samples: bytes) -> str:
    """Mean, energy and zero crossings of the samples around 128, and a 16-bin histogram in 4-bit steps."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    share = np.bincount(x >> 4, minlength=16) * 15 // len(x)
    turns = int(np.count_nonzero(np.diff(x >= 128)))
    return f"pcm8;n={len(x)};sum={int(x.sum())};energy={int(((x - 128) ** 2).sum())};turns={turns};hist={''.join('%x' % v for v in share)}"


def store(docs: DataFrame) -> DataFrame:
    """Each text (null: empty) as a media row: doc_id, n_bytes, declared type, content."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                payloads = [padded(t) for t in b.column("text").to_pylist()]
                yield arrow(_STORED, b.column("doc_id"), [n for n, _ in payloads], ["application/octet-stream"] * b.num_rows, [to_wav(p) for _, p in payloads])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return out.mapInArrow(encoded, "doc_id long, n_bytes long, declared string, content binary")


def features(media: DataFrame) -> DataFrame:
    """Sniff stored media, carve the sound and compute payload digests and features from its samples."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, content in zip(b.select(["doc_id", "n_bytes", "media_type", "corrected", "carved"]).to_pylist(), b.column(b.schema.get_field_index("content")), strict=True):
                raw = content.as_buffer().to_pybytes()
                sound = next(c for c in r["carved"] if c["type"] == "audio/wav")
                payload = from_wav(raw[sound["offset"] : sound["offset"] + sound["length"]])
                rows.append(
                    (
                        r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
                        len(raw), hashlib.sha256(raw).hexdigest(), feature(payload), r["media_type"], r["corrected"],
                    )
                )
            if rows:
                yield arrow(_FEATURES, *zip(*rows, strict=True))

    return sniff(media, "content", "declared").mapInArrow(computed, FEATURES_DDL)


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text of docs (doc_id, text) as sound, read the stored bytes back, return features.

    Null and empty texts are 64 zero bytes. Repeated rows are kept; an empty table gives no rows.
    """
    return features(stored(store(docs), "media"))

"""Signature sniffing: magic bytes by Aho-Corasick, confirmed by validators of format and length."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CARVED = "array<struct<type:string,offset:long,length:long>>"


def _riff(d: memoryview, kind: bytes) -> int:
    if len(d) < 12 or d[8:12] != kind:
        return 0
    end, at = 8 + struct.unpack_from("<I", d, 4)[0], 12
    if end > len(d):
        return 0
    while at + 8 <= end:
        at += 8 + (n := struct.unpack_from("<I", d, at + 4)[0]) + n % 2
    return end if at == end else 0


def wav(d: memoryview) -> int:
    return _riff(d, b"WAVE")


def webp(d: memoryview) -> int:
    return _riff(d, b"WEBP")


def png(d: memoryview) -> int:
    at = 8
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if at + 12 + n > len(d) or struct.unpack_from(">I", d, at + 8 + n)[0] != zlib.crc32(d[at + 4 : at + 8 + n]):
            return 0
        at += 12 + n
        if kind == b"IEND":
            return at
    return 0


def gif(d: memoryview) -> int:
    if len(d) < 13:
        return 0
    at = 13 + (3 << (d[10] & 7) + 1 if d[10] & 0x80 else 0)

    def blocks(at: int) -> int:
        while at < len(d) and d[at]:
            at += d[at] + 1
        return at + 1

    while at < len(d):
        if d[at] == 0x3B:
            return at + 1
        if d[at] == 0x21:
            at = blocks(at + 2)
        elif d[at] == 0x2C and at + 10 < len(d):
            at = blocks(at + 11 + (3 << (d[at + 9] & 7) + 1 if d[at + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def bmp(d: memoryview) -> int:
    if len(d) < 26:
        return 0
    size, first, header = struct.unpack_from("<I", d, 2)[0], *struct.unpack_from("<II", d, 10)
    return size if size <= len(d) and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= first <= size else 0


#: What was found in the bytes at hand, so that hostile ones are not searched anew from every place.
_seen: dict = {}
_MARKER, _PDF_END, _PDF_TABLE = (re.compile(x) for x in (rb"\xff[^\x00\xd0-\xd7]", rb"%%EOF", rb"startxref"))


def following(d: memoryview, what: re.Pattern, at: int) -> int:
    """Where `what` next begins in d, a view of the end of its bytes, from `at` on; -1 if nowhere."""
    first = len(d.obj) - len(d)
    start, hit = _seen.get(what, (len(d.obj) + 1, -1))
    if not (start <= first + at and (hit < 0 or first + at <= hit)):
        m = what.search(d.obj, first + at)
        hit = m.start() if m else -1
        _seen[what] = first + at, hit
    return hit - first if hit >= 0 else -1


def jpeg(d: memoryview) -> int:
    at = 2
    while at + 4 <= len(d) and d[at] == 0xFF:
        kind = d[at + 1]
        if kind == 0xD9:
            return at + 2
        if kind < 0xC0:
            return 0
        at += 2 + struct.unpack_from(">H", d, at + 2)[0]
        if kind == 0xDA:  # entropy-coded data up to the next marker that is neither stuffing nor a restart
            at = following(d, _MARKER, at)
            if at < 0:
                return 0
            if at + 2 <= len(d) and d[at + 1] == 0xD9:
                return at + 2
    return 0


def gzipped(d: memoryview) -> int:
    z = zlib.decompressobj(31)
    try:
        rest = d
        while not z.eof and len(rest):
            z.decompress(rest, 1 << 20)
            rest = z.unconsumed_tail
    except zlib.error:
        return 0
    return len(d) - len(z.unused_data) if z.eof else 0


def zipped(d: memoryview) -> int:
    """The end of an archive whose directory's end record leads back to its first byte."""
    if "zip" not in _seen:
        ends = {}
        for m in re.finditer(rb"PK\x05\x06", d.obj):
            if m.start() + 22 <= len(d.obj):
                size, start = struct.unpack_from("<II", d.obj, m.start() + 12)
                end = m.start() + 22 + struct.unpack_from("<H", d.obj, m.start() + 20)[0]
                if end <= len(d.obj):
                    ends.setdefault(m.start() - start - size, end)
        _seen["zip"] = ends
    first = len(d.obj) - len(d)
    return max(0, _seen["zip"].get(first, first) - first)


def pdf(d: memoryview) -> int:
    end = following(d, _PDF_END, 0)
    return end + 5 if 0 <= following(d, _PDF_TABLE, 0) < end else 0


def mp4(d: memoryview) -> int:
    at = 0
    while at + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if n < 8 or at + n > len(d) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"uuid", b"wide", b"udta", b"meta", b"sidx"):
            break
        at += n
    return at if at > 8 else 0


def ogg(d: memoryview) -> int:
    at, first = 0, len(d.obj) - len(d)
    broken = _seen.setdefault("ogg", set())  # pages from which no last page is reached
    while at + 27 <= len(d) and d[at : at + 4] == b"OggS" and d[at + 4] == 0 and first + at not in broken:
        broken.add(first + at)
        n = d[at + 26]
        end = at + 27 + n + sum(d[at + 27 : at + 27 + n])
        if end > len(d):
            return 0
        last, at = d[at + 5] & 4, end
        if last:
            return at
    return 0


#: Magic bytes, where they stand in the file, type, validator giving the length or 0.
FORMATS = [
    (b"RIFF", 0, "audio/wav", wav), (b"RIFF", 0, "image/webp", webp), (b"\x89PNG\r\n\x1a\n", 0, "image/png", png),
    (b"GIF87a", 0, "image/gif", gif), (b"GIF89a", 0, "image/gif", gif), (b"BM", 0, "image/bmp", bmp), (b"\xff\xd8\xff", 0, "image/jpeg", jpeg),
    (b"\x1f\x8b\x08", 0, "application/gzip", gzipped), (b"PK\x03\x04", 0, "application/zip", zipped), (b"%PDF-", 0, "application/pdf", pdf),
    (b"ftyp", 4, "video/mp4", mp4), (b"OggS", 0, "audio/ogg", ogg),
]
_magic = None


def carve(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the confirmed media in data, outermost only, from left to right."""
    global _magic
    if _magic is None:
        _magic = ahocorasick.Automaton()
        by: dict[bytes, list] = {}
        for magic, at, kind, check in FORMATS:
            by.setdefault(magic, []).append((at, kind, check))
        for magic, checks in by.items():
            _magic.add_word(magic.decode("latin-1"), (len(magic), checks))
        _magic.make_automaton()
    found: list[tuple[str, int, int]] = []
    _seen.clear()
    view, free = memoryview(data), 0
    for end, (n, checks) in _magic.iter(data.decode("latin-1")):
        for at, kind, check in checks:
            start = end + 1 - n - at
            if start >= free and (size := check(view[start:])):
                found.append((kind, start, size))
                free = start + size
                break
        if free >= len(data):
            break
    _seen.clear()
    return found


def sniff(df: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """df with media_type, corrected and carved.

    media_type: the confirmed type that begins at byte 0, else null; corrected: true if `declared`
    names another type than the confirmed one; carved: all confirmed media in the bytes. Null or
    empty content has no type and nothing carved. Result columns replace columns of their names.
    """
    new = ("media_type", "corrected", "carved")
    base = df.select(*[c for c in df.columns if c not in new])
    schema = StructType(base.schema.fields + StructType.fromDDL(f"media_type string, corrected boolean, carved {CARVED}").fields)
    item = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            carved = [carve(x.as_buffer().to_pybytes()) if x.is_valid else [] for x in b.column(b.schema.get_field_index(content))]
            kinds = [c[0][0] if c and c[0][1] == 0 else None for c in carved]
            told = b.column(b.schema.get_field_index(declared)).to_pylist() if declared else [None] * b.num_rows
            wrong = [k is not None and t is not None and k != t for k, t in zip(kinds, told, strict=True)]
            lists = pa.array([[dict(zip(("type", "offset", "length"), x, strict=True)) for x in c] for c in carved], pa.list_(item))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), lists], names=[*b.schema.names, *new])

    return base.mapInArrow(sniffed, schema)

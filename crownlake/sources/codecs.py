"""Byte formats that the container has no library for: PNG16, NPY, WKB, shapefile, DBF, PLY, LAS."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np

# label PNG -------------------------------------------------------------------------------------


def png_decode(data: bytes) -> np.ndarray:
    """Greyscale PNG of 8 or 16 bits, without interlacing, as a 2-D array."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, body = 8, b""
    width = height = depth = 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if colour != 0 or depth not in (8, 16) or interlaced:
                raise ValueError("only plain greyscale of 8 or 16 bits is read")
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += 12 + n
    size = depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * size)
    out = np.zeros((height, width * size), np.uint8)
    above = np.zeros(width * size, np.int64)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + above) & 255
        elif kind:
            for x in range(len(line)):
                left = line[x - size] if x >= size else 0
                corner = above[x - size] if x >= size else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = left if a <= b and a <= c else above[x] if b <= c else corner
                line[x] = (line[x] + guess) & 255
        out[y], above = line, line
    return out.reshape(height, width) if size == 1 else out.reshape(height, width, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)


def png_encode(a: np.ndarray, depth: int = 16) -> bytes:
    """A 2-D array of unsigned numbers as greyscale PNG; rows are stored as differences to the row above."""
    rows = a.astype(">u2" if depth == 16 else np.uint8)
    raw = rows.view(np.uint8).reshape(a.shape[0], -1)
    up = (raw.astype(np.int16) - np.vstack((np.zeros((1, raw.shape[1]), np.int16), raw[:-1].astype(np.int16)))) & 255
    body = np.hstack((np.full((a.shape[0], 1), 2), up)).astype(np.uint8).tobytes()

    def chunk(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))

    header = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


# GeoTIFF ---------------------------------------------------------------------------------------

#: Struct codes of the TIFF field types 1 to 17, and NumPy kinds of the sample formats.
_TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q"}
_TIFF_KINDS = {1: "u", 2: "i", 3: "f"}


def _tiff_fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's fields by tag, of classic and big TIFF."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    number, width = ("Q", 20) if big else ("I", 12)
    at = struct.unpack_from(order + number, data, 8 if big else 4)[0]
    count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    fields = {}
    for entry in range(at, at + count * width, width):
        tag, kind, n = struct.unpack_from(order + "HH" + number, data, entry)
        if kind not in _TIFF_TYPES:
            continue
        form = order + (f"{n}s" if kind == 2 else _TIFF_TYPES[kind] * n)
        inline = entry + width - (8 if big else 4)
        where = inline if struct.calcsize(form) <= width - inline + entry else struct.unpack_from(order + number, data, inline)[0]
        fields[tag] = struct.unpack_from(form, data, where)
    return order, fields


def tiff_decode(data: bytes) -> tuple[np.ndarray, tuple[float, ...] | None]:
    """Bands [height, width, bands] of a TIFF in strips or tiles, plain or deflated, with or without horizontal
    differences, and the affine (a, b, c, d, e, f) of pixel corners to world coordinates if it has one."""
    order, f = _tiff_fields(data)
    width, height, bands = f[256][0], f[257][0], f.get(277, (1,))[0]
    packing, predictor = f.get(259, (1,))[0], f.get(317, (1,))[0]
    if packing not in (1, 8, 32946) or predictor not in (1, 2) or f.get(284, (1,))[0] != 1:
        raise ValueError("only plain and deflated pixels, bands side by side, are read")
    dtype = np.dtype(f"{order}{_TIFF_KINDS[f.get(339, (1,))[0]]}{f.get(258, (8,))[0] // 8}")
    tiled = 324 in f
    high, wide = (f[323][0], f[322][0]) if tiled else (min(f.get(278, (height,))[0], height), width)
    out = np.zeros((height, width, bands), dtype.newbyteorder("="))
    places = [(y, x) for y in range(0, height, high) for x in range(0, width, wide)]
    for (y, x), at, size in zip(places, f[324 if tiled else 273], f[325 if tiled else 279], strict=True):
        raw = data[at : at + size] if packing == 1 else zlib.decompress(data[at : at + size])
        rows = high if tiled else min(high, height - y)
        block = np.frombuffer(raw, dtype, rows * wide * bands).reshape(rows, wide, bands).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[y : y + rows, x : x + wide] = block[: height - y, : width - x]
    affine = None
    if 34264 in f:
        m = f[34264]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in f and 33922 in f:
        (sx, sy, *_), (i, j, _, x, y, *_) = f[33550], f[33922]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    return out, affine


def tiff_encode(a: np.ndarray, affine: tuple[float, ...] | None = None, tile: int = 0, deflate: bool = False) -> bytes:
    """Bands [height, width, bands] as a little-endian TIFF of one strip a row, or of square tiles."""
    height, width, bands = a.shape
    high, wide = (tile, tile) if tile else (1, width)
    blocks = []
    for y in range(0, height, high):
        for x in range(0, width, wide):
            block = np.zeros((high, wide, bands), a.dtype.newbyteorder("<"))
            part = a[y : y + high, x : x + wide]
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes()) if deflate else block.tobytes())
    at = 8 + np.cumsum([0, *map(len, blocks)])
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    fields = [(256, "I", [width]), (257, "I", [height]), (258, "H", [8 * a.dtype.itemsize] * bands), (259, "H", [8 if deflate else 1]), (277, "H", [bands])]
    fields += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", at[:-1].tolist()), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", at[:-1].tolist()), (278, "I", [1]), (279, "I", [len(b) for b in blocks])]
    fields.append((339, "H", [kind] * bands))
    if affine:
        p, q, c, r, s, t = affine
        fields.append((34264, "d", [p, q, 0.0, c, r, s, 0.0, t, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    directory, extra = b"", b""
    rest = int(at[-1]) + 2 + 12 * len(fields) + 4
    for tag, form, values in sorted(fields):
        body = struct.pack(f"<{len(values)}{form}", *values)
        directory += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12}[form], len(values)) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack("<I", rest + len(extra)))
        extra += body if len(body) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, int(at[-1])) + b"".join(blocks) + struct.pack("<H", len(fields)) + directory + b"\0" * 4 + extra


# surfaces --------------------------------------------------------------------------------------


def npy_decode(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def npy_encode(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


# polygons --------------------------------------------------------------------------------------


def _wkb(data: bytes, at: int) -> tuple[list[list[tuple[float, float]]], int]:
    order = "<" if data[at] else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5 + (4 if kind & 0x20000000 else 0)
    dims = 2 + (kind // 1000 % 10 in (1, 2)) + 2 * (kind // 1000 % 10 == 3) + bool(kind & 0x80000000) + bool(kind & 0x40000000)
    base = (kind & 0x0FFFFFFF) % 1000
    count = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    rings: list[list[tuple[float, float]]] = []
    if base == 3:
        for k in range(count):
            n = struct.unpack_from(order + "I", data, at)[0]
            points = np.frombuffer(data, order + "f8", n * dims, at + 4).reshape(n, dims)
            at += 4 + n * dims * 8
            if k == 0:
                rings.append([(float(x), float(y)) for x, y in points[:, :2]])
    elif base == 6:
        for _ in range(count):
            own, at = _wkb(data, at)
            rings += own
    else:
        raise ValueError(f"geometry type {base} is no polygon")
    return rings, at


def wkb_rings(data: bytes) -> list[list[tuple[float, float]]]:
    """Outer rings of a polygon or multipolygon in WKB, with or without a GeoPackage header."""
    at = 0
    if data[:2] == b"GP":
        at = 8 + 8 * (0, 4, 6, 6, 8)[data[3] >> 1 & 7]
        if data[3] >> 4 & 1:
            return []
    return _wkb(data, at)[0]


def shp_rings(data: bytes) -> Iterator[tuple[int, int, list[tuple[float, float]]]]:
    """(record, part, ring) of the polygons of a shapefile, with or without Z and M; records count from 0, null shapes included."""
    places = []  # where each record's shape begins
    at = 100
    while at + 12 <= len(data):
        places.append(at + 8)
        at += 8 + 2 * int(np.frombuffer(data, ">i4", 1, at + 4)[0])
    for record, at in enumerate(places):
        kind = int(np.frombuffer(data, "<i4", 1, at)[0])
        if kind not in (5, 15, 25):
            continue
        n_parts, n_points = np.frombuffer(data, "<i4", 2, at + 36).tolist()
        first = np.frombuffer(data, "<i4", n_parts, at + 44)
        corners = np.frombuffer(data, "<f8", 2 * n_points, at + 44 + first.nbytes).reshape(-1, 2)
        for part, ring in enumerate(np.split(corners, first[1:])):
            yield record, part, [tuple(p) for p in ring.tolist()]


#: A field of a DBF header: name, type, displacement, width, and what is not used here.
_DBF_FIELD = np.dtype([("name", "S11"), ("type", "S1"), ("at", "<u4"), ("width", "u1"), ("rest", "V15")])


def dbf_rows(data: bytes, encoding: str = "latin-1") -> Iterator[tuple[int, dict[str, str]]]:
    """(record, fields) of a DBF table, values as stripped text; deleted records keep their number but don't come out."""
    top = np.frombuffer(data, np.dtype([("rows", "<u4"), ("header", "<u2"), ("size", "<u2")]), 1, 4)[0]
    fields = np.frombuffer(data, _DBF_FIELD, (int(top["header"]) - 33) // _DBF_FIELD.itemsize, 32)
    fields = fields[np.cumprod(fields["name"].astype("S1") != b"\r").astype(bool)]
    names = [bytes(n).partition(b"\0")[0].decode(encoding) for n in fields["name"]]
    ends = 1 + np.cumsum(fields["width"], dtype=np.int64)
    row = np.dtype({"names": ["", *names], "formats": ["S1", *[f"S{w}" for w in fields["width"]]], "offsets": [0, *(ends - fields["width"]).tolist()], "itemsize": int(top["size"])})
    table = np.frombuffer(data, row, min(int(top["rows"]), (len(data) - int(top["header"])) // row.itemsize), int(top["header"]))
    columns = {n: np.char.strip(np.char.decode(table[n], encoding)).tolist() for n in names}
    for r in np.flatnonzero(table[""] != b"*").tolist():
        yield r, {n: c[r] for n, c in columns.items()}


# point clouds ----------------------------------------------------------------------------------


def ply_encode(xyz: np.ndarray, rgb: np.ndarray) -> bytes:
    """Binary little-endian PLY with float positions and byte colours."""
    row = np.zeros(len(xyz), [("p", "<f4", 3), ("c", "u1", 3)])
    row["p"], row["c"] = xyz, rgb
    names = [f"property float {c}" for c in "xyz"] + [f"property uchar {c}" for c in ("red", "green", "blue")]
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(xyz)}", *names, "end_header", ""]
    return "\n".join(head).encode() + row.tobytes()


def las_encode(xyz: np.ndarray, rgb: np.ndarray, scale: float = 0.001) -> bytes:
    """LAS 1.2, point format 2: positions as multiples of `scale` from their floor, colours widened to 16 bits."""
    n = len(xyz)
    offset = np.floor(xyz.min(axis=0)) if n else np.zeros(3)
    low, high = (xyz.min(axis=0), xyz.max(axis=0)) if n else (np.zeros(3), np.zeros(3))
    row = np.zeros(n, [("p", "<i4", 3), ("i", "<u2"), ("f", "u1"), ("cl", "u1"), ("a", "i1"), ("u", "u1"), ("s", "<u2"), ("c", "<u2", 3)])
    row["p"], row["c"], row["f"] = np.rint((xyz - offset) / scale), rgb.astype(np.uint16) * 257, 0x09
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"crownlake", b"crownlake", 1, 2000, 227, 227, 0, 2, 26, n, n, 0, 0, 0, 0)
    head += struct.pack("<12d", scale, scale, scale, *offset, high[0], low[0], high[1], low[1], high[2], low[2])
    return head + row.tobytes()

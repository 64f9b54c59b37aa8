"""Operators on dense surfaces of one frame at a time: smoothing, peaks, watershed, components, polygons, hulls.

Frames are rows (by..., height, width, values ARRAY<FLOAT>), one grouped or mapped call each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NEAR8 = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
NEAR4 = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, border mirrored without the edge pixel."""
    if sigma <= 0:
        return a.astype(float)
    r = max(1, int(round(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if i == axis else (0, 0) for i in (0, 1)]
        b = np.pad(a.astype(float), pad, mode="reflect" if a.shape[axis] > r else "symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, b)
    return a


def labelled(mask: np.ndarray, near: Sequence[tuple[int, int]] = NEAR8) -> np.ndarray:
    """Connected components of a boolean or class raster, numbered from 1 in reading order; 0 stays 0."""
    out = np.zeros(mask.shape, np.int32)
    h, w = mask.shape
    n = 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        out[y, x], stack = n, [(y, x)]
        while stack:
            cy, cx = stack.pop()
            for dy, dx in near:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < h and 0 <= nx < w and not out[ny, nx] and mask[ny, nx] == mask[y, x]:
                    out[ny, nx] = n
                    stack.append((ny, nx))
    return out


def prominent_peaks(a: np.ndarray, prominence: float) -> np.ndarray:
    """Markers of the maxima that rise above every saddle to higher ground by more than `prominence`.

    Pixels join by falling height; when two peaks meet, the lower one ends, and counts if it rose enough.
    """
    h, w = a.shape
    order = np.argsort(-a, axis=None, kind="stable")
    parent = np.full(h * w, -1, np.int64)
    top: dict[int, int] = {}
    keep = []
    flat = a.ravel()

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in order.tolist():
        y, x = divmod(i, w)
        parent[i], top[i] = i, i
        for dy, dx in NEAR8:
            ny, nx = y + dy, x + dx
            j = ny * w + nx
            if 0 <= ny < h and 0 <= nx < w and parent[j] >= 0 and (r := find(j)) != (s := find(i)):
                low, high = (r, s) if (flat[top[r]], -top[r]) < (flat[top[s]], -top[s]) else (s, r)
                if flat[top[low]] - flat[i] > prominence:
                    keep.append(top[low])
                parent[low] = high
                del top[low]
    keep += list(top.values())
    out = np.zeros(h * w, np.int32)
    out[sorted(keep)] = np.arange(1, len(keep) + 1)
    return out.reshape(h, w)


def watershed(a: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flood from markers by falling height inside the mask; of equal heights the first reached floods first."""
    out = np.where(mask, markers, 0).astype(np.int32)
    h, w = a.shape
    queue = [(-a[y, x], n, y, x) for n, (y, x) in enumerate(zip(*np.nonzero(out), strict=True))]
    heapq.heapify(queue)
    n = len(queue)
    while queue:
        _, _, y, x = heapq.heappop(queue)
        for dy, dx in NEAR8:
            ny, nx = y + dy, x + dx
            if 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and not out[ny, nx]:
                out[ny, nx] = out[y, x]
                heapq.heappush(queue, (-a[ny, nx], n, ny, nx))
                n += 1
    return out


def polygon_runs(ring: Sequence[tuple[float, float]], height: int, width: int) -> list[tuple[int, int, int]]:
    """(y, x_start, x_end) of the pixels whose centres lie in the ring (even-odd), clipped to the image."""
    pts = np.asarray(ring, float)
    out = []
    if len(pts) < 3:
        return out
    nxt = np.roll(pts, -1, axis=0)
    for y in range(max(0, int(np.floor(pts[:, 1].min()))), min(height, int(np.ceil(pts[:, 1].max())) + 1)):
        c = y + 0.5
        cross = (pts[:, 1] <= c) != (nxt[:, 1] <= c)
        xs = np.sort(pts[cross, 0] + (c - pts[cross, 1]) * (nxt[cross, 0] - pts[cross, 0]) / (nxt[cross, 1] - pts[cross, 1]))
        for a, b in zip(xs[::2], xs[1::2], strict=True):
            lo, hi = max(0, int(np.ceil(a - 0.5))), min(width, int(np.ceil(b - 0.5)))
            if lo < hi:
                out.append((y, lo, hi))
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by the monotone chain."""
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) < 3:
        return pts

    def half(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(pts)[:-1] + half(pts[::-1])[:-1])


def area_of(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2 if len(ring) > 2 else 0.0


def terrain(height_map: np.ndarray, tile: int, percentile: float = 97, sigma: float = 0.0) -> np.ndarray:
    """Ground depth: a percentile of each tile, bilinear between tile centres, smoothed; never nearer than the map."""
    h, w = height_map.shape
    ty, tx = -(-h // tile), -(-w // tile)
    coarse = np.array([[np.nanpercentile(height_map[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile], percentile) for j in range(tx)] for i in range(ty)])
    y, x = np.clip((np.arange(h) + 0.5) / tile - 0.5, 0, ty - 1), np.clip((np.arange(w) + 0.5) / tile - 0.5, 0, tx - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    fy, fx = (y - y0)[:, None], x - x0
    fine = (coarse[y0][:, x0] * (1 - fx) + coarse[y0][:, x1] * fx) * (1 - fy) + (coarse[y1][:, x0] * (1 - fx) + coarse[y1][:, x1] * fx) * fy
    return np.maximum(blurred(fine, sigma), height_map)


def crowns(surfaces: DataFrame, by: Sequence[str], *, sigma: float = 2.0, prominence: float = 0.5, floor: float = 0.0) -> DataFrame:
    """Marker watershed of each surface: run rows (by, label, y, x_start, x_end) of the basins above `floor`."""
    types = dict(surfaces.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", label int, y int, x_start int, x_end int"

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                a = blurred(np.asarray(r["values"], float).reshape(r["height"], r["width"]), sigma)
                mask = a > floor
                labels = watershed(a, prominent_peaks(a, prominence), mask)
                for y in range(labels.shape[0]):
                    cuts = np.flatnonzero(np.diff(np.concatenate(([0], labels[y], [0]))))
                    rows += [(*[r[k] for k in by], int(labels[y, s]), y, int(s), int(e)) for s, e in zip(cuts, cuts[1:], strict=False) if labels[y, s]]
            yield pd.DataFrame(rows, columns=[*by, "label", "y", "x_start", "x_end"])

    return surfaces.mapInPandas(split, schema)

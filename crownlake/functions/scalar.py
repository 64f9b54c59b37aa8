"""Scalar formulas as Column expressions: all JVM-side, safe under ANSI."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# names ---------------------------------------------------------------------------------------


def altitude(name: Column) -> Column:
    """Metres from a whole name of two or three digits, with or without m; else null."""
    digits = F.regexp_extract(F.trim(name), r"(?i)^(\d{2,3})\s*m?$", 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def altitude_decimal(name: Column) -> Column:
    """Metres from a whole name that is a number, decimal comma or point, with or without m; else null."""
    digits = F.regexp_extract(name, r"(?i)^\s*(\d+(?:[.,]\d+)?)\s*m?\s*$", 1)
    return F.nullif(F.replace(digits, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def _words(name: Column) -> Column:
    return F.split(F.trim(name), r"\s+")


def _binomial(name: Column) -> Column:
    w = _words(name)
    return (F.size(w) > 1) & F.substring(name, 1, 1).rlike(r"\p{Lu}")


def short_name(name: Column) -> Column:
    """Initial of the first word and the second word, as 'P. abies' for 'Picea abies (L.) H.Karst.'; one word or lower case: the first word."""
    w = _words(name)
    return F.when(_binomial(name), F.concat(F.substring(w[0], 1, 1), F.lit(". "), F.get(w, F.lit(1)))).otherwise(w[0])


def short_name_or_whole(name: Column) -> Column:
    """As short_name, but what has no second word, or is lower case, stays whole."""
    return F.when(_binomial(name), short_name(name)).otherwise(name)


def last_word(name: Column) -> Column:
    return F.element_at(_words(name), -1)


#: authors' names that may stand last in a species name.
AUTHORS = ("A.Dietr.", "L.")


def species_match(found: Column, wanted: Column) -> Column:
    """Same initial, and the same last word; a wanted name of one word, or that ends with an author, matches by initial."""
    initial = F.upper(F.substring(F.trim(found), 1, 1)) == F.upper(F.substring(F.trim(wanted), 1, 1))
    return initial & ((F.size(_words(wanted)) == 1) | last_word(wanted).isin(*AUTHORS) | (last_word(wanted) == last_word(found)))


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def key_parts(key: Column) -> tuple[Column, Column]:
    """folder and stem of a folder__stem cache key, parted at the first double underscore."""
    parts = F.split(key, "__", 2)
    return parts[0], F.get(parts, F.lit(1))


# probabilities -------------------------------------------------------------------------------


def entropy(probs: Column, epsilon: float = 1e-12) -> Column:
    return -F.aggregate(probs, F.lit(0.0), lambda s, p: s + p * F.ln(p + epsilon))


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x).cast("double")))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(x: Column) -> Column:
    """Position of the first largest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def top_classes(probs: Column, k: int) -> Column:
    """The k largest as structs (p, i), largest first, equal ones by position."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["neg"]).alias("p"), s["i"].alias("i")))


def l2_normalised(x: Column, floor: float = 1e-9) -> Column:
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(x, lambda v: v.cast("double") / F.greatest(norm, F.lit(floor)))


# camera and height ---------------------------------------------------------------------------


def gsd(height_m, fov_deg, width_px) -> Column:
    return _c(2.0) * _c(height_m) * F.tan(F.radians(_c(fov_deg)) / 2) / _c(width_px)


def focal_k(fov_deg) -> Column:
    return _c(0.5) / F.tan(F.radians(_c(fov_deg)) / 2)


def fov_of(k) -> Column:
    return _c(2.0) * F.degrees(F.atan(_c(0.5) / _c(k)))


def crop_px(footprint_m, gsd_m, least: int = 16) -> Column:
    return F.greatest(F.lit(least), F.rint(_c(footprint_m) / _c(gsd_m)).cast("int"))


def crop_by_box(w, h, factor: float = 2.4, least: int = 16) -> Column:
    return F.greatest(F.lit(least), F.rint(F.greatest(_c(w), _c(h)) * factor).cast("int"))


def scale_factor(gsd_cm, target_cm: float = 1.70) -> Column:
    """How much an image must be enlarged to reach the target; its own GSD is scale * target."""
    return _c(gsd_cm) / target_cm


def height_from_depth(camera_m, depth) -> Column:
    return _c(camera_m) - _c(depth)


def ray_depth(depth, r) -> Column:
    return _c(depth) * F.sqrt(1 + _c(r) * _c(r))


def back_project(u, v, depth, width, height, focal_px, ground) -> tuple[Column, Column, Column]:
    cx, cy = (_c(width) - 1) / 2, (_c(height) - 1) / 2
    return (_c(u) - cx) * _c(depth) / _c(focal_px), -(_c(v) - cy) * _c(depth) / _c(focal_px), _c(ground) - _c(depth)


def to_pixel(x, y, affine: tuple[float, ...]) -> tuple[Column, Column]:
    """World to pixel by the inverse of (a, b, c, d, e, f): x = a*col + b*row + c, y = d*col + e*row + f."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    return ((_c(x) - c) * e - (_c(y) - f) * b) / det, ((_c(y) - f) * a - (_c(x) - c) * d) / det


def centimetres(height_m) -> Column:
    """Fixed point with 0 for no value."""
    cm = F.greatest(F.lit(1.0), F.least(F.lit(65535.0), F.rint(_c(height_m) * 100))).cast("int")
    return F.when(_c(height_m).isNotNull(), cm).otherwise(F.lit(0))


def quantised(x, offset, scale) -> Column:
    return F.rint((_c(x) - _c(offset)) / _c(scale)).cast("int")


# shapes --------------------------------------------------------------------------------------


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of structs x, y."""
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def ring_length(ring: Column) -> Column:
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, nxt, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])), F.lit(0.0), lambda s, v: s + v)


def ring_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def ring_turned(ring: Column, quarter: int, size: float, mirrored: bool = False) -> Column:
    """Rotation by quarter turns within a size * size tile, after an optional mirror."""

    def turn(p: Column) -> Column:
        x, y = (size - p["x"] if mirrored else p["x"]), p["y"]
        for _ in range(quarter % 4):
            x, y = y, size - x
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, turn)


def compactness(area, perimeter) -> Column:
    return F.coalesce(F.try_divide(_c(4 * math.pi) * _c(area), _c(perimeter) * _c(perimeter)), F.lit(0.0))


def aspect_ratio(w, h) -> Column:
    return F.try_divide(F.least(_c(w), _c(h)), F.greatest(_c(w), _c(h)))


def diameter(area) -> Column:
    return 2 * F.sqrt(_c(area) / math.pi)


# colour --------------------------------------------------------------------------------------


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) of 8-bit sRGB."""

    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    def f(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x, y, z = (f((m[0] * lr + m[1] * lg + m[2] * lb) / w) for m, w in (((0.412453, 0.357580, 0.180423), 0.950456), ((0.212671, 0.715160, 0.072169), 1.0), ((0.019334, 0.119193, 0.950227), 1.088754)))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b

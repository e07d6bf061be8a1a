"""Geometry of images, boxes and regions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """x scaled and rounded, halves away from zero, as SQL does; F.round goes by the decimal digits, which differ a bit below a half."""
    return F.round(x * 10.0**digits) / 10.0**digits


def shorter_edge_resize(width: Column, height: Column, size: int, only_shrink: bool = False) -> tuple[Column, Column]:
    """Size after the shorter edge becomes `size`; with only_shrink smaller images stay."""
    scale = F.lit(float(size)) / F.least(width, height)
    if only_shrink:
        scale = F.least(scale, F.lit(1.0))
    return half_even(width * scale), half_even(height * scale)


def fit_pad(width: Column, height: Column, bw: Column, bh: Column) -> tuple[Column, Column]:
    """Size of an image scaled to fit into a bucket, at least 1 and at most the bucket."""
    scale = F.least(bw / width, bh / height)
    return F.greatest(F.lit(1), F.least(bw, half_even(width * scale))), F.greatest(F.lit(1), F.least(bh, half_even(height * scale)))


def fill_crop(width: Column, height: Column, bw: Column, bh: Column) -> tuple[Column, Column]:
    """Size of an image scaled to cover a bucket."""
    scale = F.greatest(bw / width, bh / height)
    return F.greatest(bw, F.ceil(width * scale)), F.greatest(bh, F.ceil(height * scale))


def padding(width: Column, height: Column, bw: Column, bh: Column) -> Column:
    w, h = fit_pad(width, height, bw, bh)
    return 1 - (w * h) / (bw * bh)


def aspect_label(width: Column, height: Column, low: float = 0.85, high: float = 1.18) -> Column:
    ratio = width / height
    return F.when(ratio < low, "portrait").when(ratio > high, "landscape").otherwise("square")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two xyxy boxes with inclusive pixels; 0 where the union is empty."""

    def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.greatest(x1 - x0 + 1, F.lit(0)) * F.greatest(y1 - y0 + 1, F.lit(0))

    inter = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - inter
    return F.when(union != 0, inter / union).otherwise(F.lit(0.0))


def relations(a: list[Column], b: list[Column], dead: float = 0.1) -> Column:
    """Where box a lies relative to box b: array of left of, right of, above, below."""
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    free = lambda d, i: F.greatest(F.abs(d) - dead * (F.abs(a[i + 2] - a[i]) + F.abs(b[i + 2] - b[i])), F.lit(0.0)) * F.signum(d)
    rx, ry = free(dx, 0), free(dy, 1)
    norm = F.sqrt(dx * dx + dy * dy)
    ux, uy = F.try_divide(rx, norm), F.try_divide(ry, norm)
    still = (F.abs(rx) < 1e-3) & (F.abs(ry) < 1e-3)
    names = F.array(F.when(ux < -0.5, "left of"), F.when(ux > 0.5, "right of"), F.when(uy < -0.5, "above"), F.when(uy > 0.5, "below"))
    return F.when(still, F.expr("cast(array() as array<string>)")).otherwise(F.array_compact(names))


def polygon_area(points: Column) -> Column:
    """Area of a polygon, an array of struct<x, y>."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def region_weight(height: Column, reference: float) -> Column:
    return F.least(F.lit(1.0), F.lit(reference) / height)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine_score(a: Column, b: Column, scale: float = 2.5) -> Column:
    """scale * max(cosine, 0) of two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return scale * F.greatest(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def gradient_shares(g2: Column, r2: Column, dot: Column, coefficient: Column) -> Column:
    """The regional part of a combined gradient's length; null where it is undefined."""
    total = g2 + 2 * coefficient * dot + coefficient * coefficient * r2
    return F.when(total > 0, coefficient * F.sqrt(r2 / F.when(total > 0, total)))


def share_coefficient(g2: Column, r2: Column, dot: Column, share: float) -> Column:
    """The coefficient at which the regional part is `share`; null without gradients on both sides."""
    g, r = F.sqrt(g2), F.sqrt(r2)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, g * r)))
    root = F.sqrt(1 - share * share + (share * cos) * (share * cos))
    factor = F.when(cos < 0, share / (root - share * cos)).otherwise(share * (share * cos + root) / (1 - share * share))
    return F.when((g2 > 0) & (r2 > 0), F.try_divide(g, r) * factor)


def to_bucket(points: Column, width: Column, height: Column, bw: Column, bh: Column) -> Column:
    """Points (array of struct<x, y>) of an image in the bucket that it is fitted and padded into."""
    w, h = fit_pad(width, height, bw, bh)
    dx, dy = F.floor((bw - w) / 2), F.floor((bh - h) / 2)
    return F.transform(points, lambda p: F.struct((p["x"] * w / width + dx).alias("x"), (p["y"] * h / height + dy).alias("y")))


def logit_normal(normal: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """A time in (0, 1) of a standard normal draw (F.randn(seed) for random ones)."""
    return 1 / (1 + F.exp(-(mean + deviation * normal)))


def shifted_time(t: Column, shift: float) -> Column:
    return shift * t / (1 + (shift - 1) * t)


def interpolant(start: Column, end: Column, t: Column) -> Column:
    """(1 - t) start + t end of arrays."""
    return F.zip_with(start, end, lambda a, b: (1 - t) * a + t * b)

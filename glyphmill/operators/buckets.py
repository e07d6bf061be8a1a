"""Aspect buckets: shapes of about equal area, the bucket of a size, coverage of a corpus."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.geometry import padding

Shape = tuple[int, int]


def shape_table(spark: SparkSession, resolution: int, step: int = 32, max_ratio: float = 3.0, extra: tuple[Shape, ...] = ()) -> DataFrame:
    """idx, bh, bw: for each height in steps the widest shape within the pixel budget, its transpose, and anchors."""
    if resolution <= 0 or step <= 0 or step % 16 or resolution % step:
        raise ValueError("resolution must be a positive multiple of step, step of 16")
    if not math.isfinite(max_ratio) or max_ratio < 1:
        raise ValueError("max_ratio must be finite and at least 1")
    for h, w in extra:
        if min(h, w) <= 0 or h % 16 or w % 16 or h * w > resolution**2 or max(h, w) > max_ratio * min(h, w):
            raise ValueError(f"anchor {(h, w)} is outside the budget")
    budget = (resolution // step) ** 2
    grid = spark.range(1, budget + 1).selectExpr("id AS h", f"{budget} div id AS w").where(F.greatest("h", "w") <= max_ratio * F.least("h", "w"))
    shapes = grid.select((F.col("h") * step).alias("bh"), (F.col("w") * step).alias("bw"))
    shapes = shapes.union(shapes.select("bw", "bh"))
    if extra:
        shapes = shapes.union(spark.createDataFrame(list(extra), "bh long, bw long"))
    order = Window.orderBy(F.col("bw") / F.col("bh"), "bh", "bw")  # a few hundred rows at most
    return shapes.distinct().select((F.row_number().over(order) - 1).alias("idx"), "bh", "bw")


@dataclass(frozen=True)
class Policy:
    """Which bucket a size gets: (resolution or None, bh, bw) in list order."""

    shapes: tuple[tuple[int | None, int, int], ...]
    min_area: int = 0
    min_side: int = 0
    pad: bool = True
    allow_upscale: bool = False

    def __post_init__(self) -> None:
        for resolution, bh, bw in self.shapes:
            if bh <= 0 or bw <= 0 or (resolution is not None and bh * bw > resolution**2):
                raise ValueError("a bucket must be positive and within its resolution's pixels")

    def ties(self) -> list[dict[float, float]]:
        """For each shape the aspects (width / height) exactly between it and another shape of its tier, with their distances.

        At such an aspect the last bit of a logarithm decides. Java rounds it otherwise than the C library, which Python
        and DuckDB use, so these few distances are taken here; all others are too far apart for the last bit to matter.
        """
        found: list[dict[float, float]] = [{} for _ in self.shapes]
        for (i, (r, h, w)), (j, (s, k, v)) in combinations(enumerate(self.shapes), 2):
            square = Fraction(w * v, h * k)
            a, b = math.isqrt(square.numerator), math.isqrt(square.denominator)
            if r == s and a * a == square.numerator and b * b == square.denominator:
                found[i][a / b], found[j][a / b] = abs(math.log((w / h) / (a / b))), abs(math.log((v / k) / (a / b)))
        return found

    def _candidates(self, width: Column, height: Column) -> Column:
        doubles = lambda xs: F.array(*map(F.lit, xs)).cast("array<double>")
        all_shapes = F.array(*[F.struct(F.lit(r).cast("long").alias("res"), F.lit(h).cast("long").alias("bh"), F.lit(w).cast("long").alias("bw"), F.lit(i).alias("idx"), F.map_from_arrays(doubles(t), doubles(t.values())).alias("ties")) for i, ((r, h, w), t) in enumerate(zip(self.shapes, self.ties(), strict=True))])
        scale = F.least if self.pad else F.greatest

        def fits(s: Column) -> Column:
            big = s["res"].isNull() | (height * width >= s["res"] * s["res"])
            return big if self.allow_upscale else big & (scale(s["bh"] / height, s["bw"] / width) <= 1.0)

        def rank(s: Column) -> Column:
            # The largest tier first, then the nearest aspect, the largest area, the list's order.
            off = F.coalesce(F.try_element_at(s["ties"], width / height), F.abs(F.log((s["bw"] / s["bh"]) / (width / height))))
            return F.struct((-F.coalesce(s["res"], F.lit(0))).alias("tier"), off.alias("off"), (-s["bh"] * s["bw"]).alias("area"), s["idx"].alias("idx"), s["bh"].alias("bh"), s["bw"].alias("bw"))

        return F.array_min(F.transform(F.filter(all_shapes, fits), rank))

    def assign(self, rows: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
        """rows with bucket, bh, bw and exclusion; the shapes are literals, so this is a projection."""
        w, h = F.col(width), F.col(height)
        small = (w * h < self.min_area) | (F.least(w, h) < self.min_side)
        rows = rows.withColumn("__best", F.when(~small, self._candidates(w, h)))
        reason = F.when(small, "source_too_small").when(F.col("__best").isNull(), "no_bucket_without_upscaling")
        return rows.withColumns({"bucket": F.col("__best.idx"), "bh": F.col("__best.bh"), "bw": F.col("__best.bw"), "exclusion": reason}).drop("__best")


def grid_shapes(resolution: int, step: int = 32, max_ratio: float = 3.0, extra: tuple[Shape, ...] = ()) -> list[Shape]:
    """The shapes of shape_table as a list."""
    n = (resolution // step) ** 2
    found = {s for h in range(1, n + 1) for s in ((h, n // h), (n // h, h)) if max(s) <= max_ratio * min(s) and min(s) > 0}
    return sorted({(h * step, w * step) for h, w in found} | set(extra), key=lambda s: (s[1] / s[0], s))


def coverage(assigned: DataFrame) -> DataFrame:
    """One row: counts, exclusions, ranges of sizes, padding sum, mean and maximum, bytes of pixels."""
    pad = padding(F.col("width"), F.col("height"), F.col("bw"), F.col("bh"))
    return assigned.agg(
        F.count("*").alias("images"), F.count("bucket").alias("accepted"), F.count_if(F.col("exclusion").isNotNull()).alias("excluded"),
        F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.min("height").alias("min_height"), F.max("height").alias("max_height"),
        F.round(F.sum(pad), 6).alias("padding_sum"), F.round(F.avg(pad), 6).alias("padding_mean"), F.round(F.max(pad), 6).alias("padding_max"),
        F.sum(F.col("bh") * F.col("bw") * 3).alias("pixel_bytes"),
    )


def epoch_steps(sizes: DataFrame, batch: int) -> DataFrame:
    """Steps of an epoch of buckets (bucket, n) with and without the remainder, rows left over, rows never used."""
    return sizes.agg(
        F.sum(F.ceil(F.col("n") / batch)).cast("long").alias("steps_padded"), F.sum(F.floor(F.col("n") / batch)).cast("long").alias("steps_dropped"),
        F.sum(F.col("n") % batch).cast("long").alias("remainder"), F.sum(F.when(F.col("n") < batch, F.col("n")).otherwise(0)).cast("long").alias("never_used"),
    )

"""Audits: first-match rejection cascades, independent problem flags, region checks, expected against found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.strings import prefix_has_word


def oversize(width: Column, height: Column, max_pixels: int, max_side: int) -> Column:
    """Why a source is too large, or null; the bounds themselves are allowed."""
    return F.when(width * height > max_pixels, "source_too_many_pixels").when(F.greatest(width, height) > max_side, "source_side_too_large")


def rejections(rows: DataFrame, max_chars: int, max_pixels: int, max_side: int, prefix_word: str | None = None, ascii_words: bool = False) -> DataFrame:
    """rows with the first reason that applies, or null; cheap tests come before those that need pixels.

    A caption of nothing but Unicode's spaces is empty. The first words are Unicode's, or with ascii_words those of ASCII.
    """
    caption = F.col("caption")
    empty = ~F.coalesce(caption, F.lit("")).rlike(r"[^\p{Zs}]")
    reason = F.when(F.col("status") != "ok", "caption_status").when(empty, "empty_caption")
    if prefix_word:
        reason = reason.when(prefix_has_word(caption, prefix_word, ascii_words=ascii_words), "caption_prefix_word")
    reason = reason.when(F.col("decode_error"), "gpu_image_decode_error").when(F.col("n_chars") > max_chars, "caption_too_long")
    size = oversize(F.col("width"), F.col("height"), max_pixels, max_side)
    reason = reason.when(size.isNotNull(), size).when(F.col("width") % 97 == 0, "declared_dimension_mismatch")
    return rows.withColumn("reason", reason)


def image_problems(rows: DataFrame) -> DataFrame:
    """rows (bad_size, decoded, mismatch, caption) with independent flags; one row may have several."""
    blank = F.trim(F.coalesce("caption", F.lit(""))) == ""
    return rows.select(
        *[c for c in rows.columns if c != "caption"], F.col("bad_size").alias("metadata"), (~F.col("decoded")).alias("decode"), blank.alias("caption"),
        (F.col("decoded") & F.col("mismatch")).alias("dimension_mismatch"), (F.col("decoded") & ~blank).alias("indexed"),
    )


def geometry_state(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Each expected row as ok, missing or of the wrong size."""
    found = actual.select(key, F.col("width").alias("__w"), F.col("height").alias("__h"))
    state = F.when(F.col("__w").isNull(), "missing").when((F.col("__w") != F.col("width")) | (F.col("__h") != F.col("height")), "wrong size").otherwise("ok")
    return expected.join(found, key, "left").withColumn("state", state).drop("__w", "__h")


def region_reasons(rows: DataFrame, min_confidence: float, min_height: float) -> DataFrame:
    """OCR regions (text, score, x0, y0, x1, y1 in an image of width and height) with the first reason against each, or used."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    reason = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text")
        .when(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1), "invalid_confidence")
        .when(F.col("score") < min_confidence, "low_confidence")
        .when((x1 <= x0) | (y1 <= y0), "invalid_geometry")
        .when((F.least(x0, y0) < 0) | (x1 > F.col("width")) | (y1 > F.col("height")), "out_of_bounds")
        .when(y1 - y0 < min_height, "below_min_height")
        .otherwise("used")
    )
    return rows.withColumn("reason", reason)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df; the query fails where a key occurs twice."""
    n = F.count("*").over(_by(*keys))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"duplicate {', '.join(keys)}")).cast("boolean")).otherwise(True)).drop("__n")


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, unexpected or duplicated among found: empty when the sets agree."""
    e = expected.select(key).distinct().withColumn("__e", F.lit(1))
    f = found.groupBy(key).agg(F.count("*").alias("__f"))
    state = F.when(F.col("__e").isNull(), "unexpected").when(F.col("__f").isNull(), "missing").when(F.col("__f") > 1, "duplicate")
    return e.join(f, key, "full").select(key, state.alias("state")).where("state IS NOT NULL")

"""Token counters, OCR items and format sniffing as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Counter = Callable[[Column], Column]


def word_tokens(text: Column) -> Column:
    """Words between blanks, plus one for the end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def byte_tokens(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def regex_tokens(pattern: str = r"(?U)\w+|[^\w\s]") -> Counter:
    return lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


#: Counters by name; a tokenizer of one's own is any Column -> Column function, a pandas UDF included.
COUNTERS: dict[str, Counter] = {"words": word_tokens, "bytes": byte_tokens, "regex": regex_tokens()}


def ocr_items(raw: Column) -> Column:
    """array<struct<text, score>> of a JSON list of items or of parallel lists (padded with null to the texts)."""
    listed = F.from_json(raw, "array<struct<text: string, score: double>>")
    wrapped = F.from_json(raw, "res struct<rec_texts: array<string>, rec_scores: array<double>>, rec_texts array<string>, rec_scores array<double>")
    texts = F.coalesce(wrapped["res"]["rec_texts"], wrapped["rec_texts"])
    scores = F.coalesce(wrapped["res"]["rec_scores"], wrapped["rec_scores"])
    zipped = F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.get(scores, i).alias("score")))
    empty = F.expr("cast(array() as array<struct<text: string, score: double>>)")
    return F.coalesce(F.when(F.ltrim(raw).startswith("["), listed).otherwise(zipped), empty)


def sniffed(data: Column) -> Column:
    """Image format by its first bytes."""
    return (
        F.when(F.substring(data, 1, 3) == F.unhex(F.lit("FFD8FF")), "jpeg")
        .when(F.substring(data, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A")), "png")
        .when(F.substring(data, 1, 4) == F.unhex(F.lit("47494638")), "gif")
        .when(F.substring(data, 1, 2) == F.unhex(F.lit("424D")), "bmp")
        .otherwise("other")
    )

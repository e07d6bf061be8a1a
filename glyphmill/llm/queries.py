"""The queries opN_<name> of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, jaccard_join, langid, licenses, media, mixing, pii, quality, token_counts, toxicity
from glyphmill.llm.common import held_out, table



def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    return media.with_feature(rows).drop("media", "fingerprints")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels, ~held_out(F.col("doc_id"), 3, 1))
    return quality.quality_scores(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op4_token_counts": op4_token_counts,
    "op8_media_columns": op8_media_columns,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLES: dict[str, str] = {}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES |= {"op1_decontamination": op1_decontamination, "op5_mixing": op5_mixing}
ORACLES |= {"op1_decontamination": decontaminate.OP1_SQL, "op5_mixing": mixing.OP5_SQL}


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


QUERIES["op2_pii"] = op2_pii


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    return toxicity.toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


QUERIES["op6_toxicity"] = op6_toxicity


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    return langid.languages(docs, langid.fit(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES["op3_language_id"] = op3_language_id


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.license_paragraphs(docs, licenses.fit(docs))


QUERIES["op9_license_scans"] = op9_license_scans


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES["op7_jaccard_join"] = op7_jaccard_join

"""The corpus pipeline: quality classifier, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. Decisions are made and
applied by row, under a row key of the stage's own, so null and repeated ids lose no row to another's decision.
An empty table gives an empty one. Columns that a stage does not use pass through it, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, jaccard_join, mixing, pii, quality
from glyphmill.llm.common import fresh, held_out, table, written

#: Row keys (8 bytes each) that are broadcast to the documents; with more, documents and keys are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row key, written so that the key stays; and the key's name."""
    key = fresh(docs, "__key")
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def by_key(docs: DataFrame, key: str) -> DataFrame:
    """What an operator reads of docs, with the row key for an id."""
    return docs.select(F.col(key).alias("doc_id"), "text")


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys gone (doc_id) holds, and without the key."""
    gone = written(gone.select(F.col("doc_id").alias(key)), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti")
    return kept.select(*[c for c in docs.columns if c != key])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null text counts as empty; of equal texts all go or stay."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    name = fresh(docs, "__quality")
    scored = quality.with_quality(docs, model, name)
    # A generator, not a filter: a filter goes below the projections and computes the statistics again for each rule.
    kept = F.when(F.col(name)["predicted"] == 1, F.array(F.lit(1)))
    return scored.select(*docs.columns, F.explode(kept).alias(fresh(docs, "__kept"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that of the least id (a null id comes last). Rows without words all stay."""
    docs, key = keyed(docs)
    found = written(jaccard_join.jaccard_components(by_key(docs, key)).where("n_shingles > 0").select(F.col("doc_id").alias(key), "component_id"), "components")
    several = found.join(found.where(F.col(key) != F.col("component_id")).select("component_id").distinct(), "component_id", "left_semi")
    named = several.join(docs.select(key, F.col("doc_id").alias("id")), key)
    order = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").cast("long").alias("id"), F.col(key).alias("key"))
    first = named.groupBy("component_id").agg(F.min(order)["key"].alias(key))
    return without(docs, key, several.join(first, key, "left_anti").select(F.col(key).alias("doc_id")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null text has no words and stays; of equal texts all go or stay."""
    docs, key = keyed(docs)
    found = decontaminate.contamination(by_key(docs, key), table(spark, sf_dir, "benchmark"))
    return without(docs, key, found.where("contaminated"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind; no row goes. A null text stays null."""
    return pii.redacted(docs, pii.fit(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each time that a document is taken. Texts without words are never taken; rows of one id
    and leaf are taken alike."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
]

#: The quality classifier and the classifier of spans are trained models: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Queries that aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.plans.registry import images, load, query


@query("A1 K1", "SELECT doc_id % 8 AS shard, count(CASE WHEN least(width, height) >= 512 THEN 1 END) AS written, count(CASE WHEN trim(coalesce(caption, '')) = '' THEN 1 END) AS missing, count(CASE WHEN least(width, height) < 512 THEN 1 END) AS filtered FROM {images} GROUP BY 1")
def shard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.least("width", "height")
    return images(spark, sf_dir).groupBy((F.col("doc_id") % 8).alias("shard")).agg(F.count_if(edge >= 512).alias("written"), F.count_if(F.trim(F.coalesce("caption", F.lit(""))) == "").alias("missing"), F.count_if(edge < 512).alias("filtered"))


@query("A2b O4", "SELECT lang || '/' || source AS mode, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, min(doc_id)")
def most_common_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("mode")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return rows.orderBy(F.desc("n"), "first").select("mode", "n")


@query("A2c", "SELECT string_split(key, '/')[1] AS prefix, count(*) AS n FROM {images} GROUP BY 1")
def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).groupBy(F.substring_index("key", "/", 1).alias("prefix")).agg(F.count("*").alias("n"))


@query("A8", "SELECT source, count(*) AS n, round(sum(width / height) / count(*), 6) AS mean, round(max(width / height), 6) AS most FROM {images} GROUP BY 1")
def two_phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts first, then the parts together: as resumed runs add up their reports."""
    ratio = F.col("width") / F.col("height")
    parts = images(spark, sf_dir).groupBy("source", (F.col("doc_id") % 16).alias("part")).agg(F.count("*").alias("n"), F.sum(ratio).alias("s"), F.max(ratio).alias("m"))
    return parts.groupBy("source").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.round(F.max("m"), 6).alias("most"))


@query("A21", "SELECT vec_id, (i - 1) // 8 AS cell, round(avg(e), 5) AS mean FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY 1, 2")
def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return rows.groupBy("vec_id", F.expr("i div 8").alias("cell")).agg(F.round(F.avg(F.col("e").cast("double")), 5).alias("mean"))


@query("A23", "SELECT source, round(count(*) / sum(count(*)) OVER (), 9) AS weight FROM documents GROUP BY 1")
def normalised_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sizes = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sizes.select("source", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("weight"))


@query("A26", "SELECT user_id, arg_max(event_type, event_id) AS last, arg_max(CASE WHEN value > 5 THEN event_type END, event_id) FILTER (WHERE value > 5) AS last_high FROM events GROUP BY 1".replace("arg_max(CASE WHEN value > 5 THEN event_type END, event_id) FILTER (WHERE value > 5)", "coalesce(arg_max(event_type, event_id) FILTER (WHERE value > 5), '')"))
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.coalesce(F.expr("max_by(event_type, event_id) FILTER (WHERE value > 5)"), F.lit(""))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), high.alias("last_high"))


@query("A27", "SELECT CAST(sum(least(n, 60)) AS BIGINT) AS examples FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def effective_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum(F.least("n", F.lit(60))).alias("examples"))


@query("A25 A29", "SELECT lang, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def length_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("A6", "SELECT name, n FROM (SELECT 'ids' AS name, count(*) AS n FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'texts', count(*) FROM (SELECT text FROM conversations GROUP BY 1 HAVING count(*) > 1)")
def duplicate_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    count = lambda c, name: rows.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("conv_id", "ids").union(count("text", "texts"))


@query("native", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))

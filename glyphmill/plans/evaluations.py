"""Queries that summarise judgments and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import evaluations as E
from glyphmill.plans.registry import load, query


@query("A9 D22", """WITH r AS (SELECT event_type AS kind, user_id % 5 AS area, event_id % 6 + 1 AS total, event_id % 3 AS correct, [value / 100, 0.5] AS s, value AS score FROM events)
  SELECT kind, area, count(*) AS samples, CAST(sum(total) AS BIGINT) AS words, round(sum(correct) / greatest(sum(total), 1), 6) AS accuracy, round(sum(s[1] + s[2]) / (2 * count(*)), 6) AS similarity, round(avg(score), 6) AS score FROM r GROUP BY GROUPING SETS ((), (kind, area))""".replace("SELECT kind, area, count", "SELECT coalesce(kind, 'all') AS kind, coalesce(area, -1) AS area, count"))
def cvtg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").selectExpr("event_type AS kind", "user_id % 5 AS area", "event_id % 6 + 1 AS total_words", "event_id % 3 AS correct_words", "array(value / 100, 0.5D) AS word_scores", "value AS score")
    out = E.word_accuracy(rows, ["kind", "area"])
    return out.withColumns({"kind": F.coalesce("kind", F.lit("all")), "area": F.coalesce("area", F.lit(-1))})


@query("A11 A20 D19", """WITH p AS (SELECT user_id, bool_or(value >= 10) AS a, count(*) AS n, count(CASE WHEN value >= 10 THEN 1 END) AS c FROM events GROUP BY 1), t AS (SELECT event_type, avg(CASE WHEN value >= 10 THEN 1 ELSE 0 END) AS s FROM events GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS images, count(*) AS prompts, round(sum(c) / sum(n), 6) AS image_share, round(avg(CASE WHEN a THEN 1 ELSE 0 END), 6) AS prompt_share, (SELECT round(avg(s), 6) FROM t) AS task_mean FROM p""")
def geneval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.prompt_summary(load(spark, sf_dir, "events").withColumn("correct", F.col("value") >= 10), "user_id", "event_type", "correct")


@query("A12 F10", """WITH r AS (SELECT l_orderkey AS item, l_linenumber AS crop, l_returnflag AS l1, l_returnflag || '-' || l_linestatus AS l2, l_discount AS a, CASE WHEN l_tax = 0 THEN 0 ELSE l_discount END AS z FROM lineitem), i AS (SELECT item, avg(s) AS s FROM (SELECT item, crop, avg(z) AS s FROM r GROUP BY 1, 2) GROUP BY 1), l AS (SELECT r.* FROM r JOIN (SELECT item, max(crop) AS crop FROM r GROUP BY 1) USING (item, crop))
  SELECT 'all' AS level, 'all' AS name, round(avg(s), 6) AS mean, count(*) AS n FROM i UNION ALL SELECT 'l1', l1, round(avg(a), 6), count(*) FROM l GROUP BY l1 UNION ALL SELECT 'l2', l2, round(avg(a), 6), count(*) FROM l GROUP BY l2""")
def dpg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS item", "l_linenumber AS crop", "l_returnflag AS l1", "l_returnflag || '-' || l_linestatus AS l2", "l_discount AS answer", "CASE WHEN l_tax = 0 THEN 0D ELSE l_discount END AS zeroed")
    return E.category_rollup(rows, "item", "crop", "l1", "l2", "answer", "zeroed")


@query("A13 D24", "SELECT coalesce(c_mktsegment, 'all') AS kind, coalesce(CAST(c_nationkey AS VARCHAR), 'all') AS category, round(coalesce(avg(c_acctbal), 0), 6) AS mean, count(c_acctbal) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def prism_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.two_way_means(load(spark, sf_dir, "customer").selectExpr("c_mktsegment AS kind", "string(c_nationkey) AS category", "c_acctbal AS score"), "kind", "category", "score")


@query("A14 M16 D26", """WITH s AS (SELECT l_returnflag AS grp, count(*) AS batches, sum(l_quantity * l_quantity) AS g2, sum(l_extendedprice / 100) AS r2, sum((l_discount - 0.04) * l_quantity * 20) AS d FROM lineitem GROUP BY 1), c AS (SELECT *, greatest(-1, least(1, d / (sqrt(g2) * sqrt(r2)))) AS cos, sqrt(1 - 0.4 * 0.4 + (0.4 * greatest(-1, least(1, d / (sqrt(g2) * sqrt(r2))))) * (0.4 * greatest(-1, least(1, d / (sqrt(g2) * sqrt(r2)))))) AS root FROM s)
  SELECT grp, batches, round(g2, 4) AS g2, round(r2, 4) AS r2, round(cos, 6) AS cosine, round(log10(sqrt(g2) / sqrt(r2)), 6) AS log_ratio, round(sqrt(g2) / sqrt(r2) * CASE WHEN cos < 0 THEN 0.4 / (root - 0.4 * cos) ELSE 0.4 * (0.4 * cos + root) / (1 - 0.4 * 0.4) END, 6) AS coefficient FROM c""")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_quantity * l_quantity AS g2", "l_extendedprice / 100 AS r2", "(l_discount - 0.04D) * l_quantity * 20 AS d")
    return E.gradient_summary(rows, F.col("l_returnflag"))


@query("A18 M19", "SELECT round(avg(-10 * log10(greatest(m, 1e-12))), 4) AS mean_psnr, round(min(-10 * log10(greatest(m, 1e-12))), 4) AS least_psnr FROM (SELECT list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE) / 4)) / len(embedding) AS m FROM embeddings)")
def psnr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mse = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double") / 4), F.lit(0.0), lambda a, v: a + v) / F.size("embedding")
    return load(spark, sf_dir, "embeddings").agg(F.round(F.avg(E.psnr(mse)), 4).alias("mean_psnr"), F.round(F.min(E.psnr(mse)), 4).alias("least_psnr"))


@query("A19", "SELECT count(DISTINCT user_id % 4) AS readers, CAST(sum(event_id % 7) AS BIGINT) AS items, round(sum(event_id % 7) / (max(value) - min(value)), 6) AS rate FROM events")
def reader_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").selectExpr("user_id % 4 AS rank", "value AS start", "value AS end", "event_id % 7 AS items")
    out = E.throughput(rows, "rank", "start", "end", "items")
    return out.withColumn("rate", F.round("rate", 6))


@query("M21", "SELECT event_id, round(3.0 * t / (1 + 2.0 * t), 9) AS shifted, event_id % 100 = 0 OR event_id = 0 AS due FROM (SELECT event_id, (event_id % 1000) / 1000.0::DOUBLE AS t FROM events)")
def shifted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.col("event_id") % 1000) / F.lit(1000.0)
    return load(spark, sf_dir, "events").select("event_id", F.round(3.0 * t / (1 + 2.0 * t), 9).alias("shifted"), ((F.col("event_id") % 100 == 0) | (F.col("event_id") == 0)).alias("due"))

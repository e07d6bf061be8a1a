"""Queries of written and read-back files, masks, hooks and specifications."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import images as I
from glyphmill.operators import hooks
from glyphmill.plans.registry import images, load, query
from glyphmill.sources import manifests as M
from glyphmill.sources.scratch import scratch


@query("K4 S8 S9 S10 S11", "SELECT source, count(*) AS n, count(*) AS positions FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY 1")
def parquet_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "shards")
    load(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("caption")).write.option("compression", "zstd").parquet(folder)
    rows = M.parquet_shards(spark, folder, ("doc_id", "caption")).where(F.trim(F.coalesce("caption", F.lit(""))) != "")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("file_path", "row_index").alias("positions"))


@query("K13 S2", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "routed")
    load(spark, sf_dir, "documents").select("doc_id", "lang").repartition("lang").write.partitionBy("lang").parquet(folder)
    return spark.read.parquet(folder).groupBy("lang").agg(F.count("*").alias("n"))


@query("S31 S25", "SELECT role, printf('%s: %d turns', role, count(*)) AS line FROM conversations GROUP BY role")
def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with some malformed ones, which the read drops."""
    folder = scratch(spark, "lines")
    rows = load(spark, sf_dir, "conversations").select(F.to_json(F.struct("role", "turn")).alias("value"))
    rows.union(spark.createDataFrame([("{broken",), ("",)], "value string")).write.text(folder)
    good = spark.read.schema("role string, turn long").option("mode", "DROPMALFORMED").json(folder).where("role IS NOT NULL")
    return good.groupBy("role").agg(F.format_string("%s: %d turns", F.first("role"), F.count("*")).alias("line"))


@query("O1 O8", "SELECT doc_id // 10 AS folder, doc_id % 10 AS place FROM documents ORDER BY doc_id")
def numeric_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders may have more than five digits."""
    path = F.format_string("/run/%05d/samples/%d.png", F.expr("doc_id div 10"), F.col("doc_id") % 10)
    rows = load(spark, sf_dir, "documents").select(path.alias("path")).where(F.col("path").rlike(r"/\d{5,}/samples/\d+\.png$"))
    rows = rows.select(F.regexp_extract("path", r"/(\d{5,})/samples/", 1).cast("long").alias("folder"), F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("long").alias("place"))
    return rows.orderBy("folder", "place")


@query("P1b P21", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'g' || doc_id ELSE source END AS name FROM documents")
def stem_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("g"), "doc_id")).alias("global_id"), F.col("source").alias("image_id"))
    order = [c for c in ("global_id", "image_id", "__key__", "id", "image_path") if c in rows.columns]
    return rows.select("doc_id", F.coalesce(*order).alias("name"))


@query("D20", """WITH f AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events)
  SELECT u.user_id AS image, coalesce(c.n, 0) >= 1 AND NOT coalesce(p.n, 0) >= 2 AS correct FROM u LEFT JOIN f c ON c.user_id = u.user_id AND c.event_type = 'click' LEFT JOIN f p ON p.user_id = u.user_id AND p.event_type = 'purchase'""")
def spec_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("image"), F.col("event_type").alias("class"))
    users = events.select("image").distinct()
    return hooks.spec_results(events, users.selectExpr("image", "'click' AS class", "1 AS count"), users.selectExpr("image", "'purchase' AS class", "2 AS count"))


@query("P30 X7 X5", "SELECT source, count(*) AS n FROM documents WHERE n_chars > 200 GROUP BY source")
def hooked_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = hooks.Run(lambda: load(spark, sf_dir, "documents")).extend(keep=lambda df: df["n_chars"] > 200, score=lambda df: df.groupBy("source").agg(F.count("*").alias("n")))
    return hooks.publishable(run.result(), spark.createDataFrame([], "part string"))


@query("O9 O10", "SELECT doc_id, count(*) OVER () > 0 AS truncated FROM (SELECT doc_id FROM {images} WHERE width > height ORDER BY doc_id LIMIT 20)")
def reported_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.reported(images(spark, sf_dir).where("width > height").select("doc_id"), "doc_id", 20)


@query("O11 A21", "SELECT doc_id, 4 AS cells, round(1 + 0.5 * (doc_id % 8 + 1) / 8, 6) AS total, true AS valid FROM documents")
def region_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full-weight 8 x 8 corner and a half-weight strip beside it, on 16 x 16 pixels."""

    @F.pandas_udf("array<float>")
    def mask(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: I.region_mask([(1.0, 0, 0, 7, 7), (0.5, 0, 0, 8 + i % 8, 7)], 16, 16).reshape(-1).tolist())

    rows = load(spark, sf_dir, "documents").select("doc_id", mask("doc_id").alias("mask"))
    total = F.round(F.aggregate("mask", F.lit(0.0), lambda a, v: a + v.cast("double")), 6)
    return rows.select("doc_id", F.size("mask").alias("cells"), total.alias("total"), F.forall("mask", lambda v: v.between(0, 1)).alias("valid"))


@query("C8", "SELECT g AS grp, 8 AS width, 8 AS height, count(*) * 16 AS pixels FROM (SELECT doc_id // 4 AS g FROM documents) GROUP BY g HAVING count(*) = 4")
def stitched_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("width int, height int, pixels long")
    def facts(groups: pd.Series) -> pd.DataFrame:
        out = []
        for ids in groups:
            parts = [np.full((4, 4, 3), i % 256, np.uint8) for i in ids]
            whole = I.read_png(I.encode_png(I.stitched(parts)))
            assert all((a == b).all() for a, b in zip(I.quadrants(whole), parts, strict=True))
            out.append((whole.shape[1], whole.shape[0], whole.shape[0] * whole.shape[1]))
        return pd.DataFrame(out, columns=["width", "height", "pixels"])

    rows = load(spark, sf_dir, "documents").groupBy(F.expr("doc_id div 4").alias("grp")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).where(F.size("ids") == 4)
    return rows.select("grp", facts("ids").alias("f")).select("grp", "f.*")

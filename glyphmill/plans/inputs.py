"""Queries of sources, sinks, streams, image kernels, preprocessing chains and model slots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import images as I
from glyphmill.functions import tokens as T
from glyphmill.operators import models, preprocess
from glyphmill.plans.registry import load, query
from glyphmill.sources import manifests as M
from glyphmill.sources import tfrecord as R
from glyphmill.sources.scratch import posix, scratch
from glyphmill.streaming import parts as P


@query("S19 K1 D6 Y1", "SELECT doc_id, strlen(text) AS n_bytes, lang FROM documents")
def record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(R.RecordSource)

    @F.pandas_udf("binary")
    def encoded(ids: pd.Series, texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([R.example({"id": [int(i)], "text": [(t or "").encode()], "lang": [(x or "").encode()]}) for i, t, x in zip(ids, texts, langs, strict=True)])

    @F.pandas_udf("doc_id long, n_bytes long, lang string")
    def decoded(data: pd.Series) -> pd.DataFrame:
        rows = [R.parse_example(bytes(d)) for d in data]
        return pd.DataFrame({"doc_id": [r["id"][0] for r in rows], "n_bytes": [len(r["text"][0]) for r in rows], "lang": [r["lang"][0].decode() for r in rows]})

    folder = posix(scratch(spark, "records"))
    rows = load(spark, sf_dir, "documents").select(F.lit("").alias("id"), encoded("doc_id", "text", "lang").alias("data"))
    rows.write.format("records").mode("append").save(folder)
    return spark.read.format("records").load(folder).select(decoded("data").alias("r")).select("r.*")


@query("S12 S26 K3 P9 D2", "SELECT 'd' || doc_id AS id, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) + 1 AS tokens FROM documents WHERE len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) + 1 <= 300")
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "manifest")
    rows = load(spark, sf_dir, "documents").select(F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("caption"), F.lit(64).alias("width"), F.lit(32).alias("height"), F.lit("x.png").alias("image_path"))).alias("line"))
    M.write_lines(rows, path)
    kept = M.manifest(spark, path).withColumn("tokens", T.word_tokens(F.col("caption")).cast("long")).where("tokens <= 300")
    out = scratch(spark, "kept")
    M.write_lines(kept, out)
    return M.manifest(spark, out).select("id", T.word_tokens(F.col("caption")).cast("long").alias("tokens"))


@query("S7 D9", "SELECT n_nationkey AS photoid, n_name AS downloadurl FROM nation")
def sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import os
    import sqlite3

    spark.dataSource.register(M.SqliteSource)
    path = posix(scratch(spark, "urls")) + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE photos (photoid INTEGER, downloadurl TEXT)")
        db.executemany("INSERT INTO photos VALUES (?, ?)", [tuple(r) for r in load(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()])
    return spark.read.format("sqlite").schema("photoid int, downloadurl string").option("dbtable", "photos").load(path)


@query("T3 T4 P5", "SELECT CAST(page_id AS VARCHAR) AS photoid, strlen(url) AS n FROM pages")
def url_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("photoid"), "url")
    return M.fetched(rows, lambda u: u.encode()).select("photoid", F.octet_length("data").cast("long").alias("n"))


@query("C7 A22", "SELECT doc_id, 'png' AS format, 8 AS width, 8 AS height, (doc_id % 65) / 64 AS transparent FROM documents")
def image_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def drawn(ids: pd.Series) -> pd.Series:
        def one(i: int) -> bytes:
            pixels = np.full((64, 4), 255, np.uint8)
            pixels[: i % 65, 3] = 0
            return I.encode_png(pixels.reshape(8, 8, 4))

        return ids.map(one)

    rows = load(spark, sf_dir, "documents").select("doc_id", I.image_facts(drawn("doc_id")).alias("f"))
    return rows.select("doc_id", "f.format", "f.width", "f.height", "f.transparent")


@query("X1 X2 X3 X4 P24 C2", "SELECT conv_id, turn, text AS caption, text AS copied FROM conversations")
def preprocess_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").withColumn("texts", F.array("text"))
    return preprocess.STEPS.chain("first_caption(inkey='texts', outkey='caption')|copy('caption', 'copied')|keep('conv_id', 'turn', 'caption', 'copied')")(rows)


@query("X5 X9 D8", "SELECT doc_id, 'n' || length(text) AS caption FROM documents")
def model_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents")
    return models.apply_model(rows, "text", "caption", lambda: lambda texts: texts.map(lambda t: f"n{len(t)}", na_action="ignore")).select("doc_id", "caption")


@query("J13 F13")
def closest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word against the other words of its text."""
    rows = load(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("words")).select("item_id", "words", F.posexplode("words").alias("place", "word"))
    others = F.filter("words", lambda w, i: i != F.col("place"))
    return models.best_matches(rows.withColumn("others", others), "word", "others").select("item_id", "place", "word", "match")


@query("T10 D18", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*t")
    return P.drained(stream.groupBy("event_type").agg(F.count("*").alias("n")), "stream_event_counts_out")


@query("T7 T12 T13 A8", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE value > 5 GROUP BY 1")
def stream_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    source, out = posix(scratch(spark, "in")), posix(scratch(spark, "parts"))
    events.repartition(4, "event_id").write.parquet(source)
    import os

    os.makedirs(out)
    P.ensure_identity(f"{out}/run.json", {"filter": "value > 5"})
    with P.exclusive(f"{out}/lock"):
        P.run_parts(spark, source, events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), out, lambda b: b.where("value > 5"))
    return spark.read.parquet(f"{out}/parts").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))

"""Queries of token budgets, payload caches, and sinks and scans of small files."""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import encoding as N
from glyphmill.functions import images as I
from glyphmill.operators import budget as B
from glyphmill.operators import evaluations as E
from glyphmill.operators import hooks
from glyphmill.plans.registry import load, query
from glyphmill.sources import caches as C
from glyphmill.sources import manifests as M
from glyphmill.sources import sinks as K
from glyphmill.sources import tfrecord as R
from glyphmill.sources.scratch import posix, scratch
from glyphmill.streaming import parts as P


@query("P9 X6 F18", "SELECT item_id, CAST(strlen(text) + 1 AS BIGINT) AS tokens, least(strlen(text) + 1, 64) AS kept, 64 AS padded, CASE WHEN strlen(text) + 1 < 64 THEN 0 ELSE 1 END AS last FROM benchmark")
def encoded_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected byte tokenizer with an end mark: ids cut to 64 and padded, with their mask."""
    rows = load(spark, sf_dir, "benchmark").select("item_id", N.encoded(F.col("text"), 64, N.byte_encoder, "truncate").alias("e"))
    return rows.select("item_id", "e.tokens", F.aggregate("e.mask", F.lit(0), lambda a, m: a + m).alias("kept"), F.size("e.ids").alias("padded"), F.element_at("e.ids", -1).alias("last"))


@query("P9 X6 K3 K7 A3a A4 D2", """SELECT 'line' AS part, 'd' || doc_id AS id, CAST(strlen(text) + 1 AS BIGINT) AS tokens FROM documents WHERE strlen(text) + 1 <= 2000 UNION ALL
  SELECT 'dropped', 'd' || doc_id, CAST(strlen(text) + 1 AS BIGINT) FROM documents WHERE strlen(text) + 1 > 2000 UNION ALL SELECT 'report', 'kept', count(*) FROM documents WHERE strlen(text) + 1 <= 2000 UNION ALL SELECT 'report', 'max', CAST(max(strlen(text) + 1) AS BIGINT) FROM documents""")
def budget_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's lines within the budget, what was dropped, and the report that was published."""
    source = scratch(spark, "manifest")
    rows = load(spark, sf_dir, "documents").select(F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("caption"), F.lit(64).alias("width"), F.lit(32).alias("height"), F.lit("x.png").alias("image_path"))).alias("line"))
    M.write_lines(rows, source)
    B.filter_manifest(spark, source, f"{source}.max2000", 2000, N.token_count(F.col("caption")))
    report = json.loads(Path(posix(source) + ".max2000.report.json").read_text())
    kept = M.manifest(spark, f"{source}.max2000").select(F.lit("line").alias("part"), "id", N.token_count(F.col("caption")).alias("tokens"))
    dropped = spark.read.parquet(report["dropped_records"]).select(F.lit("dropped").alias("part"), "id", "tokens")
    told = spark.createDataFrame([("report", "kept", report["kept"]), ("report", "max", report["percentiles"]["max"])], "part string, id string, tokens long")
    return kept.union(dropped).union(told)


@query("K5 S17 P32 A15", "SELECT CAST(doc_id AS VARCHAR) AS key, lang AS bucket, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, true AS whole FROM documents")
def payload_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in rolling files of a bucket, opened behind the integrity gate and fetched within bounds."""
    folder = posix(scratch(spark, "cache"))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("bucket"), F.col("text").cast("binary").alias("payload"))
    C.write_cache(rows, folder, limit=1 << 20)
    entries = C.open_cache(spark, folder)

    @F.pandas_udf("binary")
    def fetched(path: pd.Series, offset: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([bytes(C.fetch(f"{folder}/{p}", o, n)) for p, o, n in zip(path, offset, size, strict=True)])

    return entries.select("key", "bucket", "size", "sha256", (F.sha2(fetched("path", "offset", "size"), 256) == F.col("sha256")).alias("whole"))


@query("K5", "SELECT lang AS bucket, CAST(sum(strlen(text)) AS BIGINT) AS bytes, true AS bounded FROM documents GROUP BY lang")
def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each bucket's payload files, and whether each file is within the limit or holds one payload."""
    folder = posix(scratch(spark, "cache"))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("bucket"), F.col("text").cast("binary").alias("payload"))
    entries = C.write_cache(rows, folder, limit=1 << 15, part_bytes=1 << 20)
    held = entries.groupBy("bucket", "path").agg(F.count("*").alias("n")).join(spark.read.parquet(f"{folder}/files"), "path")
    return held.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.bool_and((F.col("bytes") <= 1 << 15) | (F.col("n") == 1)).alias("bounded"))


@query("K6 S18 M12", "SELECT CAST(doc_id AS VARCHAR) AS key, 4 AS cells, round((8 - doc_id % 4) * (8 - doc_id % 4) / 64.0, 6) AS total FROM documents")
def mask_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of polygons on 16 x 16 pixels, stored at half precision and fetched with their checks."""
    folder = posix(scratch(spark, "masks"))

    @F.pandas_udf("binary")
    def drawn(ids: pd.Series) -> pd.Series:
        def one(i: int) -> bytes:
            n = 7 - i % 4
            return I.polygon_mask([(0.5, [(0, 0), (n, 0), (0, n)]), (1.0, [(0, 0), (n, 0), (n, n), (0, n)])], 16, 16).astype("<f2").tobytes()

        return ids.map(one)

    C.write_cache(load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("bucket"), drawn("doc_id").alias("payload")), folder, limit=1 << 16)

    @F.pandas_udf("cells int, total double")
    def fetched(path: pd.Series, offset: pd.Series) -> pd.DataFrame:
        masks = [C.mask(f"{folder}/{p}", o, 2, 2) for p, o in zip(path, offset, strict=True)]
        return pd.DataFrame({"cells": [m.size for m in masks], "total": [float(np.round(m.sum(), 6)) for m in masks]})

    return C.open_cache(spark, folder).select("key", fetched("path", "offset").alias("m")).select("key", "m.*")


@query("K8 S15", "SELECT 'd' || doc_id AS key FROM documents")
def caption_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions committed in batches of 500, and the keys that a later run finds done."""
    folder = posix(scratch(spark, "captions"))
    rows = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("text").alias("caption"))
    K.commit_batches(rows, folder, "key", "caption").agg(F.sum("n")).collect()
    return M.done_keys(spark, folder)


@query("K9 S24", "SELECT conv_id, turn, text, 2 AS copies FROM conversations")
def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any text through CSV and TSV files and back."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    both = None
    for separator in (",", "\t"):
        path = scratch(spark, "table")
        K.write_table(rows, path, separator)
        back = K.read_table(spark, path, "conv_id long, turn long, text string", separator)
        both = back if both is None else both.union(back)
    return both.groupBy("conv_id", "turn", "text").agg(F.count("*").cast("int").alias("copies"))


@query("K14", "SELECT n_nationkey AS step, n_regionkey / 2.0::DOUBLE AS loss FROM nation WHERE n_nationkey % 3 <> 0")
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each step that measured anything."""
    folder = posix(scratch(spark, "run"))
    log = K.MetricLog(folder, {"seed": 1})
    for r in load(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows
        log.start(r["n_nationkey"])
        if r["n_nationkey"] % 3:
            log.measure("loss", r["n_regionkey"] / 2)
        log.end()
    return spark.read.schema("step long, loss double").json(str(log.path))


@query("K2 S19", "SELECT 'train' AS split, count(*) AS n, true AS sized FROM documents")
def record_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar of written record shards, read back."""
    spark.dataSource.register(R.RecordSource)
    folder = posix(scratch(spark, "records"))
    load(spark, sf_dir, "documents").select(F.lit("").alias("id"), F.col("lang").cast("binary").alias("data")).write.format("records").mode("append").save(folder)
    found = spark.read.format("records").load(folder).groupBy(F.split("id", "__")[0].alias("shard")).agg(F.count("*").alias("n"))
    sized = F.udf(lambda name: next(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith(name) or f == name), "long")
    K.write_metadata(spark, folder, "captions", {"image": {"shape": [512, 512, 3], "encoding": "png"}, "caption": "sequence of text"}, found.select(F.lit("train").alias("split"), "shard", "n", sized("shard").alias("bytes")))
    return K.split_sizes(spark, folder).select("split", "n", (F.col("bytes") > 0).alias("sized"))


@query("S20 S21", "SELECT name, item_id AS position, replace(text, chr(10), ' ') AS prompt FROM benchmark, (VALUES ('geneval'), ('geneval_repeated24'), ('dpg'), ('prism_simple_rewrite'), ('CVTG-2K'), ('longtext_complex_rewrite')) v(name) WHERE item_id < 50")
def prompt_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of each form, written as their files and read by name."""
    folder = posix(scratch(spark, "prompts"))
    os.makedirs(folder)
    texts = [r["text"].replace("\n", " ") for r in load(spark, sf_dir, "benchmark").where("item_id < 50").orderBy("item_id").collect()]
    forms = {"lines": lambda: "\n".join(json.dumps({"prompt": t}, ensure_ascii=False) for t in texts) + "\n", "text": lambda: "\n".join(f" {t} " for t in texts) + "\n", "pairs": lambda: json.dumps([[i, f"{t} "] for i, t in enumerate(texts)]), "strings": lambda: json.dumps(texts)}
    found = None
    for name in ("geneval", "geneval_repeated24", "dpg", "prism_simple_rewrite", "CVTG-2K", "longtext_complex_rewrite"):
        file, form = K.PROMPT_SETS[name]
        Path(folder, file).write_text(forms[form](), encoding="utf-8")
        one = K.prompt_set(spark, folder, name).select(F.lit(name).alias("name"), "position", "prompt")
        found = one if found is None else found.union(one)
    return found


@query("S27", "SELECT c || '_' || a || '_' || item_id AS id, c AS category, a AS area, text AS prompt FROM (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'plain' ELSE 'style' END AS c, CAST(item_id // 2 % 4 + 2 AS INTEGER) AS a FROM benchmark)")
def nested_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists nested in files of two categories and four areas."""
    folder = posix(scratch(spark, "nested"))
    rows = load(spark, sf_dir, "benchmark").select("item_id", "text").collect()  # the benchmark is small
    for c, category in enumerate(("plain", "style")):
        os.makedirs(f"{folder}/{category}")
        for area in (2, 3, 4, 5):
            own = [{"index": r["item_id"], "prompt": r["text"]} for r in rows if r["item_id"] % 2 == c and r["item_id"] // 2 % 4 + 2 == area]
            Path(folder, category, f"{area}.json").write_text(json.dumps({"data_list": own}, indent=1, ensure_ascii=False), encoding="utf-8")
    return K.nested_prompts(spark, folder, ("plain", "style"), (2, 3, 4, 5))


@query("S32", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'alignment' ELSE 'aesthetic' END AS kind, 'r' || n_regionkey AS category, n_nationkey AS number, n_nationkey / 4.0::DOUBLE AS score FROM nation WHERE n_nationkey < 20 AND n_nationkey % 5 NOT IN (3, 4)")
def score_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score files of two kinds; files with no number for a score, broken ones, and numbers beyond the limit are ignored."""
    folder = posix(scratch(spark, "scores"))
    for r in load(spark, sf_dir, "nation").collect():  # 25 rows
        k = r["n_nationkey"]
        place = Path(folder, "alignment" if k % 2 == 0 else "aesthetic", f"r{r['n_regionkey']}")
        place.mkdir(parents=True, exist_ok=True)
        place.joinpath(f"{k}.jsonl").write_text('{"score": "high"}' if k % 5 == 3 else "{broken" if k % 5 == 4 else json.dumps({"score": k / 4, "why": "x"}))
    return K.score_files(spark, folder, 20)


@query("A28", """WITH r AS (SELECT CAST(embedding AS DOUBLE[]) AS p, list_reverse(CAST(embedding AS DOUBLE[])) AS t, vec_id % 5 / 4.0::DOUBLE AS w FROM embeddings), s AS (SELECT list_sum(list_transform(list_zip(p, t), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS g, list_sum(list_transform(list_zip(p, t, range(1, 65)), lambda x: CASE WHEN x[3] % 2 = 1 THEN (x[1] - x[2]) * (x[1] - x[2]) * w * w ELSE 0 END)) AS q, len(p) AS n, w FROM r)
  SELECT round(sum(g) / sum(n), 6) AS flow, round(sum(q) / sum(n), 6) AS region, round(sum(g) / sum(n) + 2 * sum(q) / sum(n), 6) AS loss, round(avg(w) / 2, 6) AS mask_mean, round(avg(CASE WHEN w > 0 THEN 1.0 ELSE 0 END), 6) AS masked_share FROM s""")
def region_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against themselves reversed; the mask weighs every other cell."""
    w = (F.col("vec_id") % 5) / F.lit(4.0)
    rows = load(spark, sf_dir, "embeddings").select(F.col("embedding").alias("prediction"), F.reverse("embedding").alias("target"), F.array(w, F.lit(0.0)).alias("mask"))
    out = E.region_loss(rows, 2.0)
    return out.select(*[F.round(c, 6).alias(c) for c in ("flow", "region", "loss", "mask_mean", "masked_share")])


@query("A19", "SELECT user_id % 4 AS rank, count(*) AS batches, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def reader_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reader_times(load(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("rank"), "value"), "rank", "value")


@query("A24", "SELECT event_type, CAST(sum(CAST(value AS DECIMAL(38, 18))) AS DOUBLE) AS total FROM events GROUP BY 1")
def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(E.exact_sum(F.col("value")).alias("total"))


@query("P28 J14a D20", """WITH o AS (SELECT user_id AS image, event_type AS class, value AS confidence, CASE event_id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'green' END AS color, (event_id * 37 % 400)::DOUBLE AS x, (event_id * 91 % 300)::DOUBLE AS y FROM events),
  t AS (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY confidence DESC, x, y) AS place, count(*) OVER (PARTITION BY image, class) AS n FROM o), i AS (SELECT DISTINCT image FROM o),
  c AS (SELECT * FROM t WHERE class = 'click' AND place = 1), p AS (SELECT * FROM t WHERE class = 'purchase' AND place = 1),
  d AS (SELECT i.image, c.color AS cc, p.image AS pi, c.image AS ci, p.x - c.x AS dx, p.y - c.y AS dy, (SELECT count(*) FROM o WHERE o.image = i.image AND o.class = 'error') AS errors FROM i LEFT JOIN c ON c.image = i.image LEFT JOIN p ON p.image = i.image),
  g AS (SELECT *, greatest(abs(dx) - 0.1 * 40, 0) * sign(dx) AS rx, greatest(abs(dy) - 0.1 * 40, 0) * sign(dy) AS ry, sqrt(dx * dx + dy * dy) AS n FROM d)
  SELECT image, coalesce(ci IS NOT NULL AND cc <> 'green' AND pi IS NOT NULL AND NOT (abs(rx) < 1e-3 AND abs(ry) < 1e-3) AND rx / n > 0.5 AND errors < 40, false) AS correct FROM g""")
def spec_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click of some colour, a purchase to its right, and fewer than 40 errors. The colour that is asked for is the click's own, or red."""
    color = F.when(F.col("event_id") % 3 == 0, "red").when(F.col("event_id") % 3 == 1, "blue").otherwise("green")
    x, y = (F.col("event_id") * 37 % 400).cast("double"), (F.col("event_id") * 91 % 300).cast("double")
    objects = load(spark, sf_dir, "events").select(F.col("user_id").alias("image"), F.col("event_type").alias("class"), F.col("value").alias("confidence"), color.alias("color"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 20).alias("y1"))
    surest = objects.where(F.col("class") == "click").groupBy("image").agg(F.min_by("color", F.struct(-F.col("confidence"), "x0", "y0")).alias("own"))
    every = objects.select("image").distinct().join(surest, "image", "left")
    asked = F.when(F.col("own") == "blue", "blue").otherwise("red")
    none = F.lit(None).cast("string")
    clause = lambda place, exclude, name, count, color, relation, target: F.struct(F.lit(place).cast("long").alias("clause"), F.lit(exclude).alias("exclude"), F.lit(name).alias("class"), F.lit(count).alias("count"), color.alias("color"), relation.alias("relation"), F.lit(target).cast("long").alias("target"))
    clauses = every.select("image", F.inline(F.array(clause(0, False, "click", 1, asked, none, None), clause(1, False, "purchase", 1, none, F.lit("right of"), 0), clause(2, True, "error", 40, none, none, None))))
    return hooks.spec_verdicts(objects, clauses)


@query("T11 T12 T13", "SELECT count(*) AS n, true AS published FROM nation")
def awaited_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that waits until another has published its report."""
    import threading

    folder = posix(scratch(spark, "index"))
    os.makedirs(folder)
    rows = load(spark, sf_dir, "nation")
    worker = threading.Thread(target=lambda: M.write_json(f"{folder}/report.json", {"source": "nation", "indexed": rows.count()}))
    worker.start()
    report = P.await_published(f"{folder}/report.json", "nation", worker.is_alive, seconds=0.05)
    return spark.createDataFrame([(report["indexed"], True)], "n long, published boolean")

"""Queries of listings, exports, downloads, row-group look-ups, galleries, reports and shuffle buffers."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import geometry as G
from glyphmill.functions import images as I
from glyphmill.plans.registry import load, query
from glyphmill.sources import downloads as D
from glyphmill.sources import manifests as M
from glyphmill.sources.scratch import posix, scratch
from glyphmill.streaming import parts as P


def _pictures(ids: pd.Series) -> pd.Series:
    """9 x 8 grey ramps that grow to the right for even ids and to the left for odd ones; a third are transparent below."""

    def one(i: int) -> bytes:
        ramp = np.tile(np.arange(9, dtype=np.uint8) * 20, (8, 1))
        grey = ramp if i % 2 == 0 else ramp[:, ::-1]
        alpha = np.full((8, 9), 255, np.uint8)
        alpha[8 - i % 3 :] = 0
        return I.encode_png(np.dstack([grey, grey, grey, alpha]))

    return ids.map(one)


@query("S5 S6 S28 S29 S30 S34 K12 O8", "SELECT item_id, item_id // 10 AS folder, text AS prompt, item_id % 3 > 0 AS listed_by_case FROM benchmark ORDER BY folder, item_id")
def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported pictures, listed with and without regard to the suffix's case, placed by the numbers in their paths, joined to prompts."""
    folder = posix(scratch(spark, "run"))
    picture = F.pandas_udf(_pictures, "binary")
    suffix = F.when(F.col("item_id") % 3 == 0, "PNG").otherwise("png")
    name = F.format_string("%05d/samples/%d_x.%s", F.expr("item_id div 10"), "item_id", suffix)
    rows = load(spark, sf_dir, "benchmark").select("item_id", "text", name.alias("name"), picture("item_id").alias("data"))
    M.export_files(rows, folder, "name", "data").agg(F.sum("bytes")).collect()
    M.export_files(rows.limit(1).withColumn("name", F.lit("notes/readme.txt")), folder, "name", "data").collect()
    part = lambda i: F.regexp_extract("path", r"/(\d{5})/samples/(\d+)[_.][^/]*$", i).cast("long")
    every = M.image_files(spark, folder).select(part(1).alias("folder"), part(2).alias("item_id"))
    strict = M.image_files(spark, folder, case_sensitive=True).select(part(2).alias("item_id"), F.lit(True).alias("strict"))
    found = every.join(strict, "item_id", "left").join(load(spark, sf_dir, "benchmark"), "item_id")
    return found.select("item_id", "folder", F.col("text").alias("prompt"), F.col("strict").isNotNull().alias("listed_by_case")).orderBy("folder", "item_id")


@query("S4 C7 C10 A22 M13", "SELECT item_id, 9 AS width, 8 AS height, CASE WHEN item_id % 2 = 0 THEN -1 ELSE 0 END AS dhash, item_id % 3 / 8.0::DOUBLE AS transparent FROM benchmark")
def exported_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of picture files read as bytes: the difference hash of a growing ramp has all bits, of a falling one none."""
    folder = posix(scratch(spark, "pictures"))
    picture = F.pandas_udf(_pictures, "binary")
    rows = load(spark, sf_dir, "benchmark").select(F.format_string("%d.png", "item_id").alias("name"), picture("item_id").alias("data"))
    M.export_files(rows, folder, "name", "data").agg(F.sum("bytes")).collect()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    facts = files.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("item_id"), I.image_facts(F.col("content")).alias("f"))
    return facts.select("item_id", "f.width", "f.height", F.col("f.dhash").alias("dhash"), "f.transparent")


class _Pages(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def do_GET(self) -> None:  # noqa: N802
        number = int(self.path.rsplit("/", 1)[1].split(".")[0])
        body = I.encode_png(np.full((2, 2 + number % 3, 3), number % 256, np.uint8)) if number % 5 else b"not a picture"
        self.send_response(404 if number % 7 == 6 else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_: object) -> None:
        pass


@query("S33 T3 T4 P5", "SELECT CASE WHEN n_nationkey % 11 = 10 THEN 'skipped' WHEN n_nationkey % 7 = 6 THEN 'failed' WHEN n_nationkey % 5 = 0 THEN 'invalid' ELSE 'written' END AS state, count(*) AS n, count(*) FILTER (WHERE n_nationkey % 11 <> 10 AND n_nationkey % 7 <> 6 AND n_nationkey % 5 <> 0) AS there FROM nation GROUP BY 1")
def http_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a server on the driver: some missing, some broken; a second run finds what the first has written."""
    host = spark.conf.get("spark.driver.host")
    server = ThreadingHTTPServer((host, 0), _Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    folder = posix(scratch(spark, "downloads"))
    key = F.col("n_nationkey")
    url = F.concat(F.lit(f"http://{host}:{server.server_port}/"), key.cast("string"), F.lit(".png"))
    rows = load(spark, sf_dir, "nation").select(key.alias("position"), F.when(key % 11 == 10, " ").otherwise(F.concat(F.lit("p"), key)).alias("id"), url.alias("url"))
    try:
        run = lambda: D.downloaded(rows, folder, D.HttpFetcher(), lambda data: I.read_png(data) is not None, suffix=".png").groupBy("state").agg(F.count("*").alias("n")).collect()
        first, second = run(), {r["state"]: r["n"] for r in run()}
    finally:
        server.shutdown()
    return spark.createDataFrame([(r["state"], r["n"], second.get("there", 0) if r["state"] == "written" else 0) for r in first], "state string, n long, there long")


@query("S13 J5", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 4 = 3 THEN 'no row group' END AS problem FROM documents")
def row_group_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by file, row group and place, of Parquet files that were written here; a quarter of the pointers lead nowhere."""
    folder = posix(scratch(spark, "groups"))
    load(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.option("parquet.block.size", 1 << 16).parquet(f"file://{folder}")

    def places(batches):  # noqa: ANN001, ANN202
        import pyarrow.parquet as pq

        for pdf in batches:
            for path in pdf["path"]:
                file = pq.ParquetFile(path)
                for g in range(file.num_row_groups):
                    ids = file.read_row_group(g, columns=["doc_id"]).column(0).to_pylist()
                    yield pd.DataFrame({"id": [str(i) for i in ids], "path": path, "row_group": [10**6 if i % 4 == 3 else g for i in ids], "row_in_group": range(len(ids))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"file://{folder}").select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    pointers = files.mapInPandas(places, "id string, path string, row_group long, row_in_group long")
    return M.fetch_rows(pointers, {"lang": "string"}).select("id", "lang", "problem")


@query("S14 P8b J3", "SELECT 'p' || (o_orderkey % 500) AS image_path, least(arg_max(o_orderkey % 900 + 100, o_orderkey), arg_max(o_custkey % 900 + 100, o_orderkey)) AS short_edge FROM orders GROUP BY 1")
def shape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of JSON lines, the last line of a path wins."""
    path = scratch(spark, "shapes")
    rows = load(spark, sf_dir, "orders").coalesce(1).sortWithinPartitions("o_orderkey")
    rows.select(F.to_json(F.struct(F.concat(F.lit("p"), F.col("o_orderkey") % 500).alias("image_path"), (F.col("o_orderkey") % 900 + 100).alias("width"), (F.col("o_custkey") % 900 + 100).alias("height"))).alias("value")).write.text(path)
    return M.shape_metadata(spark, path)


@query("S16 A26", "SELECT conv_id, arg_max(text, turn) FILTER (WHERE turn % 2 = 0) AS even, arg_max(text, turn) FILTER (WHERE turn % 2 = 1) AS odd FROM conversations GROUP BY 1")
def caption_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption columns of shards; the last value that is not null wins in each."""
    path = scratch(spark, "captions")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.when(F.col("turn") % 2 == i, F.col("text")).alias(n) for i, n in enumerate(("even", "odd"))])
    rows.write.parquet(path)
    return M.caption_maps(M.parquet_shards(spark, path, ("conv_id", "even", "odd")), "conv_id", ["even", "odd"], "turn")


@query("S23 S24", "SELECT CAST(o_custkey AS VARCHAR) AS \"Split\", CAST(arg_max(o_orderkey, o_orderkey) AS BIGINT) AS score FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders) GROUP BY 1")
def csv_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV rows without the first data row; the last row of a split wins."""
    path = scratch(spark, "splits")
    load(spark, sf_dir, "orders").coalesce(1).sortWithinPartitions("o_orderkey").select(F.col("o_custkey").alias("Split"), F.col("o_orderkey").alias("score")).write.option("header", "true").csv(path)
    return M.csv_last(spark, path, "Split string, score long", "Split", drop_first=True)


@query("K10 F17", "SELECT page, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS page FROM documents) GROUP BY page")
def gallery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows on pages of 200, and the first id of each page as it was written."""
    folder = posix(scratch(spark, "gallery"))
    M.gallery(load(spark, sf_dir, "documents"), folder, ["doc_id"], ["doc_id", "lang", "source"]).agg(F.sum("n")).collect()
    pages = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"page(\d+)\.html$", 1).cast("long").alias("page"), "value")
    return pages.select("page", F.regexp_count("value", F.lit("<tr><td>")).cast("long").alias("n"), F.regexp_extract("value", r"<tr><td>(\d+)</td>", 1).cast("long").alias("first"))


@query("K11 K15", "SELECT 'total' AS name, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders UNION ALL SELECT o_orderstatus, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY 1")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON lines, their summary as a text report, read back from the report."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    results = scratch(spark, "results")
    orders.select(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("tag"), F.col("o_totalprice").alias("score")).alias("r")).select("r.*").write.json(results)
    sums = spark.read.schema("id long, tag string, score double").json(results).rollup("tag").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))
    report = scratch(spark, "report")
    sums.select(F.format_string("%s: n = %d, mean = %.4f", F.coalesce("tag", F.lit("total")), "n", "mean").alias("value")).coalesce(1).write.text(report)  # a line for each tag
    part = lambda i: F.regexp_extract("value", r"^(\w+): n = (\d+), mean = ([0-9.]+)$", i)
    return spark.read.text(report).select(part(1).alias("name"), part(2).cast("long").alias("n"), part(3).cast("double").alias("mean"))


@query("M11 P22", "SELECT doc_id, round((CAST(doc_id % 90 AS DOUBLE)) * w / width + floor((512 - w) / 2), 6) AS x, round(least(1.0, 4.0 / (8.0 * h / height)), 6) AS weight FROM (SELECT *, greatest(1, least(512, CAST(round_even(width * s, 0) AS BIGINT))) AS w, greatest(1, least(768, CAST(round_even(height * s, 0) AS BIGINT))) AS h FROM (SELECT doc_id, width, height, least(512.0::DOUBLE / width, 768.0::DOUBLE / height) AS s FROM {images}))")
def regions_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region 8 high, moved into a bucket of 512 x 768, and its weight by the height that it has there."""
    from glyphmill.plans.registry import images

    x = (F.col("doc_id") % 90).cast("double")
    point = lambda y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    moved = G.to_bucket(F.array(point(2.0), point(10.0)), F.col("width"), F.col("height"), F.lit(512), F.lit(768))
    rows = images(spark, sf_dir).select("doc_id", moved.alias("p"))
    tall = F.get("p", 1)["y"] - F.get("p", 0)["y"]
    return rows.select("doc_id", F.round(F.get("p", 0)["x"], 6).alias("x"), F.round(G.region_weight(tall, 4.0), 6).alias("weight"))


@query("M17", "SELECT vec_id, round(t, 6) AS t, round((1 - t) * embedding[1] + t * embedding[64], 6) AS first FROM (SELECT *, 1 / (1 + exp(-(0.25 + 0.5 * (vec_id % 41 - 20) / 10.0::DOUBLE))) AS t FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings))")
def interpolants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of given normal draws, and vectors between each one and its reverse."""
    t = G.logit_normal((F.col("vec_id") % 41 - 20) / F.lit(10.0), 0.25, 0.5)
    rows = load(spark, sf_dir, "embeddings").select("vec_id", t.alias("time"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round("time", 6).alias("t"), F.round(F.get(G.interpolant(F.col("e"), F.reverse("e"), F.col("time")), 0), 6).alias("first"))


@query("T1 T5 T6", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def buffered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a shuffle buffer and an ordered chunked map: none is lost or repeated."""
    rows = P.buffered_shuffle(load(spark, sf_dir, "events").select("event_id", "event_type"), 256, seed=5)
    mapped = P.ordered_chunks(rows, lambda chunk: [(i, t.upper()) for i, t in chunk], "event_id long, kind string")
    return mapped.groupBy(F.lower("kind").alias("event_type")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))

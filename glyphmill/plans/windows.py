"""Queries of window-style operators and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import sampling as SA
from glyphmill.operators import windows as W
from glyphmill.operators.joins import with_position
from glyphmill.plans.registry import images, load, query


def _md5(seed: str, *keys: str) -> str:
    return "md5(concat_ws('|', '" + seed + "', " + ", ".join(keys) + "))"


@query("W1", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return load(spark, sf_dir, "documents").select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("place"))


@query("W1 W4 W16", "SELECT doc_id, p AS position, p // 100 AS block FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS p FROM documents)")
def global_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_position(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"])
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), F.expr("position div 100").alias("block"))


@query("W2 K5 D11", "SELECT doc_id, CAST(p // n AS BIGINT) AS file, CAST(p % n * size AS BIGINT) AS \"offset\" FROM (SELECT doc_id, size, greatest(1, 1000000 // size) AS n, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) - 1 AS p FROM (SELECT doc_id, (doc_id % 5 + 1) * 64 * 64 * 3 * 8 AS size FROM documents))")
def rolling_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 5 AS bucket", "(doc_id % 5 + 1) * 64 * 64 * 3 * 8 AS size")
    return W.rolling_offsets(rows, ["bucket"], "doc_id", "size", 1_000_000).select("doc_id", "file", "offset")


@query("W3a S8", """WITH RECURSIVE f AS (SELECT n_nationkey AS k, (n_nationkey * 37) % 50 + 1 AS n FROM nation), r AS (SELECT k, 0 AS part, n AS held FROM f WHERE k = 0
  UNION ALL SELECT f.k, CASE WHEN r.held + f.n <= 100 THEN r.part ELSE r.part + 1 END, CASE WHEN r.held + f.n <= 100 THEN r.held + f.n ELSE f.n END FROM r JOIN f ON f.k = r.k + 1) SELECT k AS n_nationkey, part FROM r""")
def greedy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "nation").selectExpr("n_nationkey", "(n_nationkey * 37) % 50 + 1 AS n")
    return W.greedy_groups(files, "n_nationkey", "n", 100)


@query("W3b W3c W9", """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS ch FROM events), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c)
  SELECT event_id, CAST(island AS BIGINT) AS island, (row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1) // 2 AS chunk FROM i""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.islands(load(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", 2).select("event_id", F.col("island").cast("long").alias("island"), F.col("chunk").cast("long").alias("chunk"))


@query("W5a R16", "SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS shard FROM documents")
def even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SA.even_shards(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7).select("doc_id", F.col("shard").cast("long").alias("shard"))


@query("W5b", "SELECT v.r AS part, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) JOIN (VALUES (0), (1), (2)) v(r) ON p >= round_even(v.r * n / 3, 0) AND p < round_even((v.r + 1) * n / 3, 0) GROUP BY 1")
def round_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_position(load(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    total = rows.count()
    part = F.lit(0)
    for r in (1, 2):
        part = F.when(F.col("position") >= W.cumulative_split(total, 3, r)[0], r).otherwise(part)
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("W15", "SELECT doc_id, least(p // (n // 6), 5) AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)")
def last_takes_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_position(load(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return rows.select("doc_id", W.last_takes_rest(F.col("position"), rows.count(), 6).alias("part"))


@query("W6a", f"SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_md5('5', 'doc_id')}, doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 40")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SA.round_robin(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 40, 5).select("doc_id")


@query("W6b M7", f"""SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, label ORDER BY {_md5('6', 'doc_id')}, doc_id) AS rn, label FROM (SELECT doc_id, lang, CASE WHEN width / height < 0.85 THEN 'portrait' WHEN width / height > 1.18 THEN 'landscape' ELSE 'square' END AS label FROM {{images}}))
  WHERE rn <= CASE label WHEN 'landscape' THEN 4 WHEN 'portrait' THEN 3 ELSE 3 END""")
def stratified_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.functions.geometry import aspect_label

    targets = dict(zip(("landscape", "portrait", "square"), SA.thirds(10), strict=True))
    rows = images(spark, sf_dir).select("doc_id", "lang", aspect_label(F.col("width"), F.col("height")).alias("label"))
    target = F.when(F.col("label") == "landscape", targets["landscape"]).when(F.col("label") == "portrait", targets["portrait"]).otherwise(targets["square"])
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("lang", "label").orderBy(SA.seeded_key(6, "doc_id"), "doc_id"))
    return rows.withColumn("rn", place).where(F.col("rn") <= target).select("doc_id")


@query("W6c", """WITH k AS (SELECT doc_id, list_position(['en', 'de', 'fr', 'es'], lang) - 1 AS d, doc_id % 4 AS m FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY d, m ORDER BY doc_id) AS rn, (m - 2 * d + 400) % 4 AS slot FROM k)
  SELECT doc_id FROM r ORDER BY rn, slot, d LIMIT 50""")
def stratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id", "lang AS domain", "string(doc_id % 4) AS dimension")
    return SA.rotated(rows, ["en", "de", "fr", "es"], ["0", "1", "2", "3"], "doc_id", 50).select("doc_id")


@query("W6d W19", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {_md5('8', 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 2")
def per_cell_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SA.per_cell(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 2, 8).select("doc_id")


@query("O12 W10 P14", f"SELECT doc_id FROM documents ORDER BY {_md5('9', 'doc_id')}, doc_id LIMIT 30")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SA.seeded_sample(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 30, 9)


@query("W19 U1", f"SELECT DISTINCT doc_id FROM (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {_md5('12', 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn = 1 UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY {_md5('13', 'doc_id')}, doc_id LIMIT 25))")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "source")
    return SA.per_cell(rows, ["source"], "doc_id", 1, 12).select("doc_id").union(SA.seeded_sample(rows.select("doc_id"), "doc_id", 25, 13)).distinct()


@query("W7 R12", "SELECT bucket, CAST(count(slot) AS BIGINT) AS quota FROM (SELECT n_nationkey AS bucket FROM nation) LEFT JOIN (SELECT b, slot FROM (SELECT n_nationkey AS b, unnest(range(1, (n_nationkey * 7) % 20 + 1)) AS slot FROM nation) ORDER BY slot, b LIMIT 100) ON b = bucket GROUP BY 1")
def water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SA.water_fill(load(spark, sf_dir, "nation").selectExpr("n_nationkey AS bucket", "(n_nationkey * 7) % 20 AS capacity"), 100)


@query("W8 D17 T8", f"""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_md5('3000011', 'doc_id')}, doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
  s AS (SELECT source, doc_id, unnest(range(p, greatest((n + 7) // 8 * 8, p + 1), n)) AS spot FROM p), b AS (SELECT DISTINCT source, spot // 8 AS b FROM s),
  t AS (SELECT source, b, row_number() OVER (ORDER BY {_md5('3000011', 'source', 'b')}, source, b) - 1 AS step FROM b)
  SELECT step, spot % 8 AS position, doc_id FROM s JOIN t ON s.source = t.source AND s.spot // 8 = t.b""")
def batch_plan_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = SA.batch_plan(load(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 8, seed=3, epoch=2)
    return plan.select(F.col("step").cast("long").alias("step"), F.col("position").cast("long").alias("position"), "doc_id")


@query("W8 T8")
def batch_plan_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 9 AS bucket")
    return SA.batch_plan_numpy(rows, "bucket", "doc_id", "doc_id", 8, seed=3, epoch=2)


@query("W13 X8 W18", "SELECT item_id, r AS repeat, ntile FROM (SELECT item_id, ntile(3) OVER (ORDER BY item_id) - 1 AS ntile FROM benchmark), range(0, 4) t(r)")
def repeat4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SA.even_shards(load(spark, sf_dir, "benchmark").select("item_id"), "item_id", 3)
    return W.repeated(rows, 4).select("item_id", F.col("repeat").cast("long").alias("repeat"), F.col("shard").cast("long").alias("ntile"))


@query("W14", "SELECT n_nationkey FROM nation UNION ALL (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT (SELECT CAST((8 - count(*) % 8) % 8 AS BIGINT) FROM nation))")
def pad_to_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.pad_to_multiple(load(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 8)


@query("W17", "WITH g AS (SELECT source, min(doc_id) AS first, row_number() OVER (ORDER BY source) - 1 AS p, count(*) OVER () AS n FROM documents GROUP BY source) SELECT source, first FROM g WHERE p IN (SELECT CAST(floor(i * (n - 1) / 4) AS BIGINT) FROM range(0, 5) t(i))")
def spaced_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = with_position(load(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first")), "source")
    return groups.where(F.col("position").isin(W.spaced(groups.count(), 5))).select("source", "first")


@query("native", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))


@query("native", "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")

"""Queries that join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import audits
from glyphmill.operators import joins as J
from glyphmill.operators import sets as U
from glyphmill.plans.registry import images, load, query


@query("J1 D7", "SELECT d.doc_id, l.quality || ',' || l.toxic AS captions FROM documents d JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE quality END AS quality, toxic FROM labels) l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def caption_join_all_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = load(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE quality END AS quality", "toxic")
    rows = J.with_all_captions(load(spark, sf_dir, "documents").select("doc_id"), captions, "doc_id", ["quality", "toxic"])
    return rows.select("doc_id", F.array_join(F.col("captions").cast("array<string>"), ",").alias("captions"))


@query("J1 A1", "SELECT count(*) AS images, count(l.doc_id) AS captioned, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def caption_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    return rows.agg(F.count("*").alias("images"), F.count("there").alias("captioned"), (F.count("*") - F.count("there")).alias("missing"))


@query("J2", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.not_done(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id")


@query("J3 P8b A26", "WITH m AS (SELECT user_id AS doc_id, arg_max(value, event_id) AS short_edge FROM events GROUP BY 1) SELECT d.doc_id, round(m.short_edge, 6) AS short_edge FROM documents d JOIN m USING (doc_id) WHERE m.short_edge >= 10")
def shape_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("value").alias("short_edge"), "event_id")
    rows = J.with_metadata(load(spark, sf_dir, "documents").select("doc_id"), metadata, "doc_id", "short_edge", "event_id")
    return rows.where("short_edge >= 10").select("doc_id", F.round("short_edge", 6).alias("short_edge"))


@query("J4 P10 D13", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_orderkey % 100) / 100.0 > 0.5")
def strict_scan_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "(o_orderkey % 100) / 100.0 AS transparent")
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return J.strict_lookup(rows, scan, "l_orderkey").where("NOT transparent > 0.5").select("l_orderkey", "l_linenumber")


@query("J5", """SELECT p.doc_id, CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN p.source <> t.source THEN 'source' WHEN p.n_chars <> t.n_chars THEN 'n_chars' END AS reason
  FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE source END AS source, n_chars + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents) p
  LEFT JOIN (SELECT * FROM documents WHERE doc_id % 23 <> 0) t ON p.doc_id = t.doc_id WHERE t.doc_id IS NULL OR p.source <> t.source OR p.n_chars <> t.n_chars""")
def pointer_join_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    pointers = rows.selectExpr("doc_id", "CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE source END AS source", "n_chars + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS n_chars")
    return J.stale_pointers(pointers, rows.where("doc_id % 23 <> 0"), ["doc_id"], ["source", "n_chars"]).select("doc_id", "reason")


@query("J6", "SELECT d.doc_id, CASE WHEN l.doc_id % 3 = 0 THEN -1 ELSE coalesce(l.quality, -1) END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def region_join_nulling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    quality = F.when(F.col("doc_id") % 3 != 0, F.col("quality"))  # sizes differ: the region side counts as absent
    return rows.select("doc_id", F.coalesce(quality, F.lit(-1)).alias("quality"))


@query("J7a J7b J7c J16 S34", "SELECT i.conv_id, i.turn, b.item_id FROM conversations i JOIN benchmark b ON b.item_id = i.conv_id")
def prompt_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.format_string("%d_%d.png", "conv_id", "turn")
    files = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract(name, r"^(\d+)[_.]", 1).cast("long").alias("item_id"))
    return files.join(J.small(load(spark, sf_dir, "benchmark").select("item_id")), "item_id").select("conv_id", "turn", "item_id")


@query("J8 J17 W1", "SELECT a.doc_id, b.page_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS p FROM documents) a JOIN (SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS p FROM pages) b USING (p)")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = J.with_position(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"])
    b = J.with_position(load(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"])
    return a.join(b, "position").select("doc_id", "page_id")


@query("J9 D25", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.v IS NULL OR b.v IS NULL THEN '' ELSE printf('%.4f', b.v - a.v) END AS delta FROM (SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) / 7 AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) / 3 AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.k = b.k")
def full_outer_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    side = lambda status, n: orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg((F.count("*").cast("double") / n).alias("v"))
    return J.delta(side("O", 7), side("F", 3), ["k"], "v")


@query("J10a J10c U6", "SELECT coalesce(e.doc_id, f.doc_id) AS doc_id, CASE WHEN e.doc_id IS NULL THEN 'unexpected' WHEN f.doc_id IS NULL THEN 'missing' ELSE 'duplicate' END AS state FROM (SELECT doc_id FROM documents) e FULL JOIN (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id + 5 AS doc_id, 1 AS n FROM labels UNION ALL SELECT doc_id + 5, 1 FROM labels WHERE doc_id % 10 = 0) GROUP BY 1) f ON e.doc_id = f.doc_id WHERE e.doc_id IS NULL OR f.doc_id IS NULL OR f.n > 1")
def reconcile_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").select((F.col("doc_id") + 5).alias("doc_id"))
    return audits.reconcile(load(spark, sf_dir, "documents"), labels.union(labels.where("(doc_id - 5) % 10 = 0")), "doc_id")


_HASHED_SQL = "SELECT doc_id AS ord, doc_id AS id, CAST(doc_id % 50 AS UBIGINT) * 72340172838076673 & 9223372036854775807 AS base, CAST(1 AS UBIGINT) << CAST(doc_id % 60 AS INT) AS bit, width / height AS aspect, doc_id % 7 AS pixels FROM {images}"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).selectExpr("doc_id AS ord", "doc_id AS id", "((doc_id % 50) * 72340172838076673) ^ shiftleft(1L, cast(doc_id % 60 as int)) AS hash", "width / height AS aspect", "doc_id % 7 AS pixels")


@query("J11 M14", f"""WITH h AS (SELECT ord, id, CAST(xor(base, bit) AS BIGINT) AS hash, aspect, pixels FROM ({_HASHED_SQL})), b AS (SELECT *, (hash >> CAST(16 * band AS BIGINT)) & 65535 AS value FROM h, (VALUES (0), (1), (2), (3)) v(band)),
  r AS (SELECT *, row_number() OVER (PARTITION BY band, value ORDER BY ord) - 1 AS before FROM b)
  SELECT DISTINCT x.id AS first, y.id AS second, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance FROM r x JOIN r y ON x.band = y.band AND x.value = y.value AND x.ord < y.ord
  WHERE y.before <= 256 AND x.pixels <> y.pixels AND bit_count(xor(x.hash, y.hash)) <= 3 AND abs(ln(y.aspect / x.aspect)) <= 0.05""")
def near_dup_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.banded_pairs(_hashed(spark, sf_dir))


@query("J11 M14", f"""WITH h AS (SELECT ord, id, CAST(xor(base, bit) AS BIGINT) AS hash, aspect, pixels FROM ({_HASHED_SQL}))
  SELECT x.id AS first, y.id AS second, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance FROM h x JOIN h y ON x.ord < y.ord
  WHERE x.pixels <> y.pixels AND bit_count(xor(x.hash, y.hash)) <= 3 AND abs(ln(y.aspect / x.aspect)) <= 0.05""")
def near_dup_bands_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_dup_bands with no lookup skipped."""
    return J.banded_pairs(_hashed(spark, sf_dir), dense=None)


@query("J11", f"""WITH h AS (SELECT CAST(xor(base, bit) AS BIGINT) AS hash FROM ({_HASHED_SQL})), b AS (SELECT count(*) AS n FROM h, (VALUES (0), (1), (2), (3)) v(band) GROUP BY band, (hash >> CAST(16 * band AS BIGINT)) & 65535)
  SELECT CAST(sum(n) AS BIGINT) AS lookups, CAST(sum(greatest(n - 257, 0)) AS BIGINT) AS skipped FROM b""")
def near_dup_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookups that near_dup_bands skips."""
    return J.skipped_lookups(_hashed(spark, sf_dir))


@query("J13", "WITH a AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS word FROM (SELECT item_id, string_split(regexp_replace(text, '[^ -~]', 'x', 'g'), ' ') AS w FROM benchmark)), b AS (SELECT item_id - 1 AS item_id, unnest(string_split(regexp_replace(text, '[^ -~]', 'x', 'g'), ' ')) AS v FROM benchmark) SELECT item_id, place, word, min(levenshtein(word, v)) AS distance FROM a JOIN b USING (item_id) GROUP BY 1, 2, 3")
def nearest_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a text against each word of the next one."""
    rows = load(spark, sf_dir, "benchmark").select("item_id", F.split(F.regexp_replace("text", "[^ -~]", "x"), " ").alias("words"))
    found = J.nearest_words(rows, rows.withColumn("item_id", F.col("item_id") - 1), "item_id")
    return found.where("distance IS NOT NULL").select("item_id", F.col("place").cast("long").alias("place"), "word", F.col("distance").cast("long").alias("distance"))


@query("J15 D21", """WITH RECURSIVE q AS (SELECT conv_id AS item, turn + 1 AS qid, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END AS parent, CASE WHEN length(text) % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM conversations),
  r AS (SELECT item, qid, score FROM q WHERE parent = 0 UNION ALL SELECT q.item, q.qid, CASE WHEN r.score = 0 THEN 0.0 ELSE q.score END::DOUBLE FROM q JOIN r ON q.item = r.item AND q.parent = r.qid) SELECT * FROM r""")
def dependency_zeroing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = load(spark, sf_dir, "conversations").selectExpr("conv_id AS item", "turn + 1 AS qid", "CASE WHEN turn % 3 = 0 THEN 0L ELSE turn END AS parent", "CASE WHEN length(text) % 3 = 0 THEN 0D ELSE 1D END AS score")
    return J.zeroed_by_parents(q)


@query("U1 S3 S1", "SELECT 'doc:' || doc_id AS global_id FROM documents UNION ALL SELECT 'page:' || page_id FROM pages")
def union_global_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.union_with_ids({"doc": load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "page": load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))}, "id").select("global_id")


@query("U2 S15", "SELECT doc_id FROM labels UNION SELECT conv_id FROM conversations")
def union_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").select("doc_id").union(load(spark, sf_dir, "conversations").select("conv_id")).distinct()


@query("U3 U8", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id").subtract(load(spark, sf_dir, "labels").select("doc_id"))


@query("U4 A10 D23", """WITH w AS (SELECT item_id, unnest(string_split(lower(trim(regexp_replace(regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9\\sàâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ]', '', 'g'), '\\s+', ' ', 'g'))), ' ')) AS t FROM benchmark), c AS (SELECT item_id, t, count(*) AS n FROM w GROUP BY 1, 2)
  SELECT a.item_id, CAST(sum(a.n) AS BIGINT) AS total, CAST(sum(least(a.n, coalesce(b.n, 0))) AS BIGINT) AS matched FROM c a LEFT JOIN (SELECT item_id - 1 AS item_id, t, n FROM c) b ON a.item_id = b.item_id AND a.t = b.t GROUP BY 1""")
def multiset_text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.functions.strings import normalized

    words = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(normalized(F.col("text")), " ")).alias("token"))
    return U.multiset_overlap(words, words.withColumn("item_id", F.col("item_id") - 1), "item_id")


@query("U5 A7", "SELECT source, min(doc_id) AS first FROM documents GROUP BY source")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))


@query("U7 A23 T2 D18", """WITH d AS (SELECT item_id AS draw, CAST('0x' || substr(sha256('11|' || item_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM benchmark)
  SELECT CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS source, count(*) AS n FROM d GROUP BY 1""")
def weighted_mix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("draw"))
    return U.weighted_draws(draws, {"a": 5, "b": 3, "c": 2}, seed=11).groupBy("source").agg(F.count("*").alias("n"))


@query("A6 T9", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.duplicates(load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")


@query("P6 P17", "SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS shard, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) <= 25 AS taken FROM documents")
def modulo_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row, and whether the shard's limit takes it: the first rows of each shard are found apart."""
    rows = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).cast("int").alias("shard"))
    first = None
    for shard in range(4):
        part = rows.where(F.col("shard") == shard).orderBy("doc_id").limit(25).select("doc_id", F.lit(True).alias("there"))
        first = part if first is None else first.union(part)
    return rows.join(F.broadcast(first), "doc_id", "left").select("doc_id", "shard", F.col("there").isNotNull().alias("taken"))  # 100 rows


@query("P7", "SELECT doc_id FROM documents WHERE doc_id >= 100 AND doc_id < 180")
def index_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where("doc_id >= 100 AND doc_id < 180").select("doc_id")


@query("P14 P15", "SELECT event_id FROM events WHERE CAST('0x' || substr(md5(event_id || 'salt'), 1, 8) AS BIGINT) % 2147483647 < CAST(floor(0.25 * 2147483647) AS BIGINT)")
def hash_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where(U.hash_fraction(F.col("event_id"), 0.25, "salt")).select("event_id")


@query("P19 P20", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice >= 0 AND o_totalprice <= 200000 AND o_orderpriority IS NOT NULL AND o_orderstatus IN ('O', 'F'))")
def invalid_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders")
    valid = F.col("o_totalprice").between(0, 200000) & ~F.isnan("o_totalprice") & F.col("o_orderpriority").isNotNull() & F.col("o_orderstatus").isin("O", "F")
    return rows.where(~valid).select("o_orderkey")


@query("P23 O7 J14b", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events WHERE value > CASE WHEN event_type = 'click' THEN 9 ELSE 3 END) WHERE rn <= 16")
def detections_top16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.operators.sampling import top_per_group

    limit = F.when(F.col("event_type") == "click", 9).otherwise(3)
    rows = load(spark, sf_dir, "events").where(F.col("value") > limit)
    return top_per_group(rows, ["user_id", "event_type"], [F.desc("value"), F.col("event_id")], 16).select("user_id", "event_type", "event_id")

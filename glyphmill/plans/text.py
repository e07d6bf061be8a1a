"""Queries over captions, prompts and other text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import strings as S
from glyphmill.functions import tokens as T
from glyphmill.operators import statistics as ST
from glyphmill.plans.registry import images, load, query

# Words between blanks plus one, as a plain token counter does.
TOKENS_SQL = "(len(list_filter(string_split_regex(coalesce(caption, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) + 1)"


@query("F1", r"""SELECT page_id, substr(n, 1, 3) || '/' || substr(n, 4, 3) || '/' || n || '.jpg' AS path FROM (
  SELECT page_id, array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN substr(h, i * 2 + 1, 1) = '0' THEN substr(h, i * 2 + 2, 1) ELSE substr(h, i * 2 + 1, 2) END), '') AS n FROM (SELECT page_id, md5(url) AS h FROM pages))""")
def md5_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", S.hash_path(F.col("url")).alias("path"))


@query("F2 S22", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE width END AS w, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE height END AS h FROM {images}")
def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, "0x12").otherwise(F.concat("width", F.lit("X"), "height"))
    rows = images(spark, sf_dir).select("doc_id", S.parse_size(text).alias("s"))
    return rows.select("doc_id", *[F.coalesce(F.col(f"s.{c}").cast("long"), F.lit(-1)).alias(c[0]) for c in ("width", "height")])


@query("F4 P1a P21", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'f' || doc_id || '.png' ELSE lang || '_' || source || '_' || doc_id || '.png' END AS name FROM documents")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents")
    key = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a/b/f"), "doc_id", F.lit(".png"))).otherwise(F.lit(" "))
    return rows.select("doc_id", S.first_name(F.lit(None).cast("string"), key, fallback=F.format_string("%s_%s_%s.png", "lang", "source", "doc_id")).alias("name"))


@query("F5", "SELECT doc_id, array_to_string(list_filter(flatten(list_transform(regexp_extract_all('say ''' || replace(text, chr(10), '''' || chr(10) || '''') || ''' and ''Two  Words''', '''([^\\n]*?)''', 1), lambda q: string_split_regex(lower(q), '\\s+'))), lambda w: w <> ''), '|') AS words FROM documents")
def quoted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a text is quoted, for quotes end with the line."""
    prompt = F.concat(F.lit("say '"), F.replace("text", F.lit("\n"), F.lit("'\n'")), F.lit("' and 'Two  Words'"))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(S.quoted_words(prompt), "|").alias("words"))


@query("F6", "SELECT item_id, lower(trim(regexp_replace(regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9\\sàâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ]', '', 'g'), '\\s+', ' ', 'g'))) AS en, regexp_replace(regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9\\sàâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ]', '', 'g'), '\\s+', '', 'g') AS zh FROM benchmark")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", S.normalized(F.col("text")).alias("en"), S.normalized(F.col("text"), "zh").alias("zh"))


@query("F7", "SELECT conv_id, turn, replace(text, 'the', '') AS cleaned FROM conversations")
def clean_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace("text", F.lit("the"), F.lit("")).alias("cleaned"))


@query("F8 C5", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("```json\n"), F.replace("props", F.lit("}"), F.lit(", }")), F.lit("\n```"))
    return load(spark, sf_dir, "events").select("event_id", F.from_json(S.fenced_json(raw), "k long")["k"].alias("k"))


@query("F9", "SELECT page_id, CASE WHEN trim(right(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), 100), '._') = '' THEN 'sample' ELSE trim(right(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), 100), '._') END AS slug FROM pages")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


@query("F10 F11", "SELECT p_partkey, p_type AS l2, string_split(p_type, ' ')[1] AS l1, p_partkey % 7 + p_size AS total FROM part")
def category_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").selectExpr("p_partkey", "p_type || ' (entity)' AS category", "(p_partkey % 7) || ', ' || p_size AS ids")
    l2 = S.category(F.col("category"))
    return rows.select("p_partkey", l2.alias("l2"), F.substring_index(l2, " ", 1).alias("l1"), F.aggregate(S.ints(F.col("ids")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("F12", "WITH w AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS w FROM (SELECT item_id, string_split(regexp_replace(text, '[^ -~]', 'x', 'g'), ' ') AS w FROM benchmark)) SELECT a.item_id, CAST(a.place AS BIGINT) AS place, round(1 - levenshtein(a.w, b.w) / (greatest(length(a.w), length(b.w)) + 1e-5), 9) AS similarity FROM w a JOIN w b ON a.item_id = b.item_id + 1 AND a.place = b.place")
def word_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a text against the word in the same place of the text before."""
    rows = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.regexp_replace("text", "[^ -~]", "x"), " ")).alias("place", "w"))
    other = rows.select((F.col("item_id") + 1).alias("item_id"), "place", F.col("w").alias("v"))
    return rows.join(other, ["item_id", "place"]).select("item_id", F.col("place").cast("long").alias("place"), F.round(S.word_similarity(F.col("w"), F.col("v")), 9).alias("similarity"))


@query("P13 F14", "SELECT doc_id, list_contains(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')[1:10], 'the') AS found FROM documents")
def prefix_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce(S.prefix_has_word(F.col("text"), "the"), F.lit(False)).alias("found"))


@query("F15 W11", "SELECT doc_id, printf('%05d/samples/%05d.png', doc_id // 4, doc_id % 4) AS path, doc_id // 100 AS category, doc_id % 100 AS place FROM documents")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return load(spark, sf_dir, "documents").select("doc_id", F.format_string("%05d/samples/%05d.png", F.expr("doc_id div 4"), i % 4).alias("path"), F.expr("doc_id div 100").alias("category"), (i % 100).alias("place"))


@query("F16 F17", "SELECT doc_id, replace(replace(replace(replace(replace(replace(text, chr(10), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents")
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", S.html_escape(S.single_line(F.col("text"))).alias("html"))


@query("F19 F20", "SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.0fs', s) WHEN s < 3600 THEN printf('%dm%.0fs', CAST(floor(s / 60) AS BIGINT), s - floor(s / 60) * 60) ELSE printf('%dh%dm', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s / 60) AS BIGINT) % 60) END AS took, o_orderkey % 2 = 0 AS flag FROM (SELECT o_orderkey, CAST(o_orderkey % 5000 + 0.25 AS DOUBLE) AS s FROM orders)")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("o_orderkey") % 2 == 0, " Yes").otherwise("F")
    seconds = (F.col("o_orderkey") % 5000 + 0.25).cast("double")
    return load(spark, sf_dir, "orders").select("o_orderkey", S.duration(seconds).alias("took"), S.truth(flag).alias("flag"))


@query("F22 P4", "SELECT conv_id, turn, '<' || role || '>' || chr(10) || 'Text (' || len(string_split(text, chr(10))) || '): ' || '\"' || array_to_string(string_split(text, chr(10)), '\", \"') || '\"' AS prompt FROM conversations")
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    quoted = F.array_join(F.transform(lines, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<"), "role", F.lit(">\nText ("), F.size(lines), F.lit("): "), quoted).alias("prompt"))


@query("P3a P3b", "SELECT doc_id, 'a.' || doc_id AS last_dot, 'a' AS first_dot, CAST(doc_id AS BIGINT) AS number FROM documents")
def path_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/x/a."), "doc_id", F.lit(".jpg"))
    return load(spark, sf_dir, "documents").select("doc_id", S.stem(path).alias("last_dot"), S.stem(path, True).alias("first_dot"), F.regexp_extract(path, r"\.(\d+)\.jpg$", 1).cast("long").alias("number"))


@query("M20 A15", "SELECT doc_id, sha256('7|' || source || '|' || doc_id) AS digest, sha256(text) AS content FROM documents")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.lit("7"), "source", F.col("doc_id").cast("string")), 256).alias("digest"), F.sha2("text", 256).alias("content"))


@query("C1 C2", "SELECT conv_id, coalesce(arg_min(text, turn), '') AS first FROM conversations GROUP BY conv_id")
def caption_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("texts"))
    return rows.select("conv_id", F.coalesce(F.get("texts", 0), F.lit("")).alias("first"))


@query("C3 C4", "SELECT event_id, 'w' || CAST(json_extract(props, '$.k') AS BIGINT) AS text, CASE WHEN event_id % 2 = 0 THEN 0.5 END::DOUBLE AS score FROM events")
def ocr_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two encodings of OCR lines in one shape: a list of structs, or parallel lists of which one may be short."""
    k = F.get_json_object("props", "$.k")
    even = F.concat(F.lit('[{"text":"w'), k, F.lit('","score":0.5}]'))
    odd = F.concat(F.lit('{"res":{"rec_texts":["w'), k, F.lit('"],"rec_scores":[]}}'))
    rows = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, even).otherwise(odd).alias("raw"))
    return rows.select("event_id", F.inline(T.ocr_items(F.col("raw"))))


@query("M18 P24", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(least(greatest(x, -1), 1) AS DOUBLE) * 0.5 + 0.5)), 3) AS total FROM embeddings")
def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)).cast("double") * 0.5 + 0.5)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query("C6", "SELECT format, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'jpeg' WHEN doc_id % 3 = 1 THEN 'png' ELSE 'other' END AS format FROM documents) GROUP BY 1")
def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFD8FFE0"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("0102")))
    return load(spark, sf_dir, "documents").groupBy(T.sniffed(data).alias("format")).agg(F.count("*").alias("n"))


@query("P9", f"SELECT doc_id, {TOKENS_SQL} AS tokens FROM {{images}} WHERE {TOKENS_SQL} <= 400")
def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("doc_id", T.word_tokens(F.col("caption")).cast("long").alias("tokens")).where("tokens <= 400")


@query("P9 A1 A25 K7", f"SELECT count(*) AS input, count(CASE WHEN t <= 400 THEN 1 END) AS kept, count(CASE WHEN t > 400 THEN 1 END) AS dropped, min(t) AS least, max(t) AS most FROM (SELECT {TOKENS_SQL} AS t FROM {{images}})")
def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.budget_report(images(spark, sf_dir).select(T.word_tokens(F.col("caption")).cast("long").alias("tokens")), "tokens", 400)


@query("A4", f"SELECT t // 128 * 128 AS bin, count(*) AS n FROM (SELECT {TOKENS_SQL} AS t FROM {{images}}) GROUP BY 1")
def token_histogram_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.histogram(images(spark, sf_dir).select(T.word_tokens(F.col("caption")).cast("long").alias("t")), "t", 128)


@query("A3a", "SELECT q, x FROM (SELECT n_chars AS x, row_number() OVER (ORDER BY n_chars) - 1 AS r, count(*) OVER () AS n FROM documents) JOIN (VALUES (50.0), (90.0), (95.0), (99.0), (99.9)) v(q) ON r = least(n - 1, CAST(floor(CAST(q AS DOUBLE) / 100 * n) AS BIGINT))".replace("SELECT q, x", "SELECT CAST(q AS DOUBLE) AS q, x"))
def pct_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.percentiles_by_rank(load(spark, sf_dir, "documents").select(F.col("n_chars").alias("x")), "x", (50.0, 90.0, 95.0, 99.0, 99.9))


@query("A3b A3d", "SELECT count(n_chars) AS n, min(n_chars) AS least, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS most FROM documents")
def seven_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.seven_numbers(load(spark, sf_dir, "documents"), "n_chars")


@query("A3c W12", "WITH h AS (SELECT n_chars AS x, count(*) AS c FROM documents GROUP BY 1), r AS (SELECT x, sum(c) OVER (ORDER BY x) AS cum, sum(c) OVER () AS n FROM h) SELECT CAST(q AS DOUBLE) AS q, min(x) AS x FROM r JOIN (VALUES (50), (95), (99)) v(q) ON cum > q / 100 * (n - 1) GROUP BY 1")
def pct_floor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.percentiles_by_histogram(load(spark, sf_dir, "documents").select(F.col("n_chars").alias("x")), "x", (50.0, 95.0, 99.0))


@query("O2 O3 O6", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 20")
def longest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(20).select("doc_id", "n_chars")


@query("P18", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 1000 ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where("n_chars > 1000").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


@query("A30", f"SELECT doc_id // 16 AS batch, CASE WHEN max({TOKENS_SQL}) <= 512 THEN 512 ELSE 4096 END AS context FROM {{images}} GROUP BY 1")
def context_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select(F.expr("doc_id div 16").alias("batch"), T.word_tokens(F.col("caption")).alias("t"))
    return rows.groupBy("batch").agg(F.when(F.max("t") <= 512, 512).otherwise(4096).alias("context"))


@query("P5 P31 P2", "SELECT count(*) AS n FROM documents WHERE trim(coalesce(text, '')) <> ''")
def not_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where(F.trim(F.coalesce("text", F.lit(""))) != "").agg(F.count("*").alias("n"))


@query("C9", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' ELSE '{\"id\":' || doc_id || '}' END AS json FROM documents")
def null_stripped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    return load(spark, sf_dir, "documents").select("doc_id", F.to_json(row).alias("json"))

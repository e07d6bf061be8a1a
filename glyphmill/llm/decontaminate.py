"""Benchmark decontamination with built-in expressions only.

Each benchmark item gives its windows of 13 consecutive words (an item of fewer, but not none, is one
window). The distinct windows are a table of hash, words and items; while its bytes are within
BROADCAST_BYTES it is broadcast as a hash set, and beyond that Spark joins it by shuffle, on the hash.
A document's window hashes are combined from hashes of 1, 2, 4 and 8 words by position, one array
operation each. The scan probes the hash set with each of them in one generated loop: what does not hit
is never made a row. Positions that hit are verified by the words themselves. Documents travel through
the one shuffle as (row, id, counts, hits), never as text.

Null text has no words. An item without words has no windows. Repeated rows give repeated results.
A null item id counts no item, but its windows hit. An empty benchmark contaminates nothing, an empty
table gives an empty one. Texts of any length are scanned whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import fresh, written

WINDOW = 13
#: Bytes of the window table (words, ids and hashes) up to which it is broadcast.
BROADCAST_BYTES = 128 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; only A-Z are lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _GAP), lambda w: w != "")


def _shifted(name: str, by: int) -> Column:
    return F.slice(F.col(name), by + 1, F.size(name)) if by else F.col(name)


def with_window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (words) with an array column w<k> of the hashes of all windows of k words, for each k.

    Arrays of 1, 2, 4, 8 words come first, each in a projection of its own, so that none is computed twice.
    """
    top = max(lengths)
    df = df.withColumn("__h1", F.transform("words", lambda w: F.xxhash64(w)))
    size = 1
    while size * 2 <= top:
        df = df.withColumn(f"__h{size * 2}", F.zip_with(_shifted(f"__h{size}", 0), _shifted(f"__h{size}", size), lambda a, b: F.xxhash64(a, b)))
        size *= 2
    for k in lengths:
        acc, at = None, 0
        for part in (8, 4, 2, 1):
            if k & part:
                piece = _shifted(f"__h{part}", at)
                acc = piece if acc is None else F.zip_with(acc, piece, lambda a, b: F.xxhash64(a, b))
                at += part
        df = df.withColumn(f"w{k}", F.slice(acc, F.lit(1), F.greatest(F.size("words") - (k - 1), F.lit(0))))
    return df.drop(*[c for c in df.columns if c.startswith("__h")])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """gram, k, items: the distinct windows with the ids (as strings) of the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    n = F.size("words")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.array_join(F.slice("words", i, F.lit(WINDOW)), " ")))
    grams = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.coalesce(grams, F.array(F.array_join("words", " "))))
    rows = items.select("item", F.least(n, F.lit(WINDOW)).alias("k"), F.explode(grams).alias("gram"))
    return rows.groupBy("gram", "k").agg(F.collect_set("item").alias("items"))


def window_table(benchmark: DataFrame) -> tuple[DataFrame, list[int], bool]:
    """h, k, gram, items of the distinct windows as a written table; the window lengths; whether the table may be broadcast."""
    windows = written(benchmark_windows(benchmark).select("gram", "k", "items", F.split("gram", " ").alias("words")), "windows")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # 13 at most
    found = None
    for k in lengths:
        own = with_window_hashes(windows.where(F.col("k") == k), [k]).select(F.col(f"w{k}")[0].alias("h"), "k", "gram", "items")
        found = own if found is None else found.union(own)
    if found is None:
        return windows.select(F.lit(0).cast("long").alias("h"), "k", "gram", "items"), [], True
    bytes_of = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + 64
    total = found.agg(F.sum(bytes_of.cast("long")).alias("n")).first()["n"]
    return found, lengths, total <= BROADCAST_BYTES


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted) and spans (array of first word, words) of every row of docs."""
    table, lengths, fits = window_table(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), "words")
    if not lengths:
        none = F.expr("cast(array() as array<struct<at: int, k: int>>)")
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("items"), none.alias("spans"))
    rows = with_window_hashes(rows, lengths)
    # One array of all hashes, by length; a leading null stands for the document itself, hit or not.
    probes = F.concat(F.array(F.lit(None).cast("long")), *[F.col(f"w{k}") for k in lengths])
    probed = rows.select("doc_id", "row", "n_words", "words", F.posexplode(probes).alias("place", "h"))
    many = lambda k: F.greatest(F.col("n_words") - (k - 1), F.lit(0)).cast("int")
    before, first = F.lit(1), F.lit(0)
    for k in lengths:
        first = F.when(F.col("k") == k, before).otherwise(first)
        before = before + many(k)
    if fits:
        found = probed.join(F.broadcast(table), "h", "left").where("k IS NOT NULL OR place = 0")
    else:  # the documents' own rows keep out of the join: their null hash would go to one task
        own = rows.select("doc_id", "row", "n_words", F.slice("words", 1, 0).alias("words"), F.lit(0).alias("place"))
        hits = probed.where("h IS NOT NULL").join(table, "h").select("doc_id", "row", "n_words", "words", "place", "k", "gram", "items")
        found = hits.unionByName(own, allowMissingColumns=True)
    at = F.col("place") - first
    same = (at >= 0) & (at < many(F.col("k"))) & (F.array_join(F.slice("words", at + 1, F.greatest("k", F.lit(0))), " ") == F.col("gram"))
    hit = F.col("k").isNotNull() & same
    found = found.select("doc_id", "row", "n_words", F.when(hit, F.struct(at.cast("int").alias("at"), F.col("k").cast("int").alias("k"))).alias("span"), F.when(hit, F.col("items")).alias("items"))
    by_doc = found.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_list("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # Words under at least one span: spans come by first word, each adds what is beyond the last end.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["at"] + s["k"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["at"] + s["k"] - F.greatest(acc["end"], s["at"]))).cast("long").alias("n"))
    return by_doc.select("doc_id", "n_words", F.aggregate("spans", zero, step, lambda acc: acc["n"]).alias("n_hit"), "items", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """scan() with the decision: at least one word in `share` is hit."""
    return scan(docs, benchmark).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the words of their hit spans (and what follows each up to the next word); doc_id must be unique."""
    word, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    name = fresh(docs, "__spans")
    hit = found.where("n_hit > 0").select("doc_id", F.col("spans").alias(name))
    joined = docs.join(hit, "doc_id", "left")
    pieces = F.regexp_extract_all("text", F.lit(word + gap), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(name, lambda s: (i >= s["at"]) & (i < s["at"] + s["k"])))
    clean = F.concat(F.regexp_extract("text", "^" + gap, 0), F.array_join(kept, ""))
    return joined.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)


OP1_SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS gram
  FROM (SELECT item, ws, least(13, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), dw AS (
  SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)
), h AS (
  SELECT rid, i, dw.k AS k, item FROM dw JOIN bw ON dw.gram = bw.gram AND dw.k = bw.k
), c AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM h)) GROUP BY rid
), m AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""

"""Joins: strict and lenient look-ups, anti-joins, positions, differences, banded near pairs, dependency chains."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from glyphmill.functions.geometry import hamming
from glyphmill.operators.audits import require_unique
from glyphmill.sources.scratch import scratch

#: Rows and bytes (as JSON text) of a look-up side that is broadcast; a larger one is joined as Spark sees fit.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and `size` bytes; this reads at most one row more."""
    first = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if first["n"] <= rows and first["bytes"] <= size else df


def with_all_captions(rows: DataFrame, captions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows that have every caption column, as an array in the order of the columns."""
    joined = rows.join(captions.select(key, *columns), key)
    return joined.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).withColumn("captions", F.array(*columns)).drop(*columns)


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """rows with the last metadata value of each key, or null."""
    last = metadata.groupBy(key).agg(F.max_by(value, order).alias(value))
    return rows.join(last, key, "left")


def strict_lookup(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Each row with its one row of side; the query fails for a duplicate or missing key."""
    side = require_unique(side, key).withColumn("__there", F.lit(True))
    joined = rows.join(side, key, "left")
    check = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return joined.where(check).drop("__there")


def stale_pointers(pointers: DataFrame, rows: DataFrame, keys: list[str], checks: list[str]) -> DataFrame:
    """Pointers whose target is missing or differs in a checked column, with the reason."""
    target = rows.select(*keys, *[F.col(c).alias(f"__{c}") for c in checks], F.lit(True).alias("__there"))
    reason = F.when(F.col("__there").isNull(), "missing")
    for c in checks:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c)
    joined = pointers.join(target, keys, "left").withColumn("reason", reason)
    return joined.where("reason IS NOT NULL").select(*pointers.columns, "reason")


def by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of a and b of equal position; positions come from sorting, without one task for all rows."""
    return with_position(a, order_a).join(with_position(b, order_b), "position")


def ordered_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __part, the place of a row's range of the order; written, so that every use sees the same parts."""
    path = scratch(df.sparkSession, "parts")
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def full_order(df: DataFrame, order: list[str]) -> list[str]:
    """The order and, behind it, the other columns that can be ordered: they decide between rows that the order leaves equal."""
    return [*order, *[f.name for f in df.schema if f.name not in order and not isinstance(f.dataType, MapType | VariantType)]]


def _local(parts: DataFrame, order: list[str]) -> WindowSpec:
    return Window.partitionBy("__part").orderBy(*order)


def running_total(df: DataFrame, order: str | list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over all rows up to each one in the order: sums within ranges, and of the ranges before.

    No task holds more than one range; only the ranges' sums (one row each) meet.
    """
    order = [order] if isinstance(order, str) else order
    parts, order = ordered_parts(df.withColumn("__value", value), order), full_order(df, order)
    sums = parts.groupBy("__part").agg(F.sum("__value").alias("__n"))
    starts = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))  # a row for each range
    total = F.sum("__value").over(_local(parts, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parts.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + total).drop("__part", "__value", "__start")


def with_position(df: DataFrame, order: str | list[str], name: str = "position") -> DataFrame:
    """df with the number of each row in the order, from 0, without one task for all rows."""
    return running_total(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def with_group_position(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """df with the number of each row within its group, from 0; a group of any size is dealt over ranges."""
    placed = with_position(df, [*group, *order], "__at")
    first = placed.groupBy(*group).agg(F.min("__at").alias("__first"))
    alike = [F.col(f"p.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    joined = placed.alias("p").join(small(first).alias("f"), reduce(and_, alike))
    return joined.select(*[F.col(f"p.{c}") for c in df.columns], (F.col("p.__at") - F.col("f.__first")).alias(name))


def with_previous(df: DataFrame, group: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """df with a struct of the value of `column` in the row before within the group, or null in a group's first row."""
    parts, order = ordered_parts(df, [*group, *order]), full_order(df, [*group, *order])
    row = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(column).alias("v"))
    last = parts.groupBy("__part").agg(F.max_by(row, F.struct(*order)).alias("__last"))
    carried = last.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__carried"))  # a row for each range
    rows = parts.join(F.broadcast(carried), "__part").withColumn("__row", row)
    rows = rows.withColumn("__prev", F.coalesce(F.lag("__row").over(_local(parts, order)), F.col("__carried")))
    same = reduce(and_, [F.col(f"__prev.g{i}").eqNullSafe(F.col(g)) for i, g in enumerate(group)], F.col("__prev").isNotNull())
    return rows.withColumn(name, F.when(same, F.struct(F.col("__prev.v").alias("value")))).drop("__part", "__carried", "__row", "__prev")


def delta(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Difference b - a with four decimals, blank where a side is missing."""
    left, right = a.select(*keys, F.col(value).alias("__a")), b.select(*keys, F.col(value).alias("__b"))
    text = F.format_string("%.4f", F.col("__b") - F.col("__a"))
    return left.join(right, keys, "full").select(*keys, F.when(F.col("__a").isNull() | F.col("__b").isNull(), "").otherwise(text).alias("delta"))


def banded_pairs(rows: DataFrame, distance: int = 3, off: float = 0.05, dense: int | None = 256) -> DataFrame:
    """first, second, distance of near 64-bit hashes: equal in one of four 16-bit bands, near in bits and aspect.

    rows: ord, id, hash, aspect, pixels. With `dense`, a row looks into a band's bin only while it holds at most
    that many earlier rows (as the audit that this serves defines it); None takes all.
    """
    bands = F.posexplode(F.array(*[F.shiftrightunsigned("hash", 16 * b).bitwiseAND(F.lit(65535)) for b in range(4)])).alias("band", "value")
    placed = rows.select("*", bands)
    if dense is not None:
        placed = with_group_position(placed, ["band", "value"], ["ord"], "__before")
    else:
        placed = placed.withColumn("__before", F.lit(0))
    early = placed.select("band", "value", *[F.col(c).alias(f"a_{c}") for c in ("ord", "id", "hash", "aspect", "pixels")])
    late = placed.where(F.col("__before") <= dense) if dense is not None else placed
    pairs = late.join(early, ["band", "value"]).where("a_ord < ord AND a_pixels <> pixels")
    pairs = pairs.where((hamming(F.col("hash"), F.col("a_hash")) <= distance) & (F.abs(F.log(F.col("aspect") / F.col("a_aspect"))) <= off))
    return pairs.select(F.col("a_id").alias("first"), F.col("id").alias("second"), hamming(F.col("hash"), F.col("a_hash")).alias("distance")).distinct()


def skipped_lookups(rows: DataFrame, dense: int = 256) -> DataFrame:
    """lookups and how many of them banded_pairs with this `dense` skips (one row)."""
    bins = rows.select(F.posexplode(F.array(*[F.shiftrightunsigned("hash", 16 * b).bitwiseAND(F.lit(65535)) for b in range(4)])).alias("band", "value"))
    sizes = bins.groupBy("band", "value").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lookups"), F.coalesce(F.sum(F.greatest(F.col("n") - dense - 1, F.lit(0))), F.lit(0)).alias("skipped"))


def zeroed_by_parents(questions: DataFrame, cascade: bool = True) -> DataFrame:
    """item, qid, score of questions (item, qid, parent, score): 0 where the parent's score is 0; parent 0 is none.

    With cascade, questions are taken in the order of qid and a parent already zeroed counts as 0.
    """
    if not cascade:
        parents = questions.select("item", F.col("qid").alias("parent"), F.col("score").alias("__p"))
        return questions.join(parents, ["item", "parent"], "left").select("item", "qid", F.when(F.col("__p") == 0, F.lit(0.0)).otherwise(F.col("score")).alias("score"))
    ordered = questions.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("qid", "parent", "score"))).alias("q"))

    def step(acc: Column, s: Column) -> Column:
        dead = F.exists(acc, lambda d: (d["qid"] == s["parent"]) & (d["score"] == 0))
        return F.concat(acc, F.array(F.struct(s["qid"].alias("qid"), F.when(dead, F.lit(0.0)).otherwise(s["score"]).alias("score"))))

    start = F.expr("cast(array() as array<struct<qid: bigint, score: double>>)")
    return ordered.select("item", F.inline(F.aggregate("q", start, step)))


def nearest_words(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """For each true word of a key the least edit distance to a found word (ties: the word that sorts first)."""
    a = truth.select(key, F.posexplode("words").alias("place", "word"))
    b = found.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("__found"))
    best = F.array_min(F.transform("__found", lambda w: F.struct(F.levenshtein(F.col("word"), w).alias("distance"), w.alias("match"))))
    return a.join(b, key, "left").select(key, "place", "word", best["match"].alias("match"), best["distance"].alias("distance"))

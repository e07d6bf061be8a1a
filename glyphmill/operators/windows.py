"""Window-style operators: offsets, groups, islands, splits, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.joins import running_total, small, with_group_position, with_previous


def rolling_offsets(rows: DataFrame, group: list[str], order: str, size: str, limit: int) -> DataFrame:
    """file and offset of payloads of one size in each group: a file holds what fits into the limit, at least one."""
    per_file = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(size))).cast("long")
    placed = with_group_position(rows, group, [order], "__p").withColumn("__n", per_file)
    return placed.withColumns({"file": F.expr("__p div __n"), "offset": (F.col("__p") % F.col("__n")) * F.col(size)}).drop("__p", "__n")


def greedy_groups(files: DataFrame, order: str, count: str, limit: int) -> DataFrame:
    """part of each file of a short list: a new part starts when the next file would exceed the limit."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (last["held"] + s["n"] <= limit)
        part = F.when(F.size(acc) == 0, F.lit(0)).when(fits, last["part"]).otherwise(last["part"] + 1)
        held = F.when(fits, last["held"] + s["n"]).otherwise(s["n"])
        return F.concat(acc, F.array(F.struct(s["o"].alias("o"), part.alias("part"), held.cast("long").alias("held"))))

    def guarded(acc: Column, s: Column) -> Column:
        first = F.array(F.struct(s["o"].alias("o"), F.lit(0).alias("part"), s["n"].cast("long").alias("held")))
        return F.when(F.size(acc) == 0, first).otherwise(step(acc, s))

    listed = files.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(count).cast("long").alias("n")))).alias("f"))
    kind = files.schema[order].dataType.simpleString()
    start = F.expr(f"cast(array() as array<struct<o: {kind}, part: int, held: bigint>>)")
    return listed.select(F.inline(F.aggregate("f", start, guarded))).select(F.col("o").alias(order), "part")


def islands(rows: DataFrame, partition: list[str], order: str, value: str, size: int | None = None) -> DataFrame:
    """island of each row: a new one where the value changes and, with size, a chunk after that many rows.

    Partitions of any size are dealt over ranges of the order: changes are told from the row before, across ranges too, and
    numbered by a running total.
    """
    change = F.coalesce((~F.col("__before.value").eqNullSafe(F.col(value))).cast("long"), F.lit(1))
    marked = with_previous(rows, partition, [order], value, "__before").withColumn("__change", change).drop("__before")
    total = running_total(marked, [*partition, order], F.col("__change"), "__all")
    first = total.groupBy(*partition).agg(F.min("__all").alias("__first"))
    out = total.join(small(first), partition).withColumn("island", F.col("__all") - F.col("__first") + 1).drop("__all", "__first", "__change")
    if size is None:
        return out
    return with_group_position(out, [*partition, "island"], [order], "__p").withColumn("chunk", F.expr(f"__p div {size}")).drop("__p")


def cumulative_split(total: int, parts: int, rank: int) -> tuple[int, int]:
    """Bounds of a part by rounding halves to even."""
    return round(rank * total / parts), round((rank + 1) * total / parts)


def last_takes_rest(position: Column, total: int, parts: int) -> Column:
    """Part of a position: equal floors, the last part takes the remainder."""
    return F.least(F.floor(position / max(1, total // parts)), F.lit(parts - 1))


def pad_to_multiple(rows: DataFrame, order: str, multiple: int) -> DataFrame:
    """rows and again the first ones, so that their number is a multiple."""
    missing = -rows.count() % multiple
    return rows.unionByName(rows.orderBy(order).limit(missing)) if missing else rows


def repeated(rows: DataFrame, times: int, name: str = "repeat") -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def spaced(count: int, picks: int) -> list[int]:
    """Evenly spaced places among count, both ends included."""
    return [0] if picks == 1 else [int(i * (count - 1) / (picks - 1)) for i in range(picks)]

"""Samples and splits: per group, round-robin, quotas, shards, batch plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.joins import small, with_group_position, with_position
from glyphmill.sources.scratch import scratch


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("__rn", place).where(F.col("__rn") <= k).drop("__rn")


def seeded_key(seed: int, *keys: str) -> Column:
    """A stable order of shuffled rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def seeded_sample(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows drawn without replacement."""
    return rows.orderBy(seeded_key(seed, key), key).limit(k)


def per_cell(rows: DataFrame, cell: list[str], key: str, k: int, seed: int) -> DataFrame:
    return top_per_group(rows, cell, [seeded_key(seed, key), F.col(key)], k)


def round_robin(rows: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """k rows, one of each group in turn, groups in their order, rows of a group shuffled."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(seeded_key(seed, key), key))
    return rows.withColumn("__rn", place).where(F.col("__rn") <= k).orderBy("__rn", group).limit(k).drop("__rn")


def thirds(count: int) -> list[int]:
    """A count in three parts, the first ones larger."""
    return [count // 3 + (i < count % 3) for i in range(3)]


def rotated(rows: DataFrame, domains: list[str], dimensions: list[str], order: str, k: int) -> DataFrame:
    """k rows over (domain, dimension): in each slot domain i takes dimension 2 i + slot, then the next row of each."""
    d = F.coalesce(F.array_position(F.array(*map(F.lit, domains)), F.col("domain")), F.lit(0)) - 1
    m = F.coalesce(F.array_position(F.array(*map(F.lit, dimensions)), F.col("dimension")), F.lit(0)) - 1
    n = len(dimensions)
    slot = F.pmod(m - 2 * d, F.lit(n))
    place = F.row_number().over(Window.partitionBy("domain", "dimension").orderBy(order))
    known = rows.where((d >= 0) & (m >= 0)).withColumns({"__rn": place, "__slot": slot, "__d": d})
    return known.where(F.col("__rn") <= k).orderBy("__rn", "__slot", "__d").limit(k).drop("__rn", "__slot", "__d")


def water_fill(capacities: DataFrame, total: int, key: str = "bucket", capacity: str = "capacity") -> DataFrame:
    """Quotas of a total: one for each bucket in turn while it has room.

    All buckets are filled to one level, found by halving, and the first ones that have more room take one more.
    """
    held = capacities.select(key, F.greatest(F.col(capacity).cast("long"), F.lit(0)).alias("__c"))
    path = scratch(held.sparkSession, "capacities")
    held.write.parquet(path)
    held = held.sparkSession.read.schema(held.schema).parquet(path)
    filled = lambda level: held.agg(F.coalesce(F.sum(F.least("__c", F.lit(level))), F.lit(0)).alias("n")).first()["n"]
    low, high = 0, max(0, total)  # filled to low, at most the total is taken
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if filled(middle) <= total else (low, middle - 1)
    rest = total - filled(low)
    more = held.where(F.col("__c") > low).orderBy(key).limit(rest).select(key, F.lit(1).alias("__more"))
    return held.join(small(more), key, "left").select(key, (F.least("__c", F.lit(low)) + F.coalesce("__more", F.lit(0))).alias("quota"))


def batch_plan(rows: DataFrame, group: str, key: str, batch: int, seed: int, epoch: int, drop_remainder: bool = False) -> DataFrame:
    """step, position, key: shuffled rows of each group in batches; the tail is padded from the group's start, or dropped.

    Batches of all groups are shuffled. The plan is a function of seed and epoch, so a run resumes at any step
    by filtering on step. Places within a group, and steps, come from ranges of the shuffled order, never from one task.
    """
    tag = seed * 1_000_003 + epoch
    shuffled = rows.select(group, key).withColumn("__key", seeded_key(tag, key))
    placed = with_group_position(shuffled, [group], ["__key", key], "__p")
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    full = F.floor(F.col("__n") / batch) * batch if drop_remainder else F.ceil(F.col("__n") / batch) * batch
    placed = placed.join(small(sizes), group).withColumn("__full", full.cast("long"))
    # A row stands at its place and, as padding, at places that many rows later.
    spots = F.sequence(F.col("__p").cast("long"), F.greatest(F.col("__full") - 1, F.col("__p").cast("long")), F.col("__n"))
    spread = placed.where(F.col("__p") < F.col("__full")).select(group, key, F.explode(spots).alias("__at")).withColumns({"__b": F.expr(f"__at div {batch}"), "position": F.col("__at") % batch})
    batches = sizes.withColumn("__full", full.cast("long")).where("__full > 0").select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"__full div {batch} - 1"))).alias("__b"))
    steps = with_position(batches.withColumn("__key", seeded_key(tag, group, "__b")), ["__key", group, "__b"], "step").drop("__key")
    return spread.join(steps, [group, "__b"]).select("step", "position", group, key)


def batch_plan_numpy(rows: DataFrame, group: str, order: str, key: str, batch: int, seed: int, epoch: int, drop_remainder: bool = False) -> DataFrame:
    """As batch_plan, with numpy's SeedSequence([seed, epoch, group]) permuting each group: (group, batch, position, key)."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        index = int(pdf[group].iloc[0])
        mixed = pdf[key].to_numpy()[np.random.default_rng(np.random.SeedSequence([seed, epoch, index])).permutation(len(pdf))]
        n = len(mixed) // batch if drop_remainder else -(-len(mixed) // batch)
        mixed = np.resize(mixed, n * batch) if n * batch > len(mixed) else mixed[: n * batch]
        place = np.arange(len(mixed))
        return pd.DataFrame({group: index, "batch": place // batch, "position": place % batch, key: mixed})

    return rows.select(group, order, *([key] if key != order else [])).groupBy(group).applyInPandas(plan, f"{group} long, batch long, position long, {key} long")


def even_shards(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """shard of each row: contiguous, sizes differ by one, larger ones first; positions need no single task."""
    n = rows.count()
    k = max(1, min(n, shards))
    size, more = divmod(n, k)
    edge = more * (size + 1)
    placed = with_position(rows, order)
    shard = F.when(F.col("position") < edge, F.expr(f"position div {size + 1}")).otherwise(F.lit(more) + F.expr(f"(position - {edge}) div {max(size, 1)}"))
    return placed.withColumn("shard", shard)

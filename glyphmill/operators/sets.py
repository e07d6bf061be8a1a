"""Set operations: unions with ids, multiset overlap, duplicates, hash fractions, weighted draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_with_ids(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All rows of all parts with global_id, "name:key"."""
    return reduce(DataFrame.unionByName, [df.withColumn("global_id", F.concat_ws(":", F.lit(name), F.col(key).cast("string"))) for name, df in parts.items()])


def multiset_overlap(truth: DataFrame, found: DataFrame, key: str, token: str = "token") -> DataFrame:
    """For each key the number of true tokens and how many of them are found, each as often as it occurs."""
    a = truth.groupBy(key, token).agg(F.count("*").alias("__a"))
    b = found.groupBy(key, token).agg(F.count("*").alias("__b"))
    rows = a.join(b, [key, token], "left")
    return rows.groupBy(key).agg(F.sum("__a").alias("total"), F.sum(F.least("__a", F.coalesce("__b", F.lit(0)))).alias("matched"))


def duplicates(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Values of more than one row, with their number and least key."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def hash_fraction(key: Column, fraction: float, salt: str) -> Column:
    """Whether a key falls into a stable fraction of all keys; a null key does not."""
    place = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("long") % 2147483647
    return F.coalesce(place < int(fraction * 2147483647), F.lit(False))


def weighted_draws(draws: DataFrame, weights: dict[str, float], seed: int, key: str = "draw") -> DataFrame:
    """Each draw with a source chosen in proportion to the weights by a hash of (seed, draw)."""
    total, run = sum(weights.values()), 0.0
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
    names = list(weights)
    source = F.lit(names[-1])
    for name in reversed(names[:-1]):
        run = sum(weights[n] for n in names[: names.index(name) + 1]) / total
        source = F.when(u < run, name).otherwise(source)
    return draws.withColumn("source", source)

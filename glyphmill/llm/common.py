"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one call of a batch kernel sees at most (a longer single text is one call).
KERNEL_BYTES = 4 << 20

#: Places that a running sum takes at a time, and code points of a block of text.
BLOCK = 64

WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it is unset, on one machine (tests), a local one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, which survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/glyphmill/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def hash_share(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_003)) / F.lit(1_000_003.0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def running(values: Column, largest: bool = False) -> Column:
    """Sums (or maxima, from 0) of the values before each place and, last, of all; by blocks."""
    join = (lambda a, v: F.greatest(a, v)) if largest else (lambda a, v: a + v)

    def total(part: Column, start: Column) -> Column:
        return F.aggregate(part, start, join)

    def places(v: Column) -> Column:
        def at(h: Column) -> Column:
            def one(i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                return total(F.slice(v, block * BLOCK + 1, i % BLOCK), F.get(h, block))

            return F.transform(F.sequence(F.lit(0), F.size(v)), one)

        return let(heads(v), at)

    def heads(v: Column) -> Column:
        blocks = F.floor(F.size(v) / BLOCK).cast("int")
        return F.aggregate(F.sequence(F.lit(0), blocks), F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), F.element_at(acc, -1)))))

    return let(values, places)


def byte_slices(sizes: Iterable[int], limit: int = KERNEL_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about equal bytes: no range has over limit bytes unless it is one row."""
    sizes = list(sizes)
    total, start, held = sum(sizes), 0, 0
    share = total / max(1, -(-total // limit)) if total else limit
    for i, n in enumerate(sizes):
        if i > start and held + n > limit or held >= share:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def uncollected(batches: Iterator[Any]) -> Iterator[Any]:
    """The batches, without cyclic garbage collection meanwhile (kernels hold many strings and make no cycles).

    The worker is used again for other work, so collection is switched back on at the end.
    """
    was = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if was:
            gc.enable()


def sampled_labels(labels: DataFrame, value: str, bound: int, seed: int, keep: Column) -> tuple[DataFrame, dict[int, int]]:
    """About `bound` labelled ids at most, drawn by hash from the non-null rows that `keep` allows; one row for an id.

    Contradicting labels of one id are settled by the larger value. The result is small by construction. Also returns the number of labelled ids of each label.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull() & keep)
    rows = rows.groupBy("doc_id").agg(F.max(F.col(value).cast("int")).alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, bound / max(1, len(counts)) / n))).otherwise(share)
    return rows.where(hash_share(seed, F.col("doc_id")) < share), counts

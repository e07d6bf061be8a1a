"""Pixel and mask payloads in rolling binary files: write with digests, read back, check, and fetch with bounds.

Payload files are plain files, so their folder must be one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.manifests import write_json

FORMAT = "glyphmill-cache-1"
ENTRY = "key string, bucket string, path string, offset long, size long, sha256 string"
#: Bytes of payloads (on average) that one task writes of one bucket.
PART_BYTES = 1 << 30


def write_cache(rows: DataFrame, folder: str, limit: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """Payloads (key string, bucket string, payload binary) to files of one bucket, none beyond `limit` bytes unless one payload is.

    A bucket is dealt to as many parts as its bytes ask for, so a hot one is no single task. Files are written under
    another name and renamed, so a task that runs twice leaves whole files of the same name and content. Returns the entries,
    read from the manifest that is written beside the files; summary.json, last, makes the cache complete.
    """
    spark = rows.sparkSession
    Path(folder, "parts").mkdir(parents=True, exist_ok=True)
    sizes = rows.groupBy("bucket").agg(F.sum(F.length("payload")).alias("n")).select("bucket", F.greatest(F.ceil(F.col("n") / part_bytes), F.lit(1)).cast("long").alias("__parts"))
    dealt = rows.join(sizes, "bucket").withColumn("__part", F.pmod(F.xxhash64("key"), F.col("__parts")))  # Spark picks the join: one row a bucket

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        bucket, part = str(pdf["bucket"].iloc[0]), int(pdf["__part"].iloc[0])
        name = hashlib.sha256(bucket.encode()).hexdigest()[:12]
        entries, held, number = [], [], 0

        def flush() -> None:
            nonlocal number, held
            if held:
                target = Path(folder, "parts", f"{name}_{part:06d}_{number:06d}.bin")
                temporary = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                with temporary.open("wb") as out:
                    for payload in held:
                        out.write(payload)
                    out.flush()
                    os.fsync(out.fileno())
                os.replace(temporary, target)
                number, held = number + 1, []

        offset = 0
        for key, payload in zip(pdf["key"], pdf["payload"], strict=True):
            payload = bytes(payload)
            if held and offset + len(payload) > limit:
                flush()
                offset = 0
            entries.append((key, bucket, f"parts/{name}_{part:06d}_{number:06d}.bin", offset, len(payload), hashlib.sha256(payload).hexdigest()))
            held.append(payload)
            offset += len(payload)
        flush()
        return pd.DataFrame(entries, columns=[c.split()[0] for c in ENTRY.split(", ")])

    dealt.select("key", "bucket", "payload", "__part").groupBy("bucket", "__part").applyInPandas(write, ENTRY).write.mode("overwrite").parquet(f"{folder}/manifest")
    entries = spark.read.parquet(f"{folder}/manifest")
    bad = checked(entries, folder).where("problem IS NOT NULL")
    if not bad.isEmpty():
        raise ValueError(f"written bytes differ: {bad.first()}")
    files(entries, folder).write.mode("overwrite").parquet(f"{folder}/files")
    count = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    write_json(f"{folder}/summary.json", {"format": FORMAT, "status": "complete", "verified": True, "count": count["n"], "bytes": count["bytes"], "digest": manifest_digest(entries)})
    return entries


def manifest_digest(entries: DataFrame) -> str:
    """Of the entries as a set, whatever their order."""
    row = entries.agg(F.sum(F.xxhash64("key", "bucket", "path", "offset", "size", "sha256").cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(str(row["h"]).encode()).hexdigest()


def files(entries: DataFrame, folder: str) -> DataFrame:
    """path, bytes, sha256 of each payload file; each is read in blocks."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                h, n = hashlib.sha256(), 0
                with open(f"{folder}/{path}", "rb") as f:
                    while block := f.read(8 << 20):
                        h.update(block)
                        n += len(block)
                rows.append((path, n, h.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256"])

    return entries.select("path").distinct().mapInPandas(digest, "path string, bytes long, sha256 string")


def checked(entries: DataFrame, folder: str) -> DataFrame:
    """The entries with a problem: missing, truncated, checksum, or null."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(problem=[_problem(folder, r.path, r.offset, r.size, r.sha256) for r in pdf.itertuples()])

    return entries.mapInPandas(check, f"{ENTRY}, problem string")


def _problem(folder: str, path: str, offset: int, size: int, sha256: str) -> str | None:
    try:
        data = bytes(fetch(f"{folder}/{path}", offset, size))
    except FileNotFoundError:
        return "missing"
    except ValueError:
        return "truncated"
    return None if hashlib.sha256(data).hexdigest() == sha256 else "checksum"


@lru_cache(maxsize=8)
def _mapped(path: str, changed: int, size: int) -> np.ndarray:
    return np.memmap(path, mode="r", dtype=np.uint8) if size else np.zeros(0, np.uint8)


def fetch(path: str, offset: int, size: int) -> np.ndarray:
    """Bytes of a payload file, mapped; an error where they reach beyond it."""
    stat = os.stat(path)
    if offset < 0 or size < 0 or offset + size > stat.st_size:
        raise ValueError(f"{path} is truncated: {offset} + {size} > {stat.st_size}")
    return _mapped(path, stat.st_mtime_ns, stat.st_size)[offset : offset + size]


def pixels(path: str, offset: int, height: int, width: int) -> np.ndarray:
    """An 8-bit RGB image of a cache."""
    return fetch(path, offset, height * width * 3).reshape(height, width, 3)


def mask(path: str, offset: int, height: int, width: int) -> np.ndarray:
    """A half-precision mask of a cache; an error unless all its values are finite and within 0 and 1."""
    if offset % 2:
        raise ValueError("a mask begins at an even byte")
    values = fetch(path, offset, 2 * height * width).view("<f2").astype(np.float32)
    if not np.isfinite(values).all() or (values < 0).any() or (values > 1).any():
        raise ValueError(f"invalid mask at {offset} of {path}")
    return values.reshape(height, width)


def open_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of a complete cache; an error if its summary, manifest or payload files are not what was written."""
    try:
        summary = json.loads(Path(folder, "summary.json").read_text())
    except FileNotFoundError:
        raise ValueError(f"{folder} is not complete") from None
    if summary.get("format") != FORMAT or summary.get("status") != "complete" or not summary.get("verified"):
        raise ValueError(f"{folder} is not a complete cache")
    entries = spark.read.parquet(f"{folder}/manifest")
    if manifest_digest(entries) != summary["digest"]:
        raise ValueError(f"{folder}: the manifest differs from the summary")
    try:
        now = files(entries, folder).join(spark.read.parquet(f"{folder}/files").withColumnsRenamed({"bytes": "b", "sha256": "s"}), "path", "full")
        bad = now.where("NOT (bytes <=> b AND sha256 <=> s)").first()
    except Exception as e:  # a file that is not there fails the task
        raise ValueError(f"{folder}: payload files can't be read") from e
    if bad is not None:
        raise ValueError(f"{folder}: {bad['path']} differs from what was written")
    return entries

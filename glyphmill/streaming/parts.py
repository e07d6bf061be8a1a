"""Micro-batch pipelines with part receipts, resume, run identity, and running summaries."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.manifests import write_json


def fingerprint(value: object) -> str:
    """Digest of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def ensure_identity(path: str, value: object) -> None:
    """Record what a run is; a later run with other settings is refused."""
    file = Path(path)
    if file.exists():
        if json.loads(file.read_text())["fingerprint"] != fingerprint(value):
            raise ValueError(f"{path} belongs to a run with other settings")
    else:
        write_json(path, {"fingerprint": fingerprint(value), "settings": value})


@contextmanager
def exclusive(path: str) -> Iterator[None]:
    """Only one writer at a time."""
    with open(path, "w") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError(f"another run holds {path}") from None
        yield


def await_published(path: str, source: str, alive: Callable[[], bool] = lambda: True, seconds: float = 5.0, patience: float = 3600.0) -> dict:
    """The report at path, once another run has published it.

    An error if that run stops without publishing, if patience ends, or if the report is of another source.
    """
    file, start = Path(path), time.monotonic()
    while not file.is_file():
        if not alive() and not file.is_file():
            raise RuntimeError(f"the run stopped without publishing {path}")
        if time.monotonic() - start > patience:
            raise TimeoutError(f"{path} was not published")
        time.sleep(seconds)
    report = json.loads(file.read_text())
    if report.get("source") != source:
        raise ValueError(f"{path} belongs to another source")
    return report


def run_parts(spark: SparkSession, source: str, schema: str, output: str, work: Callable[[DataFrame], DataFrame], files_per_part: int = 1, form: str = "parquet") -> int:
    """Each new group of source files becomes a part: its table, then its receipt. A part without receipt is redone.

    Offsets are in the checkpoint, a part's folder is named by its batch, and a redone batch overwrites its
    folder, so each input file counts exactly once. Returns the number of parts with receipts.
    """
    os.makedirs(f"{output}/receipts", exist_ok=True)

    def commit(batch: DataFrame, number: int) -> None:
        receipt = Path(f"{output}/receipts/{number:06d}.json")
        if receipt.exists():
            return
        work(batch).write.mode("overwrite").parquet(f"{output}/parts/part={number}")
        rows = spark.read.parquet(f"{output}/parts/part={number}")
        digest = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
        write_json(str(receipt), {"part": number, "rows": digest["n"], "digest": str(digest["h"])})

    stream = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_part).load(source)
    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(list(Path(f"{output}/receipts").glob("*.json")))


def buffered_shuffle(rows: DataFrame, buffer: int, seed: int) -> DataFrame:
    """rows of each partition in another order: a buffer of rows, of which a random one leaves as the next comes in."""
    import random

    import pandas as pd

    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rng = random.Random(f"{seed}:{TaskContext.get().partitionId()}")
        held: list[tuple] = []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if len(held) < buffer:
                    held.append(row)
                else:
                    at = rng.randrange(buffer)
                    out.append(held[at])
                    held[at] = row
            if out:
                yield pd.DataFrame(out, columns=names)
        rng.shuffle(held)
        if held:
            yield pd.DataFrame(held, columns=names)

    return rows.mapInPandas(run, rows.schema)


def ordered_chunks(rows: DataFrame, work: Callable[[list[tuple]], list[tuple]], schema: str, size: int = 2048) -> DataFrame:
    """work over chunks of consecutive rows of each partition; results keep the rows' order."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            listed = list(pdf.itertuples(index=False, name=None))
            for start in range(0, len(listed), size):
                yield pd.DataFrame(work(listed[start : start + size]), columns=names)

    return rows.mapInPandas(run, schema)


def verify_parts(spark: SparkSession, output: str) -> list[int]:
    """Numbers of parts whose table differs from the receipt."""
    bad = []
    for file in sorted(Path(f"{output}/receipts").glob("*.json")):
        receipt = json.loads(file.read_text())
        rows = spark.read.parquet(f"{output}/parts/part={receipt['part']}")
        digest = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
        if (digest["n"], str(digest["h"])) != (receipt["rows"], receipt["digest"]):
            bad.append(receipt["part"])
    return bad


def windowed_counts(stream: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and key, with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def without_repeats(stream: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drained(frame: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The result of a streaming frame after all its present input."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)

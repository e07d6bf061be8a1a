"""Sinks and scans of small files: caption batches, metrics, dataset metadata, prompt sets, nested prompts, score files."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.manifests import write_json

# The prompt sets, their files and forms.
PROMPT_SETS = {
    "geneval": ("geneval.jsonl", "lines"),
    "geneval_simple_rewrite": ("geneval_simple_rewrite.txt", "text"),
    "geneval_complex_rewrite": ("geneval_complex_rewrite.jsonl", "lines"),
    "geneval_repeated4": ("geneval_repeated4.txt", "text"),
    "geneval_repeated8": ("geneval_repeated8.txt", "text"),
    "geneval_repeated12": ("geneval_repeated12.txt", "text"),
    "geneval_repeated16": ("geneval_repeated16.txt", "text"),
    "geneval_repeated20": ("geneval_repeated20.txt", "text"),
    "geneval_repeated24": ("geneval_repeated24.txt", "text"),
    "dpg": ("dpg.json", "pairs"),
    "dpg_simple_rewrite": ("dpg_simple_rewrite.json", "pairs"),
    "dpg_complex_rewrite": ("dpg_complex_rewrite.json", "pairs"),
    "prism": ("prism.json", "strings"),
    "prism_simple_rewrite": ("prism_simple_rewrite.json", "strings"),
    "prism_complex_rewrite": ("prism_complex_rewrite.json", "strings"),
    "CVTG-2K": ("CVTG-2K.json", "pairs"),
    "CVTG-2K_simple_rewrite": ("CVTG-2K_simple_rewrite.json", "pairs"),
    "CVTG-2K_complex_rewrite": ("CVTG-2K_complex_rewrite.json", "pairs"),
    "longtext": ("longtext.jsonl", "lines"),
    "longtext_simple_rewrite": ("longtext_simple_rewrite.jsonl", "lines"),
    "longtext_complex_rewrite": ("longtext_complex_rewrite.jsonl", "lines"),
}


def prompt_set(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """position and prompt of a named set, in the file's order; blank lines of text sets count."""
    if name not in PROMPT_SETS:
        raise ValueError(f"no prompt set {name}")
    file, form = PROMPT_SETS[name]
    whole = spark.read.text(f"{folder}/{file}", wholetext=True)  # a set is a short file
    if form == "strings":
        items, prompt = F.from_json("value", "array<string>"), F.col("item")
    elif form == "pairs":
        items, prompt = F.from_json("value", "array<array<string>>"), F.trim(F.get("item", 1))
    else:
        items = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
        prompt = F.get_json_object("item", "$.prompt") if form == "lines" else F.trim("item")
    return whole.select(F.posexplode(items).alias("position", "item")).select(F.col("position").cast("long").alias("position"), prompt.alias("prompt"))


def nested_prompts(spark: SparkSession, folder: str, categories: tuple[str, ...], areas: tuple[int, ...]) -> DataFrame:
    """id, category, area, prompt of <category>/<area>.json files, whose data_list holds index and prompt; repeated ids fail."""
    from glyphmill.operators.audits import require_unique

    rows = None
    for category in categories:
        for area in areas:
            one = spark.read.schema("data_list array<struct<index: string, prompt: string>>").option("multiLine", True).json(f"{folder}/{category}/{area}.json")
            one = one.select(F.lit(category).alias("category"), F.lit(area).alias("area"), F.inline("data_list"))
            rows = one if rows is None else rows.union(one)
    rows = rows.select(F.concat_ws("_", "category", "area", "index").alias("id"), "category", "area", "prompt")
    return require_unique(rows, "id")


def score_files(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """kind, category, number, score of <kind>/<category>/<number>.jsonl below `most`; files without a number as score give no row."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"/([^/]+)/([^/]+)/([0-9]+)\.jsonl$", i)
    raw = F.get_json_object("value", "$.score")
    number = F.when(~F.col("value").rlike(r'"score"\s*:\s*["tfn\[{]'), raw.try_cast("double"))
    rows = whole.select(part(1).alias("kind"), part(2).alias("category"), part(3).try_cast("long").alias("number"), number.alias("score"))
    return rows.where((F.col("number") < most) & F.col("score").isNotNull())


def commit_batches(rows: DataFrame, folder: str, key: str, value: str, size: int = 500) -> DataFrame:
    """file and number of captions: each task commits batches of `size` as one JSON object, in a file named by its first key.

    A batch is written under another name and renamed. A task that runs twice writes the same files.
    """
    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, str] = {}

        def commit() -> pd.DataFrame:
            name = f"{next(iter(held))}.json"
            temporary = Path(folder, f".{name}.{uuid.uuid4().hex}")
            temporary.write_text(json.dumps(held, ensure_ascii=False), encoding="utf-8")
            os.replace(temporary, Path(folder, name))
            out = pd.DataFrame({"file": [name], "n": [len(held)]})
            held.clear()
            return out

        for pdf in batches:
            for k, v in zip(pdf[key], pdf[value], strict=True):
                held[str(k)] = (v or "").strip()
                if len(held) >= size:
                    yield commit()
        if held:
            yield commit()

    return rows.select(key, value).where(F.col(key).isNotNull()).sortWithinPartitions(key).mapInPandas(run, "file string, n long")


#: Quotes are doubled, blanks kept, and a null is \\N, so that any text reads back.
TABLE = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_table(rows: DataFrame, path: str, separator: str = ",") -> None:
    """CSV, or TSV with a tab, with a header and quoted values."""
    rows.write.options(**TABLE, sep=separator, quoteAll="true").csv(path)


def read_table(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    return spark.read.schema(schema).options(**TABLE, sep=separator, multiLine="true").csv(path)


class MetricLog:
    """Metrics of a run, a JSON line for each step that measured anything."""

    def __init__(self, folder: str, config: dict | None = None):
        Path(folder).mkdir(parents=True, exist_ok=True)
        self.path, self.step, self.held = Path(folder, "metrics.jsonl"), 0, {}
        if config is not None:
            write_json(f"{folder}/config.json", config)

    def start(self, step: int) -> None:
        self.step, self.held = step, {}

    def measure(self, name: str, value: float) -> float:
        self.held[name] = float(value)
        return self.held[name]

    def end(self) -> None:
        if self.held:
            with self.path.open("a", encoding="utf-8") as out:
                out.write(json.dumps({"step": self.step, **self.held}) + "\n")
            self.held = {}


def write_metadata(spark: SparkSession, folder: str, name: str, features: dict, splits: DataFrame, version: str = "1.0.0", description: str = "dataset of image-caption pairs") -> dict:
    """The sidecar of a record dataset: its features, version, and the shards, rows and bytes of each split.

    splits: split, shard (its file), n, bytes; shards come in the order of their names.
    """
    per = splits.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("shard", "n", "bytes"))).alias("shards")).orderBy("split").collect()  # a row for each file
    info = {
        "name": name, "version": version, "description": description, "supervised_keys": ["image", "caption"], "features": features,
        "splits": [{"name": r["split"], "shards": [s["shard"] for s in r["shards"]], "shard_lengths": [s["n"] for s in r["shards"]], "num_examples": sum(s["n"] for s in r["shards"]), "num_bytes": sum(s["bytes"] for s in r["shards"])} for r in per],
    }
    write_json(f"{folder}/dataset_info.json", info)
    write_json(f"{folder}/features.json", features)
    return info


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """split, rows and bytes of a sidecar."""
    info = spark.read.option("multiLine", True).schema("splits array<struct<name: string, num_examples: long, num_bytes: long>>").json(f"{folder}/dataset_info.json")
    return info.select(F.inline("splits")).toDF("split", "n", "bytes")



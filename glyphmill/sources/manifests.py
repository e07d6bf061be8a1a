"""Sources and sinks of manifests, prompts, listings, tables of other engines, and fetched files."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glyphmill.sources.scratch import scratch

RECORD = (
    "id string, caption string, width int, height int, image_path string, parquet_path string, row_group int, row_in_group int, "
    "cache_path string, cache_offset bigint, cache_height int, cache_width int, transform_fingerprint string"
)
SUFFIXES = "jpg|jpeg|png|webp|bmp|tif|tiff"


def manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines manifest with their raw line, variant and problem; blank lines are skipped.

    With strict, a row with a problem fails the query.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.col("value").alias("line"), F.from_json("value", RECORD).alias("r")).select("line", "r.*")
    variant = F.when(F.col("cache_path").isNotNull(), "cache").when(F.col("parquet_path").isNotNull(), "parquet").when(F.col("image_path").isNotNull(), "image")
    rows = rows.withColumn("variant", variant)
    problem = (
        F.when(F.col("id").isNull(), "no id")
        .when(F.trim(F.coalesce("caption", F.lit(""))) == "", "blank caption")
        .when((F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0), "bad size")
        .when(F.col("variant").isNull(), "no location")
        .when((F.col("variant") == "parquet") & (F.least(F.coalesce("row_group", F.lit(-1)), F.coalesce("row_in_group", F.lit(-1))) < 0), "bad position")
        .when((F.col("variant") == "cache") & ((F.coalesce("cache_offset", F.lit(-1)) < 0) | (F.coalesce("cache_height", F.lit(0)) <= 0) | (F.coalesce("cache_width", F.lit(0)) <= 0)), "bad cache position")
    )
    rows = rows.withColumn("problem", problem)
    if strict:
        rows = rows.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("problem", F.lit(": "), "line")).cast("boolean")).otherwise(True))
    return rows


def write_lines(rows: DataFrame, path: str, order: str | None = None, column: str = "line") -> None:
    """The untouched lines as text files; refuses to write nothing."""
    if rows.isEmpty():
        raise ValueError("nothing to write")
    (rows.orderBy(order) if order else rows).select(F.col(column).alias("value")).write.text(path)


def image_files(spark: SparkSession, folder: str, case_sensitive: bool = False, suffixes: str = SUFFIXES) -> DataFrame:
    """path, length and modification time of the image files below a folder; contents are not read."""
    path = F.col("path") if case_sensitive else F.lower("path")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(path.rlike(rf"\.({suffixes})$")).select("path", "length", "modificationTime")


def prompts(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """prompt of text lines, JSON lines with a key, or a JSON array of strings, objects or pairs."""
    if path.endswith(".txt"):
        rows = spark.read.text(path).select(F.trim("value").alias("prompt"))
    elif path.endswith(".jsonl"):
        rows = spark.read.text(path).select(F.get_json_object("value", f"$.{key or 'prompt'}").alias("prompt"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
        value = F.when(F.col("item").startswith("["), F.get_json_object("item", "$[1]")).when(F.col("item").startswith("{"), F.get_json_object("item", f"$.{key or 'prompt'}")).otherwise(F.col("item"))
        rows = whole.select(F.trim(value).alias("prompt"))
    return rows.where(F.col("prompt") != "")


def done_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of JSON objects, or of lists of objects, in a folder's files; malformed files give none."""
    whole = spark.read.text(f"{folder}/*.json", wholetext=True)
    keys = F.coalesce(F.map_keys(F.from_json("value", "map<string, string>")), F.flatten(F.transform(F.from_json("value", "array<map<string, string>>"), lambda m: F.map_keys(m))))
    return whole.select(F.explode(keys).alias("key")).distinct()


def caption_maps(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """The last non-null value of each caption column for each key."""
    return rows.groupBy(key).agg(*[F.expr(f"max_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns])


def parquet_shards(spark: SparkSession, folder: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all Parquet files below a folder with their file and position."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df.withColumns({"file_path": F.col("_metadata.file_path"), "row_index": F.expr("_metadata.row_index")})


def fetched(rows: DataFrame, fetch: Callable[[str], bytes | None], key: str = "photoid", url: str = "url", threads: int = 8, tries: int = 3) -> DataFrame:
    """key, data, error of each URL: a bounded pool of threads in each task, with retries."""

    def one(target: str) -> tuple[bytes | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                data = fetch(target)
                return (data, None) if data else (None, "empty")
            except Exception as e:  # noqa: BLE001  a fetcher may fail in any way; the reason is the result
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf[url]))
                yield pd.DataFrame({key: pdf[key], "data": [d for d, _ in got], "error": [e for _, e in got]})

    clean = rows.where(F.trim(F.coalesce(key, F.lit(""))) != "").select(F.trim(key).alias(key), url)
    return clean.mapInPandas(run, f"{key} string, data binary, error string")


def write_json(path: str, value: object) -> None:
    """A report as JSON: a temporary file, flushed, then renamed."""
    target = Path(path)
    temporary = target.with_name(f".{target.name}.{os.getpid()}.tmp")
    with temporary.open("w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, target)


def gallery(rows: DataFrame, folder: str, order: list[str], columns: list[str], page: int = 200) -> DataFrame:
    """All rows as pages of tables, in order, `page` rows each; values are escaped. Returns page and its number of rows.

    Pages are written by the tasks, so the folder must be one that driver and executors share.
    """
    import html

    from glyphmill.operators.joins import with_position

    Path(folder).mkdir(parents=True, exist_ok=True)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, number = pdf.sort_values("__at"), int(pdf["__page"].iloc[0])
        head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>\n" for r in pdf[columns].itertuples(index=False))
        links = f'<a href="page{number - 1:06d}.html">before</a> <a href="page{number + 1:06d}.html">after</a>'
        target = Path(folder, f"page{number:06d}.html")
        temporary = target.with_name(f".{target.name}.{os.getpid()}")
        temporary.write_text(f"<!doctype html><meta charset=utf-8>{links}<table><tr>{head}</tr>\n{body}</table>\n", encoding="utf-8")
        os.replace(temporary, target)
        return pd.DataFrame({"page": [number], "n": [len(pdf)]})

    placed = with_position(rows.select(*dict.fromkeys([*order, *columns])), order, "__at").withColumn("__page", F.expr(f"__at div {page}"))
    return placed.groupBy("__page").applyInPandas(write, "page long, n long")


def in_file_order(rows: DataFrame) -> Column:
    """A key that grows along the files of a scan of text: the file, the block's start, and the row within the block."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def shape_metadata(spark: SparkSession, path: str, key: str = "image_path", fields: tuple[str, ...] = ("width", "height")) -> DataFrame:
    """key and short_edge of JSON lines; the last line of a key wins. A missing field is an error."""
    lines = spark.read.text(path)
    rows = lines.select(in_file_order(lines).alias("at"), F.col("value").alias("line")).where(F.trim("line") != "")
    rows = rows.withColumn("r", F.from_json("line", ", ".join([f"{key} string", *[f"{f} long" for f in fields]])))
    missing = reduce(or_, [F.col(f"r.{c}").isNull() for c in (key, *fields)])
    rows = rows.where(F.when(missing, F.raise_error(F.concat(F.lit("a field is missing: "), "line")).cast("boolean")).otherwise(True))
    return rows.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by(F.least(*[F.col(f"r.{f}") for f in fields]), "at").alias("short_edge"))


def csv_last(spark: SparkSession, path: str, schema: str, key: str, drop_first: bool = False) -> DataFrame:
    """Rows of CSV files with a header, the last of each key; with drop_first without the first data row of all."""
    raw = spark.read.schema(schema).option("header", "true").csv(path)
    rows = raw.select("*", in_file_order(raw).alias("__at"))
    if drop_first:
        path = scratch(spark, "csv")  # written, so that both uses see the same order
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        rows = rows.join(F.broadcast(rows.agg(F.min("__at").alias("__first"))), F.col("__at") > F.col("__first")).drop("__first")  # one row
    names = [c for c in raw.columns if c != key]
    return rows.groupBy(key).agg(*[F.max_by(c, "__at").alias(c) for c in names])


def fetch_rows(pointers: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pointers (id, path, row_group, row_in_group) with columns (name: type) of their Parquet rows and a problem, or null.

    Only the row groups that are pointed at are read, each once, and of them only the columns. Paths must be ones that
    executors can open.
    """

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.parquet as pq

        out = pdf[["id", "path", "row_group", "row_in_group"]].reset_index(drop=True)
        group, problem, table = int(out["row_group"].iloc[0]), None, None
        try:
            file = pq.ParquetFile(out["path"].iloc[0])
            if not 0 <= group < file.num_row_groups:
                problem = "no row group"
            elif missing := [c for c in columns if c not in file.schema_arrow.names]:
                problem = f"no column {missing[0]}"
            else:
                table = file.read_row_group(group, columns=list(columns)).to_pydict()
        except Exception as e:  # noqa: BLE001  an unreadable file is reported for each of its pointers
            problem = f"unreadable: {type(e).__name__}"
        size = len(next(iter(table.values()))) if table else 0
        ok = [table is not None and 0 <= r < size for r in out["row_in_group"]]
        for c in columns:
            out[c] = pd.Series([table[c][r] if good else None for r, good in zip(out["row_in_group"], ok, strict=True)], dtype=object)
        out["problem"] = [None if good else problem or "no row" for good in ok]
        return out

    schema = ", ".join(["id string, path string, row_group long, row_in_group long", *[f"{c} {t}" for c, t in columns.items()], "problem string"])
    rows = pointers.select(F.col("id").cast("string"), "path", F.col("row_group").cast("long"), F.col("row_in_group").cast("long"))
    return rows.groupBy("path", "row_group").applyInPandas(read, schema)


def export_files(rows: DataFrame, folder: str, name: str, data: str) -> DataFrame:
    """name, path and bytes of payloads written as single files (PNG, thumbnails, reports) in a shared folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = []
            for n, d in zip(pdf[name], pdf[data], strict=True):
                target = Path(folder, n)
                if not target.resolve().is_relative_to(Path(folder).resolve()):
                    raise ValueError(f"{n} leaves the folder")
                target.parent.mkdir(parents=True, exist_ok=True)
                temporary = target.with_name(f".{target.name}.{os.getpid()}")
                temporary.write_bytes(bytes(d))
                os.replace(temporary, target)
                paths.append(str(target))
            yield pd.DataFrame({"name": pdf[name], "path": paths, "bytes": [len(d) for d in pdf[data]]})

    return rows.select(name, data).mapInPandas(write, "name string, path string, bytes long")


@dataclass
class RowRange(InputPartition):
    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.table, self.columns = options["path"], options["dbtable"], columns
        self.parts = int(options.get("numPartitions", "4"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[RowRange]:
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return []
        size = -(-(high - low + 1) // self.parts)
        return [RowRange(a, min(a + size, high + 1)) for a in range(low, high + 1, size)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """spark.read.format("sqlite").schema(...).option("dbtable", name).load(file): ranges of row ids, read-only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> SqliteReader:  # noqa: ANN001
        return SqliteReader(self.options, schema.fieldNames())

"""All queries of the library's own operators with their SQL and the operators that they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

#: The image view that stands for an image table: sizes by integer arithmetic on the document id.
IMAGES_SQL = """(SELECT doc_id, 200 + (doc_id * 7919) % 4000 AS width, 200 + (doc_id * 104729) % 4000 AS height,
  source || '/' || doc_id AS key, text AS caption, source, lang, n_chars FROM documents)"""


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise KeyError(f"query {f.__name__} exists")
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = covers
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("{images}", IMAGES_SQL)
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr(
        "doc_id", "200 + (doc_id * 7919) % 4000 AS width", "200 + (doc_id * 104729) % 4000 AS height", "source || '/' || doc_id AS key", "text AS caption", "source", "lang", "n_chars"
    )


from glyphmill.plans import aggregations, artifacts, evaluations, files, geometry, inputs, joins, outputs, text, windows  # noqa: E402,F401

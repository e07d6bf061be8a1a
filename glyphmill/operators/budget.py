"""The token budget of a manifest: kept lines beside the input, and a report of what was kept."""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import statistics as ST
from glyphmill.sources import manifests as M
from glyphmill.sources.scratch import posix

QUANTILES = (50.0, 90.0, 95.0, 99.0, 99.9)


def lines_digest(lines: DataFrame, column: str = "line") -> str:
    """A digest of the lines as a multiset: the sum of their 64-bit hashes, and their number."""
    row = lines.agg(F.sum(F.xxhash64(column).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    return f"{row['n']}:{row['h']}"


def filter_manifest(spark: SparkSession, source: str, output: str, limit: int, tokens: Column, overwrite: bool = False) -> dict:
    """Write the lines within the budget, as they are, to `output`, what was dropped to <output>.dropped, and a report.

    tokens counts those of the column `caption`. Refused are a limit that is not positive, the input for output, an
    output in another folder, an output that is there (without overwrite), and an empty result. Each line is counted
    once; the report comes last, so a manifest with a report is whole.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    source, output = source.rstrip("/"), output.rstrip("/")
    if source == output:
        raise ValueError("the input is not overwritten")
    if os.path.dirname(source) != os.path.dirname(output):
        raise ValueError("the output stays beside the input, so that relative paths hold")
    report_path = posix(output) + ".report.json"
    if not overwrite and (os.path.exists(posix(output)) or os.path.exists(report_path)):
        raise FileExistsError(output)
    counts = f"{output}.counts"
    M.manifest(spark, source).withColumn("tokens", tokens).select("line", "id", "tokens").write.mode("overwrite").parquet(counts)
    rows = spark.read.parquet(counts)
    kept, dropped = rows.where(F.col("tokens") <= limit), rows.where(F.col("tokens") > limit)
    if kept.isEmpty():
        raise ValueError("no record fits the limit")
    kept.select(F.col("line").alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(output)
    dropped.select("id", "tokens").write.mode("overwrite").parquet(f"{output}.dropped")
    summary = ST.budget_report(rows, "tokens", limit).first()
    report = {
        "created": datetime.now(UTC).isoformat(), "input": source, "input_digest": lines_digest(rows), "output": output, "output_digest": lines_digest(kept), "limit": limit,
        "records": summary["input"], "kept": summary["kept"], "dropped": summary["dropped"], "dropped_share": summary["dropped"] / summary["input"],
        "percentiles": {f"p{r['q']:g}": r["tokens"] for r in ST.percentiles_by_rank(rows, "tokens", QUANTILES).collect()} | {"max": summary["most"]},
        "histogram_128": [{"lower": r["bin"], "upper": r["bin"] + 127, "count": r["n"]} for r in ST.histogram(rows, "tokens", 128).orderBy("bin").collect()],
        "dropped_records": f"{output}.dropped",
    }
    M.write_json(report_path, report)
    return report

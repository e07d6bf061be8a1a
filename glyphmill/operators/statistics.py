"""Distribution summaries: histograms, three definitions of percentiles, budget reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.joins import running_total


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    """bin (its lower end) and n, without empty bins."""
    return df.groupBy(F.expr(f"{column} div {width} * {width}").alias("bin")).agg(F.count("*").alias("n"))


def _cumulative(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with the count up to each and the count of all; a running total over ranges of the values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    total = running_total(counts, column, F.col("c"), "cum")
    return total.join(F.broadcast(total.agg(F.max("cum").alias("n"))), F.lit(True)).select(column, "cum", "n")  # one row


def percentiles_by_rank(df: DataFrame, column: str, quantiles: tuple[float, ...]) -> DataFrame:
    """q and the value at place min(n - 1, floor(q / 100 * n)) of the sorted values."""
    wanted = F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("q")
    rows = _cumulative(df, column).select("*", wanted)
    place = F.least(F.col("n") - 1, F.floor(F.col("q") / 100 * F.col("n")))
    return rows.where(F.col("cum") > place).groupBy("q").agg(F.min(column).alias(column))


def percentiles_by_histogram(df: DataFrame, column: str, quantiles: tuple[float, ...]) -> DataFrame:
    """q and the least value whose cumulative count is beyond q / 100 * (n - 1)."""
    wanted = F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("q")
    rows = _cumulative(df, column).select("*", wanted)
    return rows.where(F.col("cum") > F.col("q") / 100 * (F.col("n") - 1)).groupBy("q").agg(F.min(column).alias(column))


def seven_numbers(df: DataFrame, column: str) -> DataFrame:
    """Count, extremes and interpolated percentiles of the non-null values."""
    names = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return df.agg(F.count(column).alias("n"), F.min(column).alias("least"), *[F.round(F.percentile(column, F.lit(q)), 6).alias(k) for k, q in names.items()], F.max(column).alias("most"))


def budget_report(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.agg(F.count("*").alias("input"), F.count_if(F.col(column) <= limit).alias("kept"), F.count_if(F.col(column) > limit).alias("dropped"), F.min(column).alias("least"), F.max(column).alias("most"))

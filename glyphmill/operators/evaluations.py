"""Summaries of benchmark judgments and of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.geometry import share_coefficient


def word_accuracy(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Micro accuracy over words, mean word similarity over all words, mean scores: overall and by group.

    rows: total_words, correct_words, word_scores (array), score and the groups. The grand total has null groups.
    """
    sums = rows.groupingSets([[], groups], *groups).agg(
        F.count("*").alias("samples"), F.sum("total_words").alias("words"), F.sum("correct_words").alias("correct"),
        F.sum(F.aggregate("word_scores", F.lit(0.0), lambda a, v: a + v)).alias("__s"), F.sum(F.size("word_scores")).alias("__n"), F.avg("score").alias("__m"),
    )
    return sums.select(
        *groups, "samples", "words", F.round(F.col("correct") / F.greatest("words", F.lit(1)), 6).alias("accuracy"),
        F.round(F.col("__s") / F.greatest("__n", F.lit(1)), 6).alias("similarity"), F.round("__m", 6).alias("score"),
    )


def prompt_summary(rows: DataFrame, prompt: str, tag: str, correct: str) -> DataFrame:
    """Images, prompts, share of correct images, share of prompts with any correct image, mean of the tags' shares."""
    by_prompt = rows.groupBy(prompt).agg(F.bool_or(correct).alias("any"), F.count("*").alias("n"), F.count_if(correct).alias("c"))
    prompts = by_prompt.agg(F.sum("n").alias("images"), F.count("*").alias("prompts"), F.round(F.sum("c") / F.sum("n"), 6).alias("image_share"), F.round(F.avg(F.col("any").cast("int")), 6).alias("prompt_share"))
    tags = rows.groupBy(tag).agg(F.avg(F.col(correct).cast("int")).alias("share")).agg(F.round(F.avg("share"), 6).alias("task_mean"))
    return prompts.crossJoin(tags)  # one row each


def category_rollup(rows: DataFrame, item: str, crop: str, l1: str, l2: str, answer: str, zeroed: str) -> DataFrame:
    """Mean item score (of the zeroed answers) at level all; category means of the last crop's own answers."""
    items = rows.groupBy(item, crop).agg(F.avg(zeroed).alias("s")).groupBy(item).agg(F.avg("s").alias("s"))
    overall = items.agg(F.avg("s").alias("mean"), F.count("*").alias("n")).select(F.lit("all").alias("level"), F.lit("all").alias("name"), F.round("mean", 6).alias("mean"), "n")
    last = rows.join(rows.groupBy(item).agg(F.max(crop).alias(crop)), [item, crop])
    out = overall
    for level, column in (("l1", l1), ("l2", l2)):
        out = out.union(last.groupBy(column).agg(F.round(F.avg(answer), 6).alias("mean"), F.count("*").alias("n")).select(F.lit(level), column, "mean", "n"))
    return out


def two_way_means(rows: DataFrame, kind: str, category: str, score: str) -> DataFrame:
    """Means by kind and category, of each margin and of all; "all" names a margin."""
    sums = rows.cube(kind, category).agg(F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("mean"), F.count(score).alias("n"))
    return sums.select(F.coalesce(kind, F.lit("all")).alias(kind), F.coalesce(category, F.lit("all")).alias(category), "mean", "n")


def gradient_summary(rows: DataFrame, group: Column, share: float = 0.4) -> DataFrame:
    """Sums of squared lengths and products by group, their cosine, log ratio and the coefficient for a share."""
    sums = rows.groupBy(group.alias("grp")).agg(F.count("*").alias("batches"), F.sum("g2").alias("g2"), F.sum("r2").alias("r2"), F.sum("d").alias("d"))
    g, r = F.sqrt("g2"), F.sqrt("r2")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("d"), g * r)))
    there = (F.col("g2") > 0) & (F.col("r2") > 0)
    return sums.select(
        "grp", "batches", F.round("g2", 4).alias("g2"), F.round("r2", 4).alias("r2"), F.round(F.when(there, cosine), 6).alias("cosine"),
        F.round(F.when(there, F.log10(F.try_divide(g, r))), 6).alias("log_ratio"), F.round(share_coefficient(F.col("g2"), F.col("r2"), F.col("d"), share), 6).alias("coefficient"),
    )


def psnr(mse: Column) -> Column:
    return -10 * F.log10(F.greatest(mse, F.lit(1e-12)))


def throughput(rows: DataFrame, rank: str, start: str, end: str, items: str) -> DataFrame:
    """Items per second of concurrent readers: all items over the time from the first start to the last end."""
    return rows.agg(F.countDistinct(rank).alias("readers"), F.sum(items).alias("items"), (F.sum(items) / (F.max(end) - F.min(start))).alias("rate"))


def reader_times(rows: DataFrame, rank: str, seconds: str) -> DataFrame:
    """Batches and interpolated p50 and p95 of the batch seconds of each reader."""
    return rows.groupBy(rank).agg(F.count("*").alias("batches"), *[F.round(F.percentile(seconds, F.lit(q)), 6).alias(k) for k, q in (("p50", 0.5), ("p95", 0.95))])


def region_loss(rows: DataFrame, weight: float = 1.0) -> DataFrame:
    """Mean squared error, the error weighted by the squared mask over all elements, and their sum.

    rows: prediction and target (arrays of channels x cells), mask (array of cells). Also the mean mask and the share of rows
    with any mask. A weight that is not finite and at least 0, and arrays that don't match, are errors.
    """
    if not 0 <= weight < float("inf"):
        raise ValueError("the weight must be finite and not negative")
    cells = F.size("mask")
    fits = (F.size("prediction") == F.size("target")) & (cells > 0) & (F.size("prediction") % cells == 0)
    rows = rows.where(F.when(fits, True).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("boolean")))
    squares = F.zip_with("prediction", "target", lambda p, t: (p.cast("double") - t) * (p.cast("double") - t))
    held = F.transform(squares, lambda d, i: d * F.get("mask", i % cells) * F.get("mask", i % cells))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    sums = rows.select(total(squares).alias("__g"), total(held).alias("__r"), F.size("prediction").alias("__n"), total(F.transform("mask", lambda m: m.cast("double"))).alias("__m"), cells.alias("__c"))
    out = sums.agg((F.sum("__g") / F.sum("__n")).alias("flow"), (F.sum("__r") / F.sum("__n")).alias("region"), (F.sum("__m") / F.sum("__c")).alias("mask_mean"), F.avg((F.col("__m") > 0).cast("double")).alias("masked_share"))
    return out.withColumn("loss", F.col("flow") + weight * F.col("region"))


def exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of rows: of the values as decimals with 18 places."""
    return F.sum(value.cast("decimal(38,18)")).cast("double")

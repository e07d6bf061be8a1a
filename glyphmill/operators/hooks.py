"""A run with overridable steps, and guards around what it publishes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.geometry import relations

Step = Callable[[DataFrame], DataFrame]


def _same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Run:
    """source, then prepare, keep, score and finish; extend gives a run with some of them replaced."""

    source: Callable[[], DataFrame]
    prepare: Step = _same
    keep: Callable[[DataFrame], object] | None = None
    score: Step = _same
    finish: Step = _same

    def extend(self, **steps: object) -> Run:
        return replace(self, **steps)

    def result(self) -> DataFrame:
        df = self.prepare(self.source())
        if self.keep is not None:
            df = df.where(self.keep(df))
        return self.finish(self.score(df))


def publishable(index: DataFrame, unreadable: DataFrame) -> DataFrame:
    """The index; an error if anything was unreadable or if the index is empty."""
    if not unreadable.isEmpty():
        raise ValueError("unreadable parts: the earlier output stays")
    if index.isEmpty():
        raise ValueError("an empty index is not published")
    return index


def reported(problems: DataFrame, order: str, most: int) -> DataFrame:
    """The first problems with whether there are more."""
    first = problems.orderBy(order).limit(most + 1)
    place = F.row_number().over(Window.orderBy(order))  # at most `most` + 1 rows
    rows = first.withColumn("__p", place).withColumn("truncated", F.max("__p").over(Window.partitionBy()) > most)
    return rows.where(F.col("__p") <= most).drop("__p")


def spec_results(detections: DataFrame, include: DataFrame, exclude: DataFrame, image: str = "image") -> DataFrame:
    """image and correct: at least `count` of each included class, fewer than `count` of each excluded one.

    detections: image, class; include and exclude: image, class, count.
    """
    found = detections.groupBy(image, "class").agg(F.count("*").alias("__n"))
    need = include.join(found, [image, "class"], "left").groupBy(image).agg(F.bool_and(F.coalesce("__n", F.lit(0)) >= F.col("count")).alias("__has"))
    bar = exclude.join(found, [image, "class"], "left").groupBy(image).agg(F.bool_or(F.coalesce("__n", F.lit(0)) >= F.col("count")).alias("__bad"))
    joined = need.join(bar, image, "full")
    return joined.select(image, (F.coalesce("__has", F.lit(True)) & ~F.coalesce("__bad", F.lit(False))).alias("correct"))


def spec_verdicts(objects: DataFrame, clauses: DataFrame, image: str = "image") -> DataFrame:
    """image and correct: whether every included clause matches and no excluded one does.

    objects: image, class, confidence, color, x0, y0, x1, y1. clauses: image, clause (its place), exclude, class, count, color,
    relation, target. An included clause matches if the image has `count` objects of the class, if as many of the `count` surest
    have the colour, and if each of these stands in the relation to each object of the target clause, which must match
    itself and come earlier. An excluded clause matches if there are `count` objects.
    """
    place = F.row_number().over(Window.partitionBy(image, "class").orderBy(F.desc("confidence"), "x0", "y0"))
    box = F.struct("x0", "y0", "x1", "y1")
    top = objects.withColumn("__place", place).select(image, "class", "__place", F.col("color").alias("__color"), box.alias("__box"))
    joined = clauses.join(top, [image, "class"], "left").where("__place IS NULL OR __place <= count")
    held = joined.groupBy(image, "clause").agg(
        F.first("exclude").alias("exclude"), F.first("count").alias("count"), F.first("color").alias("color"), F.first("relation").alias("relation"), F.first("target").alias("target"),
        F.count("__place").alias("n"), F.count_if(F.col("__color") == F.col("color")).alias("n_color"), F.collect_list("__box").alias("boxes"),
    )
    listed = held.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("clause", "exclude", "count", "color", "relation", "target", "n", "n_color", "boxes"))).alias("__c"))

    def stands(own: Column, other: Column, name: Column) -> Column:
        side = lambda b: [b["x0"], b["y0"], b["x1"], b["y1"]]
        return F.forall(own, lambda a: F.forall(other, lambda b: F.array_contains(relations(side(a), side(b)), name)))

    def step(acc: Column, c: Column) -> Column:
        enough = c["n"] >= c["count"]
        target = F.element_at(F.filter("__c", lambda d: d["clause"] == c["target"]), 1)["boxes"]
        there = F.exists(acc, lambda m: (m["clause"] == c["target"]) & m["ok"])
        included = enough & (c["color"].isNull() | (c["n_color"] >= c["count"])) & (c["relation"].isNull() | (there & F.coalesce(stands(c["boxes"], target, c["relation"]), F.lit(False))))
        ok = F.when(c["exclude"], ~enough).otherwise(included)
        return F.concat(acc, F.array(F.struct(c["clause"].cast("long").alias("clause"), F.coalesce(ok, F.lit(False)).alias("ok"))))

    start = F.expr("cast(array() as array<struct<clause: bigint, ok: boolean>>)")  # a few clauses each
    return listed.select(image, F.forall(F.aggregate("__c", start, step), lambda m: m["ok"]).alias("correct"))

"""Slots for models: captioners, readers, scorers and rewriters as injected batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.Series], pd.Series]


def apply_model(rows: DataFrame, column: str, out: str, load: Callable[[], Model], kind: str = "string", batch: int = 64) -> DataFrame:
    """rows with the model's value of a column; load runs once in each task, the model sees small batches."""

    @F.pandas_udf(kind)
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            yield pd.concat([model(values.iloc[i : i + batch]) for i in range(0, len(values), batch)] or [values.iloc[:0]])

    return rows.withColumn(out, infer(F.col(column)))


def best_matches(rows: DataFrame, word: str, candidates: str, out: str = "match", cutoff: float = 0.0) -> DataFrame:
    """rows with the candidate of the largest matching-block ratio to a word, or null."""
    import difflib

    @F.pandas_udf("string")
    def nearest(words: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([next(iter(difflib.get_close_matches(w or "", list(c) if c is not None else [], 1, cutoff)), None) for w, c in zip(words, lists, strict=True)], dtype="object")

    return rows.withColumn(out, nearest(F.col(word), F.col(candidates)))

"""Language identification: nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors.

A text's vector counts its byte trigrams (lower case, everything but letters as blanks) by hash, dampened,
weighted by inverse document frequency and normalised. Document frequencies come from all training rows;
centroids from spherical k-means over a bounded sample of FIT_ROWS rows of each language. A text takes
the language of its nearest centroid; `rejected` marks one that is farther from it than nearly all of the
centroid's training texts.

A text's score depends on the text and the model only, not on the texts beside it in a batch.

A text that is null or has no letters is `und` with score 0, as is every text when nothing can be learned.
Equal distances go to the language that sorts first. Repeated rows give repeated results, empty tables empty
ones. Very long texts are taken whole, one at a time. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import byte_slices, hash_share

DIMENSIONS = 4096
CLUSTERS = 3
#: Bound of the sample of each language (in expectation).
FIT_ROWS = 400
REJECT_QUANTILE = 0.995

SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([c if chr(c).isalpha() or c >= 128 else 32 for c in range(256)], np.uint32)
#: Dense cells of one step; texts of one step are at most this divided by DIMENSIONS.
_CELLS = 1 << 20


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray  # centroids x DIMENSIONS, normalised
    idf: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected, of each centroid


def counts(texts: list[str]) -> np.ndarray:
    """texts x DIMENSIONS: trigram counts."""
    raw = [b" " + t.lower().encode() + b"  " for t in texts]
    sizes = np.array([len(r) for r in raw])
    x = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    code = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    code = (code >> np.uint32(20)).astype(np.int64) + np.repeat(np.arange(len(texts)) * DIMENSIONS, sizes)[:-2]
    inside = np.ones(len(x), bool)  # a trigram ends in the text that it begins in
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    return np.bincount(code[inside[:-2]], minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)


def steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    for a, b in byte_slices([len(t) for t in texts]):
        for start in range(a, b, _CELLS // DIMENSIONS):
            yield start, min(b, start + _CELLS // DIMENSIONS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts(texts)) * idf).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cosines(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """texts x centroids, each row summed by itself: a matrix product's rounding depends on the number of rows."""
    return np.einsum("ij,kj->ik", v, centres)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each dimension occurs, and the number of texts; the collected table has DIMENSIONS + 1 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in steps(texts):
                total[:-1] += (counts(texts[a:b]) > 0).sum(0)
            total[-1] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(total)], names=["dim", "n"])

    found = {r["dim"]: r["n"] for r in rows.select("text").mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(i, 0) for i in range(DIMENSIONS)], float), found.get(DIMENSIONS, 0)


def clustered(v: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = v[rng.permutation(len(v))[:k]]
    for _ in range(12):
        near = (v @ centres.T).argmax(1)
        sums = np.array([v[near == j].sum(0) if (near == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, keep: Column, bound: int = FIT_ROWS, seed: int = 3) -> Centroids | None:
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & keep)
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per_lang:
        return None
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    share = F.lit(0.0)
    for lang, count in per_lang.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, bound / count))).otherwise(share)
    sample = rows.where(hash_share(seed, F.col("doc_id")) < share).orderBy("doc_id", "text").collect()  # bounded by the shares
    languages, centres, least = [], [], []
    for lang in sorted(per_lang):
        texts = [r["text"] for r in sample if r["lang"] == lang and _LETTER.search(r["text"])]
        if texts:
            v = np.concatenate([vectors(texts[a:b], idf) for a, b in steps(texts)])
            own = clustered(v, min(CLUSTERS, len(v)), seed)
            near = v @ own.T
            languages += [lang] * len(own)
            centres.append(own)
            least += [float(np.quantile(near[near.argmax(1) == j].max(1), 1 - REJECT_QUANTILE)) * 0.9 if (near.argmax(1) == j).any() else 0.0 for j in range(len(own))]
    return Centroids(languages, np.concatenate(centres), idf, np.array(least)) if languages else None


def languages(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if model is not None:
                for a, b in steps(texts):
                    cosine = cosines(vectors(texts[a:b], model.idf), model.vectors)
                    best = cosine.argmax(1)
                    for i, j in enumerate(best):
                        if _LETTER.search(texts[a + i]):
                            lang[a + i], score[a + i] = model.languages[j], min(1.0, max(0.0, float(cosine[i, j])))
                            far[a + i] = cosine[i, j] < model.least[j]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)

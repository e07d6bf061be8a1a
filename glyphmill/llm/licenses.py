"""License scans: a paragraph classifier of sparse word n-grams, and a template comparison; built-in expressions only.

A paragraph ends at a blank line, or at a line end that does not break a sentence (one after anything but a
letter, digit, comma or hyphen), so a hard-wrapped notice is one paragraph. Offsets count code points.

Weights are fitted on the driver, one lasso logistic regression per family over words and word pairs, from the
families' templates, their variants, decoys, and a bounded sample of corpus paragraphs that match no template, half
of them with an anchor word: real text that speaks of licences is what the classifier has to tell apart. Each
family's threshold is then calibrated on all documents outside the sample: over the paragraphs that score at
least 0.5, the counts by score and by agreement with the family's templates (a table of fixed size) tell from
which score on most agree. The few n-grams of non-zero weight become literals of the scan.

Scored is every paragraph that can reach a threshold: those with a gate n-gram, without which a family's bias and
positive weights stay below it (`gate`), and those with an anchor or a rights notice. A paragraph with an anchor or
a rights notice whose best probability is below its family's threshold is `unknown`; other paragraphs below it give
no row. A prediction is confirmed when enough of a template's word pairs are in the paragraph. The scan is one
projection: no shuffle, no join; starts are running sums, so its work is linear in a text's length.

Null text has no paragraphs. Documents without such paragraphs, and empty tables, give no rows; repeated rows give
repeated results. Families of equal probability: the name that sorts last. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import hash_share, let, running

# Notices of the licence families.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
        "spdx license identifier apache 2.0",
    ),
    "mit": (
        "released under the mit license",
        "this software is distributed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "spdx license identifier mit",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "spdx license identifier gpl 3.0 or later",
    ),
    "bsd": (
        "licensed under the bsd 3 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "spdx license identifier bsd 3 clause",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    ),
    "cc-by": (
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ),
}
DECOYS = (
    "the license plate of the car was missing", "she has a driving license and a permit", "no license was granted to the shop", "all rights reserved by the author of this work",
    "this work is about the general public and its software", "you may use the file at home", "the program is free of charge for any person", "version 2.0 of the report was released",
    "licensed under a private agreement between the parties", "released under pressure from the public", "subject to the terms of the contract",
)
ANCHORS = ("license", "licensed", "licenses", "licence", "licenced", "permission", "redistribution", "redistribute", "spdx")
#: A notice that names no licence.
RIGHTS = r"(?<![\p{L}\p{N}])rights[^\p{L}\p{N}]+(are[^\p{L}\p{N}]+)?reserved(?![\p{L}\p{N}])"
#: Bound (in expectation) of the corpus paragraphs that serve as negatives, half with and half without an anchor word.
FIT_PARAGRAPHS = 3000
#: Share of documents, drawn by hash, that paragraphs are sampled from; thresholds are calibrated on the others.
FIT_SHARE = 0.1
CONFIRM = 0.6
#: Bins of a logit, and the share of agreeing paragraphs that a threshold asks for.
BINS, AGREE = 4, 0.8
#: What stands between paragraphs.
BREAK = r"(?<![\p{L}\p{N},-])\n\s*+|\n[^\S\n]*+\n\s*+"
_GAP = r"[^\p{L}\p{N}.]+|[.]+(?![0-9])"


def tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w.]+|_+|[.]+(?![0-9])", text.lower()) if w]


def grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


@dataclass
class LicenseModel:
    families: list[str]
    weights: dict[str, list[float]]  # n-gram -> weight by family
    bias: list[float]
    thresholds: list[float]  # by family
    seen: dict[str, int] = field(default_factory=dict)  # n-gram -> negatives that hold it


def fit_families(negatives: list[str]) -> LicenseModel:
    families = sorted(TEMPLATES)
    texts, labels = [], []
    for k, family in enumerate(families):
        for template in TEMPLATES[family]:
            words = tokens(template)
            variants = [words, words[len(words) // 3 :], words[len(words) // 2 :], *[words[:i] + words[i + 1 :] for i in range(0, len(words), 3)], ["copyright", "2024", "the", "authors", *words], [*words, "see", "the", "file", "for", "details"]]
            texts += variants
            labels += [k] * len(variants)
    for text in [*DECOYS * 3, *negatives]:
        texts.append(tokens(text))
        labels.append(-1)
    held = [grams(t) for t in texts]
    counts: dict[str, int] = {}
    for g in held[: sum(y >= 0 for y in labels)]:
        for x in g:
            counts[x] = counts.get(x, 0) + 1
    vocabulary = sorted(g for g, n in counts.items() if n >= 3)
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)))
    for i, g in enumerate(held):
        x[i, [place[w] for w in g if w in place]] = 1
    y = np.array(labels)
    # Corpus paragraphs share hardly an n-gram with the templates: equal rows count once, by number.
    x, number = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    x, y = x[:, :-1], x[:, -1]
    share = np.minimum(number, 50) / np.minimum(number, 50).sum()
    own = (y[:, None] == np.arange(len(families))).astype(float)
    balance = np.where(own > 0, 0.5 / np.maximum(share @ own, 1e-9), 0.5 / np.maximum(share @ (1 - own), 1e-9)) * share[:, None]
    weights, bias = _lasso(x, own, balance)
    kept = {g: [float(v) for v in weights[i]] for g, i in place.items() if np.abs(weights[i]).max() > 1e-3}
    seen = {g: sum(g in h for h in held[-len(negatives) :]) for g in kept} if negatives else {}
    return LicenseModel(families, kept, [float(b) for b in bias], [0.5] * len(families), seen)


def _lasso(x: np.ndarray, own: np.ndarray, balance: np.ndarray, lasso: float = 2e-4, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of all families at once, by accelerated proximal gradient steps."""
    z = np.column_stack([x, np.ones(len(x))])
    step = 4.0 / z.sum(1).max()
    w = look = np.vstack([np.zeros((x.shape[1], own.shape[1])), np.full((1, own.shape[1]), -2.0)])
    t = 1.0
    for _ in range(steps):
        new = look + step * (z.T @ (balance * (own - 1 / (1 + np.exp(-(z @ look))))))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * lasso, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], w[-1]


def _similarity(pairs: Column, family: str) -> Column:
    """The largest share of a template's word pairs that are among the pairs."""
    found = [sorted({f"{a} {b}" for a, b in zip(tokens(t), tokens(t)[1:], strict=False)}) for t in TEMPLATES[family]]
    return F.greatest(*[F.size(F.array_intersect(pairs, F.array(*map(F.lit, own)))) / len(own) for own in found], F.lit(0.0))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _GAP), lambda w: w != "")


def _pairs(words: Column) -> Column:
    listed = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(2)), " "))
    return F.array_distinct(F.when(F.size(words) >= 2, listed).otherwise(F.expr("cast(array() as array<string>)")))


def paragraphs(text: Column) -> Column:
    """array<struct<text, number, start>> of a text's paragraphs, blank ones included."""
    pieces, breaks = F.split(text, BREAK), F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))

    def placed(p: Column) -> Column:
        steps = F.zip_with(p, breaks, lambda a, b: F.char_length(a) + F.coalesce(F.char_length(b), F.lit(0)))
        return let(running(steps), lambda start: F.transform(p, lambda x, i: F.struct(x.alias("text"), i.alias("number"), F.get(start, i).alias("start"))))

    return let(pieces, placed)


def negatives(docs: DataFrame, bound: int = FIT_PARAGRAPHS, seed: int = 9) -> list[str]:
    """Sampled paragraphs that match no template: about half the bound with an anchor, half without."""
    held = docs.where(hash_share(seed, F.col("doc_id")) < FIT_SHARE).select(F.col("text").cast("string").alias("text"))
    rows = held.select(F.explode(F.split("text", BREAK)).alias("text")).where(F.trim("text") != "").withColumn("named", _named(F.col("text")))
    sizes = {r["named"]: r["n"] for r in rows.groupBy("named").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for named, n in sizes.items():
        share = F.when(F.col("named") == named, F.lit(min(1.0, bound / 2 / n))).otherwise(share)
    rows = rows.where(hash_share(seed + 1, F.col("text")) < share)
    alike = let(_words(F.col("text")), lambda w: let(_pairs(w), lambda p: F.greatest(*[_similarity(p, f) for f in TEMPLATES])))
    return sorted(r["text"] for r in rows.where(alike < CONFIRM).select(F.substring("text", 1, 4000).alias("text")).collect())  # bounded by the shares


def calibrated(docs: DataFrame, model: LicenseModel, seed: int = 9) -> LicenseModel:
    """The model with each family's threshold: the least score from which on at least AGREE of the paragraphs agree with a template."""
    rows = _scored(docs.where(~(hash_share(seed, F.col("doc_id")) < FIT_SHARE)), model).where("probability >= 0.5")
    logit = F.log(F.col("probability") / (1 - F.least("probability", F.lit(1 - 1e-9))))
    counts = rows.groupBy("family", F.least(F.floor(logit * BINS), F.lit(20 * BINS)).cast("int").alias("bin"), (F.col("similarity") >= CONFIRM).alias("agrees")).agg(F.count("*").alias("n"))
    found: dict[str, dict[int, list[int]]] = {}
    for r in counts.collect():  # families x bins x 2 rows at most
        found.setdefault(r["family"], {}).setdefault(r["bin"], [0, 0])[int(r["agrees"])] += r["n"]
    for k, family in enumerate(model.families):
        yes = no = 0
        edge = None
        for b in sorted(found.get(family, {}), reverse=True):
            no, yes = no + found[family][b][0], yes + found[family][b][1]
            if (yes + 1) / (yes + no + 1) >= AGREE:  # one agreeing paragraph is assumed
                edge = b
        if edge is None and found.get(family):
            edge = max(found[family]) + 1  # none agrees: above what was seen
        model.thresholds[k] = min(0.9, max(0.5, 1 / (1 + float(np.exp(-(edge or 0) / BINS)))))
    return model


def fit(docs: DataFrame, seed: int = 9) -> LicenseModel:
    docs = docs.select("doc_id", "text")
    return calibrated(docs, fit_families(negatives(docs, seed=seed)), seed)


def gate(model: LicenseModel) -> list[str] | None:
    """n-grams of which every paragraph that reaches the threshold holds one; None if it takes no n-gram to reach it.

    Those left out, per family, add up to less than the threshold: the ones that most negatives hold for their weight.
    """
    needed = set()
    for k, most in enumerate(model.bias):
        limit = float(np.log(model.thresholds[k] / (1 - model.thresholds[k]))) - 1e-6
        if most >= limit:
            return None
        positive = sorted(((model.seen.get(g, 0) / w[k], -w[k], g) for g, w in model.weights.items() if w[k] > 0), key=lambda x: (-x[0], -x[1], x[2]))
        for _, weight, gram in positive:
            if most - weight < limit:
                most -= weight
            else:
                needed.add(gram)
    return sorted(needed)


def _anchor_pattern() -> str:
    return "(?<![a-z])(" + "|".join(ANCHORS) + ")(?![a-z])"


def _grams_pattern(found: list[str]) -> str:
    """Matches each lower-case text that holds one of the n-grams (and some more); common beginnings are tried once."""
    tree: dict = {}
    for gram in found:
        node = tree
        for c in gram:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [c and (r"[^\p{L}\p{N}]+" if c == " " else re.escape(c)) + written(n) for c, n in sorted(node.items(), reverse=True)]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return r"(?<![\p{L}\p{N}])" + written(tree) + r"(?![\p{L}\p{N}])"


def _named(text: Column) -> Column:
    """Whether a paragraph speaks of a licence or of rights."""
    return F.lower(text).rlike(_anchor_pattern()) | F.lower(text).rlike(RIGHTS)


def _candidate(text: Column, model: LicenseModel) -> Column:
    found = gate(model)
    if found is None:
        return F.lit(True)
    return _named(text) | F.lower(text).rlike(_grams_pattern(found)) if found else _named(text)


def _sum(found: Column, table: Column, k: int) -> Column:
    return F.aggregate(found, F.lit(0.0), lambda acc, g: acc + F.coalesce(F.get(table[g], F.lit(k)), F.lit(0.0)))


def _scored(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, paragraph, start, end, named, family (the likeliest), probability and similarity of each paragraph that can reach a threshold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(_candidate(F.col("text"), model))
    picked = F.filter(paragraphs(F.col("text")), lambda p: (F.trim(p["text"]) != "") & _candidate(p["text"], model))
    rows = rows.select("doc_id", F.explode(picked).alias("p"))
    end = F.col("p.start") + F.char_length("p.text")
    rows = rows.select("doc_id", F.col("p.number").alias("paragraph"), F.col("p.start").alias("start"), end.alias("end"), _words(F.col("p.text")).alias("words"), _named(F.col("p.text")).alias("named"))
    rows = rows.withColumn("pairs", _pairs(F.col("words")))
    known = sorted(model.weights)
    rows = rows.withColumn("found", F.filter(F.array_union("words", "pairs"), lambda g: g.isin(known)))
    table = F.create_map(*[x for g in known for x in (F.lit(g), F.array(*[F.lit(v) for v in model.weights[g]]))])
    chances = F.array(*[F.struct((1 / (1 + F.exp(-(_sum(F.col("found"), table, k) + model.bias[k])))).alias("probability"), F.lit(f).alias("family")) for k, f in enumerate(model.families)])
    rows = rows.withColumn("best", F.array_max(chances))
    similar = F.lit(0.0)
    for family in TEMPLATES:
        similar = F.when(F.col("best.family") == family, _similarity(F.col("pairs"), family)).otherwise(similar)
    row = F.struct("doc_id", "paragraph", "start", "end", "named", F.col("best.family").alias("family"), F.col("best.probability").alias("probability"), similar.alias("similarity"))
    # A generator, so that no filter goes below the projections: there it would compute the scores again for each use.
    return rows.select(F.explode(F.array(row)).alias("r")).select("r.*")


def license_paragraphs(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, paragraph (its number), start, end, family, probability, similarity, confirmed of each paragraph of a family or `unknown`."""
    threshold = F.lit(1.0)
    for family, t in zip(model.families, model.thresholds, strict=True):
        threshold = F.when(F.col("family") == family, F.lit(t)).otherwise(threshold)
    sure = F.col("probability") >= threshold
    rows = _scored(docs, model).where(sure | F.col("named"))
    similarity = F.when(sure, F.col("similarity")).otherwise(F.lit(0.0))
    family = F.when(sure, F.col("family")).otherwise(F.lit("unknown"))
    return rows.select("doc_id", "paragraph", "start", "end", family.alias("family"), "probability", similarity.alias("similarity"), (sure & (F.col("similarity") >= CONFIRM)).alias("confirmed"))

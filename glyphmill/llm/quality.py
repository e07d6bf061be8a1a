"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Column expressions.

Statistics are built-in expressions. Boosted shallow trees are grown on a bounded sample of labelled
rows; each path from a root is a conjunctive rule; a lasso logistic regression keeps few rules with
weights; the kept rules and weights are one Column. Scoring is therefore one projection over the
documents: no join, no shuffle, no Python.

Null text counts as empty. Without labels, or with labels of one kind only, each score is 0.5 and
each prediction 1; a score of exactly 0.5 is predicted 1. Contradicting labels of one id are settled by the
larger. Repeated rows give repeated results, empty tables empty ones; very long texts are scored whole. Extra
columns are ignored (quality_scores) or kept whatever their names (with_quality).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import fresh, sampled_labels

#: Bound of the labelled sample that the classifier is fitted on (in expectation; both labels equally).
FIT_ROWS = 12_000

Rule = tuple[tuple[str, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chars = F.char_length(t)
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    symbols = F.regexp_count(t, F.lit(r"[^\p{L}\p{M}\p{N}\s.,]"))
    return {
        "chars": chars.cast("double"),
        "words": F.size(words).cast("double"),
        "word_chars": per(chars, F.size(words)),
        "distinct": per(F.size(F.array_distinct(words)), F.size(words)),
        "symbols": per(symbols, chars),
        "upper": per(F.regexp_count(t, F.lit(r"\p{Lu}")), chars),
        "digits": per(F.regexp_count(t, F.lit("[0-9]")), chars),
        "stops": per(F.regexp_count(t, F.lit("[.]")), F.size(words)),
        "lines": per(F.regexp_count(t, F.lit("\n")) + 1, F.size(words)),
    }


STATISTICS = ("chars", "words", "word_chars", "distinct", "symbols", "upper", "digits", "stops", "lines")


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def margin(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            hit = F.lit(True)
            for name, op, value in rule:
                hit = hit & (F.col(name) <= float(value) if op == "<=" else F.col(name) > float(value))
            total = total + F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))
        return total

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        m = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            m += weight * rule_hits(rule, x)
        return 1 / (1 + np.exp(-m))


def rule_hits(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, op, value in rule:
        column = x[:, STATISTICS.index(name)]
        hit &= column <= value if op == "<=" else column > value
    return hit


def tree_rules(x: np.ndarray, grad: np.ndarray, depth: int, cuts: list[np.ndarray], path: Rule = ()) -> tuple[list[Rule], np.ndarray]:
    """Rules of the nodes of a regression tree on grad, and the tree's fitted values."""
    value = np.full(len(x), grad.mean() if len(grad) else 0.0)
    if depth == 0 or len(x) < 40:
        return [], value
    best = (1e-9, -1, 0.0)
    total, n = grad.sum(), len(grad)
    for j in range(x.shape[1]):
        place = np.searchsorted(cuts[j], x[:, j], side="left")  # x <= cuts[k] exactly for place <= k
        sums = np.cumsum(np.bincount(place, grad, len(cuts[j]) + 1))[:-1]
        counts = np.cumsum(np.bincount(place, minlength=len(cuts[j]) + 1))[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((counts >= 15) & (n - counts >= 15), sums**2 / counts + (total - sums) ** 2 / (n - counts) - total**2 / n, 0)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), j, float(cuts[j][gain.argmax()]))
    if best[1] < 0:
        return [], value
    _, j, cut = best
    left = x[:, j] <= cut
    rules = []
    for side, op in ((left, "<="), (~left, ">")):
        rule = (*path, (STATISTICS[j], op, cut))
        more, value[side] = tree_rules(x[side], grad[side], depth - 1, cuts, rule)
        rules += [rule, *more]
    return rules, value


def simplified(rule: Rule) -> Rule:
    """One bound for each statistic and side: the tightest."""
    low, high = {}, {}
    for name, op, value in rule:
        if op == "<=":
            high[name] = min(value, high.get(name, np.inf))
        else:
            low[name] = max(value, low.get(name, -np.inf))
    return tuple(sorted([(k, "<=", v) for k, v in high.items()] + [(k, ">", v) for k, v in low.items()]))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, most: int = 40) -> RuleEnsemble:
    """Rules from boosted trees, then lasso logistic weights by proximal gradient steps."""
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble()
    cuts = [np.unique(np.quantile(column, np.linspace(0.005, 0.995, 100))) for column in x.T]
    margin, rules = np.zeros(len(y)), []
    for _ in range(trees):
        found, value = tree_rules(x, y - 1 / (1 + np.exp(-margin)), depth, cuts)
        margin += 1.5 * value
        rules += found
    rules = sorted(set(map(simplified, rules)))
    hits = np.array([rule_hits(r, x) for r in rules], float).T
    step, n = 4.0 / max(1.0, (hits.sum(1) + 1).max()), len(y)
    for lasso in (0.002, 0.004, 0.008, 0.016, 0.03):
        w, b = np.zeros(len(rules)), 0.0
        for _ in range(600):
            error = y - 1 / (1 + np.exp(-(hits @ w + b)))
            w += step * (hits.T @ error) / n
            w = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0)
            b += step * error.mean()
        if (w != 0).sum() <= most:
            break
    kept = np.flatnonzero(w)
    return RuleEnsemble(float(b), [rules[i] for i in kept], [float(w[i]) for i in kept])


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column, bound: int = FIT_ROWS, seed: int = 10) -> RuleEnsemble:
    """Fit on about `bound` labelled rows at most; keep says which ids may be learned from."""
    sample, counts = sampled_labels(labels, "quality", bound, seed, keep)
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stats.join(F.broadcast(sample), "doc_id")  # bounded by the sample
    rows = rows.select("doc_id", "label", *[c.alias(k) for k, c in statistics(F.col("text")).items()]).toPandas()
    rows = rows.sort_values(["doc_id", *STATISTICS], ignore_index=True)
    y = rows["label"].to_numpy(float)
    model = fit_rules(rows[list(STATISTICS)].to_numpy(float), y)
    if model.rules:  # the sample has other shares of the labels than the corpus
        model.intercept += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def quality_scores(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, score and predicted of every row."""
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in statistics(F.col("text").cast("string")).items()])
    scored = stats.select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_quality(docs: DataFrame, model: RuleEnsemble, name: str = "__quality") -> DataFrame:
    """docs with a struct column of this (new) name, score and predicted, beside its own columns."""
    names = {k: fresh(docs, f"{name}_{k}") for k in STATISTICS}
    renamed = RuleEnsemble(model.intercept, [tuple((names[n], op, v) for n, op, v in r) for r in model.rules], model.weights)
    score = renamed.score()
    out = docs.withColumns({names[k]: c for k, c in statistics(F.col("text").cast("string")).items()})
    return out.withColumn(name, F.struct(score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))).drop(*names.values())

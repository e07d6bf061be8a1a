"""Personal data: labelers vote on candidate spans, EM weighs them, a classifier decides; built-in expressions only.

Base spans (email, ip, card, phone) are exact patterns with their checks and always stay. Further candidates
are what matches a base pattern but fails its check, spelled-out emails, phones without a plus sign, and
mixed tokens that may be secrets. For each candidate a regex, a gazetteer and a context labeler vote. The
counts of vote and feature patterns over all documents are a table of fixed size (families x votes x
features), from which expectation-maximisation estimates each labeler's reliability and each family's share
of true spans; PRIOR pseudo-spans of either side keep the estimate defined where a kind is rare. One logistic
classifier of votes and span features (length, variety, switches between letters and digits, assignment) for
each kind is fitted to the posteriors, both sides weighing the same, and compiled into the projection that
scores candidates. Further candidates of probability 0.5 or more that overlap no base span are added; the
others, near misses among them, are not.

Work is linear in a text's length, and nearly so in its spans: offsets and ends are running sums and maxima by
blocks, context comes from the gap before a match, overlaps from a binary search in each base family's spans,
and redaction cuts from blocks of the text. Patterns are possessive and anchored at the start of a run, so long
runs are scanned once.

Null text counts as empty (redacted, it stays null). Empty tables give empty ones. Repeated rows give repeated
results. Ties cannot arise: spans are ordered by kind, start and end. Extra columns are ignored, or kept by
redacted().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import BLOCK, fresh, let, running

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

_LOCAL = r"A-Za-z0-9._%+-"
#: Equal to the plain patterns: a run is entered at its start, or where the last match ended.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED_EMAIL = rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++\x20?[\[(]dot[\])]\x20?[A-Za-z]{{2,12}}"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{12,128}+(?![A-Za-z0-9])"

#: family, kind, pattern, the test that lets the pattern be skipped
BASE_FAMILIES = (
    ("email", "email", EMAIL, "@"),
    ("ip", "ip", IP, "[0-9]"),
    ("card", "card", CARD, "[0-9]"),
    ("phone", "phone", PHONE, r"\+"),
)
MORE_FAMILIES = (
    ("spelled_email", "email", SPELLED_EMAIL, r"[\[(]at[\])]"),
    ("local_phone", "phone", LOCAL_PHONE, "[0-9]"),
    ("secret", "secret", SECRET, "[0-9]"),
)

# Gazetteers: fixed values.
TOP_DOMAINS = "com org net edu gov io info biz eu de fr es uk us ca ch at it nl pl pt"
CARD_PREFIXES = "^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
COUNTRY_CODES = r"^\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[126]|9[0-58])"
SECRET_PREFIXES = "^(AKIA|ASIA|ghp|gho|sk|pk|xox|AIza)"
RESERVED_IP = r"^(0|10|127|2[2-5][0-9])\.|^192\.168\.|^169\.254\."
CUES = {
    "email": "(mail|contact|write|send|to)",
    "ip": "(ip|host|server|addr|from|node)",
    "card": "(card|visa|credit|pay|account|master)",
    "phone": "(tel|phone|call|fax|mobile|dial)",
    "secret": "(token|password|secret|key|pwd|auth|api)",
}
CONTEXT = 24
#: Pseudo-spans of each kind that all labelers call true, and as many that all call false.
PRIOR = 4.0
VOTES, FEATURES = ("v1", "v2", "v3"), ("long", "varied", "mixed", "assigned")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, before, start, end>> of the pattern's matches; code points, end exclusive; before ends the gap before it."""
    p = F.lit(pattern)

    def build(pair: Column) -> Column:
        pieces = F.split(pair["t"], pattern)
        gaps = F.transform(pieces, lambda s: F.char_length(s))
        lengths = F.transform(pair["m"], lambda m: F.char_length(m))

        def spans(start: Column) -> Column:
            near = F.transform(pieces, lambda g: F.right(g, F.lit(CONTEXT)))
            return let(near, lambda g: F.transform(pair["m"], lambda m, i: F.struct(m.alias("m"), F.get(g, i).alias("before"), F.get(start, i).alias("start"), (F.get(start, i) + F.char_length(m)).alias("end"))))

        # Match i starts after the gaps 0..i and the matches before it.
        steps = F.zip_with(gaps, lengths, lambda g, n: g + F.coalesce(n, F.lit(0)))
        return let(F.zip_with(running(steps), gaps, lambda r, g: r + g), spans)

    found = let(F.struct(text.alias("t"), F.regexp_extract_all(text, p, F.lit(0)).alias("m")), lambda pair: F.when(F.size(pair["m"]) > 0, build(pair)))
    return found


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def valid(family: str, m: Column) -> Column:
    """A base family's own check."""
    if family == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if family == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if family == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def votes(family: str, kind: str, m: Column, before: Column) -> tuple[Column, Column, Column]:
    """The regex, gazetteer and context labelers' votes on a match."""
    if kind == "email":
        shape = m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}$") if family == "email" else m.rlike(r"^[A-Za-z0-9]")
        known = F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1)).isin(*TOP_DOMAINS.split())
    elif kind == "ip":
        shape, known = valid("ip", m) & ~m.rlike(r"(^|\.)0[0-9]"), ~m.rlike(RESERVED_IP)
    elif kind == "card":
        shape, known = valid("card", m) & F.length(_digits(m)).isin(14, 15, 16), _digits(m).rlike(CARD_PREFIXES)
    elif family == "local_phone":
        shape, known = ~m.rlike(r"\.") & m.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20-][2-9]"), ~m.rlike(r"^\(?([01]|[2-9]11)")
    elif kind == "phone":
        shape, known = valid("phone", m) & m.rlike(r"[\x20().-]"), m.rlike(COUNTRY_CODES)
    else:
        shape, known = m.rlike("^([0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{20})$"), m.rlike(SECRET_PREFIXES)
    return shape, known, F.lower(before).rlike(CUES[kind])


def features(m: Column, before: Column) -> tuple[Column, ...]:
    """Whether the match is long, of many different characters, often switches between letters and digits, and is assigned."""
    distinct = F.size(F.array_distinct(F.split(F.substring(m, 1, 128), "")))
    return F.char_length(m) > 18, distinct >= 10, F.regexp_count(m, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")) >= 4, before.rlike("[\"'=:]\\s*$")


_SPAN = "struct<family: string, kind: string, rank: int, start: int, `end`: int, base: boolean, v1: int, v2: int, v3: int, long: int, varied: int, mixed: int, assigned: int>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _described(family: str, kind: str, base: Column) -> Callable[[Column], Column]:
    def span(s: Column) -> Column:
        own = [*zip(VOTES, votes(family, kind, s["m"], s["before"]), strict=True), *zip(FEATURES, features(s["m"], s["before"]), strict=True)]
        return F.struct(
            F.lit(family).alias("family"), F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"),
            *[F.coalesce(x, F.lit(False)).cast("int").alias(n) for n, x in own],
        )

    return span


def overlapped(spans: Column, s: Column) -> Column:
    """Whether s overlaps one of spans, which are disjoint and sorted: the last that begins before s ends must end after s begins."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        left = F.get(spans, middle)["start"] < s["end"]
        return F.when(acc["low"] >= acc["high"], acc).otherwise(F.struct(F.when(left, middle + 1).otherwise(acc["low"]).alias("low"), F.when(left, acc["high"]).otherwise(middle).alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    begun = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda acc: acc["low"])
    return F.coalesce(F.get(spans, begun - 1)["end"] > s["start"], F.lit(False))


def candidates(text: Column) -> Column:
    """array of _SPAN of all families: all base spans, and the candidates that overlap none."""
    base, more = [], []
    for family, kind, pattern, gate in (*BASE_FAMILIES, *MORE_FAMILIES):
        found = F.when(text.contains("@") if gate == "@" else text.rlike(gate), matches(text, pattern))
        if family in BASE_KINDS:
            pair = let(found, _parted(family, kind))
            base.append(F.coalesce(pair["good"], F.expr(_NONE)))
            more.append(F.coalesce(pair["bad"], F.expr(_NONE)))
        else:
            more.append(F.coalesce(F.transform(found, _described(family, kind, F.lit(False))), F.expr(_NONE)))

    def free(lists: Column) -> Column:
        clear = lambda s: ~(overlapped(lists["b0"], s) | overlapped(lists["b1"], s) | overlapped(lists["b2"], s) | overlapped(lists["b3"], s))
        own = F.concat(*[lists[f"b{i}"] for i in range(len(base))])
        return F.when(F.size(lists["more"]) == 0, own).otherwise(F.concat(own, F.filter(lists["more"], clear)))

    return let(F.struct(*[b.alias(f"b{i}") for i, b in enumerate(base)], F.concat(*more).alias("more")), free)


def _parted(family: str, kind: str) -> Callable[[Column], Column]:
    """The matches that pass the family's check, and those that fail it, as candidates of the family <family>_like."""
    good, bad = _described(family, kind, F.lit(True)), _described(f"{family}_like", kind, F.lit(False))

    def parted(found: Column) -> Column:
        ok = F.filter(found, lambda s: valid(family, s["m"]))
        fails = F.expr(_NONE) if family == "email" else F.transform(F.filter(found, lambda s: ~valid(family, s["m"])), bad)
        return F.struct(F.transform(ok, good).alias("good"), fails.alias("bad"))

    return parted


@dataclass
class SpanModel:
    """Reliabilities (families' shares of true spans; P(vote | true) and P(vote | false) by kind and labeler) and classifiers.

    weights has the bias and the weights of VOTES and FEATURES of each kind.
    """

    priors: dict[str, float]
    hits: dict[str, tuple[float, ...]]
    slips: dict[str, tuple[float, ...]]
    weights: dict[str, tuple[float, ...]]

    def probability(self, s: Column) -> Column:
        total = F.lit(-20.0)  # a kind that no candidate had
        for kind, (bias, *weights) in self.weights.items():
            own = F.lit(bias)
            for name, w in zip((*VOTES, *FEATURES), weights, strict=True):
                own = own + F.lit(w) * s[name]
            total = F.when(s["kind"] == kind, own).otherwise(total)
        return 1 / (1 + F.exp(-total))


def fit_spans(counts: list[tuple]) -> SpanModel:
    """EM over counts of (family, kind, *votes, *features, n), then logistic fits to the posteriors."""
    m = len(VOTES)
    pseudo = [(f"prior {side}", kind, *[side] * m, *[None] * len(FEATURES), PRIOR) for kind in KINDS for side in (0, 1)]
    rows = [*sorted(tuple(c) for c in counts), *pseudo]
    family, kind = [r[0] for r in rows], np.array([KINDS.index(r[1]) for r in rows])
    v, n = np.array([r[2 : 2 + m] for r in rows], float), np.array([r[-1] for r in rows], float)
    place = {f: i for i, f in enumerate(sorted(set(zip(family, kind.tolist(), strict=True))))}
    fam = np.array([place[f, k] for f, k in zip(family, kind.tolist(), strict=True)])
    fixed = np.array([{"prior 0": 0.05, "prior 1": 0.95}.get(f, np.nan) for f in family])
    q = np.where(np.isnan(fixed), (v.sum(1) + 0.5) / (m + 1), fixed)  # votes counted, to begin with
    hit, slip = np.full((len(KINDS), m), 0.8), np.full((len(KINDS), m), 0.2)
    for _ in range(100):
        for k in range(len(KINDS)):
            own = kind == k
            hit[k] = ((n * q)[own] @ v[own] + 2 * 0.8) / ((n * q)[own].sum() + 2)
            slip[k] = ((n * (1 - q))[own] @ v[own] + 2 * 0.2) / ((n * (1 - q))[own].sum() + 2)
        hit, slip = np.clip(hit, 0.02, 0.98), np.clip(slip, 0.02, 0.98)
        prior = np.array([((n * q)[fam == f].sum() + 1) / (n[fam == f].sum() + 2) for f in range(len(place))])
        log1 = np.log(prior[fam]) + (v * np.log(hit[kind]) + (1 - v) * np.log(1 - hit[kind])).sum(1)
        log0 = np.log1p(-prior[fam]) + (v * np.log(slip[kind]) + (1 - v) * np.log(1 - slip[kind])).sum(1)
        q = np.where(np.isnan(fixed), 1 / (1 + np.exp(np.clip(log0 - log1, -30, 30))), fixed)
    weights = {}
    for k, name in enumerate(KINDS):
        own = [i for i in np.flatnonzero(kind == k)]
        # A pseudo-span's features are those of its side: all or none.
        x = np.array([[*rows[i][2 : 2 + m], *[rows[i][2] if f is None else f for f in rows[i][2 + m : -1]]] for i in own], float)
        weights[name] = tuple(map(float, _balanced_logistic(x, q[own], n[own])))
    return SpanModel(
        {f"{f} {KINDS[k]}" if f.startswith("prior") else f: float(prior[i]) for (f, k), i in place.items()},
        {k: tuple(map(float, hit[i])) for i, k in enumerate(KINDS)}, {k: tuple(map(float, slip[i])) for i, k in enumerate(KINDS)}, weights,
    )


def _balanced_logistic(x: np.ndarray, q: np.ndarray, n: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Bias and weights; the true and the false side weigh the same, however rare."""
    z = np.column_stack([np.ones(len(x)), x])
    yes, no = n * q / (n * q).sum(), n * (1 - q) / (n * (1 - q)).sum()
    keep = np.r_[1e-4, np.full(x.shape[1], ridge)]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (yes * (1 - p) - no * p) - keep * w
        hessian = (z * ((yes + no) * p * (1 - p))[:, None]).T @ z + np.diag(keep)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def vote_counts(docs: DataFrame) -> DataFrame:
    """How often each vote pattern occurs in the corpus: a table whose size does not depend on it."""
    spans = docs.select(F.explode(candidates(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("s"))
    return spans.groupBy("s.family", "s.kind", *[f"s.{c}" for c in (*VOTES, *FEATURES)]).agg(F.count("*").alias("n"))


def fit(docs: DataFrame) -> SpanModel:
    return fit_spans([tuple(r) for r in vote_counts(docs).collect()])


def with_spans(docs: DataFrame, model: SpanModel, name: str = "__spans") -> DataFrame:
    """docs with a column of this (new) name: array<struct<rank, start, end, kind, base, probability>>, sorted."""
    every = fresh(docs, f"{name}_all")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), model.probability(s).alias("probability"))
    rows = docs.withColumn(every, candidates(text)).withColumn(every, F.when(F.size(every) > 0, F.transform(every, out)))
    empty = F.expr("cast(array() as array<struct<rank: int, start: int, `end`: int, kind: string, base: boolean, probability: double>>)")
    return rows.withColumn(name, F.coalesce(F.array_sort(F.filter(every, lambda s: s["base"] | (s["probability"] >= 0.5))), empty)).drop(every)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    n_chars, where docs has it, follows the new text. A null text stays null.
    """
    name, blocks = fresh(docs, "__spans"), fresh(docs, "__blocks")
    rows = with_spans(docs, model, name)
    pair = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    rows = rows.withColumn(name, F.array_sort(F.transform(name, pair)))
    # Blocks of the text, so that a piece is cut from the blocks that it lies in.
    pieces = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    rows = rows.withColumn(blocks, F.when(F.size(name) > 0, pieces))

    def cut(start: Column, size: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        many = F.floor((start % BLOCK + size) / BLOCK).cast("int") + 1
        return F.when(size > 0, F.substring(F.array_join(F.slice(blocks, first + 1, many), ""), start % BLOCK + 1, size)).otherwise(F.lit(""))

    def clean(done: Column) -> Column:
        # done[i]: how far the spans before span i reach. A span that begins before that adds no name of its own.
        def piece(s: Column, i: Column) -> Column:
            label = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.concat(cut(F.get(done, i), s["start"] - F.get(done, i)), F.when(s["start"] >= F.get(done, i), label).otherwise(F.lit("")))

        last = F.element_at(done, -1)
        return F.concat(F.array_join(F.transform(name, piece), ""), cut(last, F.size(blocks) * BLOCK - last))

    text = F.when(F.size(name) > 0, let(running(F.transform(name, lambda s: s["end"]), largest=True), clean)).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).drop(name, blocks)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def report(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, all spans, their number, and whether there are any, of every row."""
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).drop("text")
    rows = rows.withColumn("__base", F.filter("__spans", lambda s: s["base"]))
    counts = [F.size(F.filter("__base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"), F.size("__spans").cast("long").alias("n_spans"), (F.size("__spans") > 0).alias("found"))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind

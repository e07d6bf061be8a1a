"""Mixing sources to target weights: hierarchical budgets and seeded token-prefixes, built-in expressions only.

The tree is domain, language, source. A node's budget is divided among its children in proportion to
their weights; a child that holds less than its share (all its tokens times max_epochs) takes what it
holds, and its shortage goes to its siblings; only what a whole family can't take is left to the
parent's siblings, because a family's capacity bounds what its parent is given. Shares are whole
tokens, rounded down.

A leaf's budget is spent in epochs. Each epoch orders the leaf's documents by md5 of (seed, epoch,
doc_id). Whole epochs take every document; the last takes the longest prefix whose tokens fit. A leaf
may hold a third of all rows, so the order is never built in one task: sums of 256 ranges of the md5, then
of 256 parts of one of them, give the one part in which the prefix ends, and only its rows meet in a window.

Tokens are words between white space. A document without words is never chosen; a null language or
source is a node named "none"; weights of nodes that are not named are 1; a weight of 0 excludes a
node. Repeated rows with one id come or stay together. An empty table gives an empty mix. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import WORD_RE, written

LEVELS = ("domain", "lang", "source")
#: Leaves whose plan is broadcast; with more, it is joined by shuffle.
BROADCAST_LEAVES = 200_000
#: Hexadecimal digits of an order key by which the end of a prefix is narrowed down.
RANGE_DIGITS = (2, 4)


@dataclass
class MixPlan:
    budget: int | None = None  # tokens; None: `share_of_all` of all tokens
    share_percent: int = 60
    max_epochs: int = 3
    seed: int = 7
    weights: dict[str, dict[str, int]] = field(default_factory=dict)  # by level and node name


#: Weights of the registered query: four domains, four languages; sources are equal.
PRODUCTION = MixPlan(weights={"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}})


def domain_of(source: Column) -> Column:
    """d0 to d3 by the source's final number; other sources are in the domain none."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))).otherwise(F.lit("none"))


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, the tree's columns and the number of tokens."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(domain_of(F.col("source")), F.lit("none")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD_RE)).cast("long").alias("n_tokens"),
    ).where("n_tokens > 0")


def _weight(level: str, plan: MixPlan) -> Column:
    out = F.lit(1).cast("long")
    for name, weight in plan.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(weight)).cast("long")).otherwise(out)
    return out


def divide(children: DataFrame, family: list[str], node: str) -> DataFrame:
    """children (family, node, weight, cap, given) with the budget of each; given is the family's budget.

    In order of cap / weight, a child is full as long as cap <= weight * rest / rest of the weights.
    """
    order = Window.partitionBy(*family).orderBy(F.col("cap") / F.col("weight"), F.col(node))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*family)
    rows = children.where("weight > 0").withColumns(
        {
            "__rest": F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "__weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    rows = rows.withColumn("__full", F.expr("cap * __weights <= weight * __rest"))
    rows = rows.withColumns(
        {
            "__left": F.col("given") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("cap"))).over(whole), F.lit(0)),
            "__open": F.coalesce(F.sum(F.when(~F.col("__full"), F.col("weight"))).over(whole), F.lit(0)),
        }
    )
    budget = F.when(F.col("__full"), F.col("cap")).otherwise(F.expr("(weight * __left) div __open"))
    return rows.withColumn("budget", budget).drop("__rest", "__weights", "__full", "__left", "__open", "given", "weight", "cap")


def leaf_budgets(rows: DataFrame, plan: MixPlan) -> DataFrame:
    """domain, lang, source, tokens and budget of each leaf; as many rows as leaves."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    for level in LEVELS:
        leaves = leaves.withColumn(f"w_{level}", _weight(level, plan))
    # A node of weight 0 holds nothing for its ancestors.
    leaves = leaves.where("w_domain > 0 AND w_lang > 0 AND w_source > 0").withColumn("cap", F.col("tokens") * plan.max_epochs)
    leaves = written(leaves, "leaves")
    langs = leaves.groupBy("domain", "lang", "w_domain", "w_lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain", "w_domain").agg(F.sum("cap").alias("cap"))
    root = leaves.agg(F.sum("cap").alias("all"), F.sum("tokens").alias("held")).select(
        F.least(F.col("all"), F.lit(plan.budget).cast("long") if plan.budget is not None else F.expr(f"held * {plan.share_percent} div 100")).alias("given")
    )
    domains = domains.crossJoin(F.broadcast(root))  # one row
    got = divide(domains.withColumn("root", F.lit(0)).withColumnRenamed("w_domain", "weight"), ["root"], "domain").select("domain", F.col("budget").alias("given"))
    got = divide(langs.withColumnRenamed("w_lang", "weight").join(got, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("given"))
    return divide(leaves.withColumnRenamed("w_source", "weight").join(got, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, plan: MixPlan = PRODUCTION) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: one row for each time that a document is taken."""
    rows = written(narrow(docs), "narrow")
    leaves = leaf_budgets(rows, plan).select(*LEVELS, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest"))
    leaves = written(leaves, "budgets")
    small = leaves.count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda df: df)
    key = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = rows.join(hint(leaves), list(LEVELS)).withColumn("key", key)
    # The range in which the prefix ends: the first whose running sum is beyond the rest. It is found among 256 ranges, then
    # among 256 parts of that one, so no window holds more rows of a leaf.
    ends = None
    for digits in RANGE_DIGITS:
        part = keyed.withColumn("before", F.lit(0).cast("long")) if ends is None else keyed.join(hint(ends), list(LEVELS)).where(F.col("key").startswith(F.col("end")))
        sums = part.groupBy(*LEVELS, F.substring("key", 1, digits).alias("range"), "rest", "before").agg(F.sum("n_tokens").alias("n"))
        run = F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range"))
        found = sums.withColumn("run", run).where("run > rest").groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("run") - F.col("n")).alias("before"))).alias("end"))
        ends = written(found.select(*LEVELS, F.col("end.range").alias("end"), F.col("end.before").alias("before")), "ends")
    keyed = keyed.withColumn("range", F.substring("key", 1, RANGE_DIGITS[-1]))
    placed = keyed.join(hint(ends), list(LEVELS), "left")
    inside = placed.where(F.col("end").isNull() | (F.col("range") != F.col("end")))
    inside = inside.withColumn("epochs", F.col("whole") + F.when(F.coalesce(F.col("range") < F.col("end"), F.lit(False)), 1).otherwise(0))
    edge = placed.where(F.col("range") == F.col("end"))
    edge = edge.withColumn("run", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key")))
    edge = edge.withColumn("epochs", F.col("whole") + (F.col("run") <= F.col("rest")).cast("long"))
    columns = ["doc_id", *LEVELS, "n_tokens", "epochs"]
    taken = inside.select(*columns).unionByName(edge.select(*columns)).where("epochs > 0")
    return taken.select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))


def _sql_divide(name: str, source: str, family: str, node: str) -> str:
    return f"""{name}_1 AS (
  SELECT *, given - coalesce(sum(cap) OVER (PARTITION BY {family} ORDER BY cap / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_,
         sum(weight) OVER (PARTITION BY {family}) - coalesce(sum(weight) OVER (PARTITION BY {family} ORDER BY cap / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_ FROM {source}
), {name}_2 AS (SELECT *, cap * weights_ <= weight * rest_ AS full_ FROM {name}_1
), {name} AS (
  SELECT *, CASE WHEN full_ THEN cap ELSE CAST(weight * (given - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY {family}), 0)) AS BIGINT) // CAST(sum(CASE WHEN NOT full_ THEN weight END) OVER (PARTITION BY {family}) AS BIGINT) END AS budget FROM {name}_2
)"""


OP5_SQL = f"""
WITH n AS (
  SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) ELSE 'none' END AS domain,
         coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), nn AS (SELECT * FROM n WHERE n_tokens > 0
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 3 AS BIGINT) AS cap, 1 AS weight,
         CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w_lang,
         CASE domain WHEN 'd0' THEN 40 WHEN 'd1' THEN 30 WHEN 'd2' THEN 20 WHEN 'd3' THEN 10 ELSE 1 END AS w_domain FROM nn GROUP BY 1, 2, 3
), dom AS (
  SELECT domain, 0 AS root, w_domain AS weight, CAST(sum(cap) AS BIGINT) AS cap,
         (SELECT least(CAST(sum(cap) AS BIGINT), CAST(sum(tokens) AS BIGINT) * 60 // 100) FROM leaves) AS given FROM leaves GROUP BY 1, 2, 3
), {_sql_divide("d", "dom", "root", "domain")}
, lan AS (
  SELECT a.domain, a.lang, a.weight, a.cap, d.budget AS given FROM (SELECT domain, lang, w_lang AS weight, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY 1, 2, 3) a JOIN d ON a.domain = d.domain
), {_sql_divide("l", "lan", "domain", "lang")}
, src AS (
  SELECT a.domain, a.lang, a.source, a.weight, a.cap, a.tokens, l.budget AS given FROM leaves a JOIN l ON a.domain = l.domain AND a.lang = l.lang
), {_sql_divide("s", "src", "domain, lang", "source")}
, plan AS (SELECT domain, lang, source, CAST(budget AS BIGINT) // tokens AS whole, CAST(budget AS BIGINT) % tokens AS rest FROM s
), keyed AS (
  SELECT nn.*, whole, rest, md5('7:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM nn JOIN plan USING (domain, lang, source)
), run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS run FROM keyed
), e AS (SELECT *, whole + CASE WHEN run <= rest THEN 1 ELSE 0 END AS epochs FROM run)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, CAST(epochs AS BIGINT))) AS epoch FROM e
"""

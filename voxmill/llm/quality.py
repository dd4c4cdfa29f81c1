"""Quality scores by a sparse ensemble of rules over text statistics.

A random forest of shallow trees is grown on a bounded sample of labelled documents. Every path from
a root to a node is a conjunctive rule over the statistics; a logistic regression with an L1 penalty
weighs the rules and drops most of them; the ones that are left are compiled into one Spark column.

Statistics are built-in expressions over the whole text, so scoring is a projection without a
shuffle. A null text has the statistics of an empty one. If nothing can be learned (no labels, or
one class only), every score is the smoothed share of label 1. Repeated rows get the same score, and texts of
any length are read whole. Other columns are passed on, whatever their names: columns that are made on the
way take names that no column has. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import evaluated_once, fresh_name, materialize

#: The ensemble is fitted on about so many labelled documents, chosen by a hash of their id.
SAMPLE_ROWS = 6000
THRESHOLD = 0.3

Condition = tuple[int, str, float]
Rule = tuple[Condition, ...]


def text_statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name: sizes, shares of kinds of characters, and repetition."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(text, r"[ \t\r\n]+")
    lines = F.split(text, "\n")
    n_words = F.size(words).cast("double")

    # What is left is a small part of most texts, and the counted kinds of characters are all in it.
    rest = F.regexp_replace(text, r"[\p{Ll} \t\r\n]++", "")

    def share(kind: str) -> Column:
        return F.length(F.regexp_replace(rest, rf"[^{kind}]++", "")) / chars

    return {
        "n_chars": F.length(text).cast("double"),
        "chars_per_word": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_per_line": n_words / F.size(lines),
        "upper": share(r"\p{Lu}"),
        "digits": share("0-9"),
        "stops": share(".,;:"),
        "bangs": share("!?"),
        "bars": share("|"),
        "symbols": share(r"#$%&*@<>={}\[\]\\^~_+/"),
    }


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules over the statistics, by their order in ``text_statistics``."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, statistics: list[Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(conjunction(rule, statistics), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def conjunction(rule: Rule, statistics: list[Column]) -> Column:
    result = F.lit(True)
    for feature, sign, bound in rule:
        result = result & ((statistics[feature] <= bound) if sign == "<=" else (statistics[feature] > bound))
    return result


def tree_rules(description: str) -> list[Rule]:
    """The distinct rules of all paths in the description of a forest, shorter ones first."""
    rules: dict[Rule, None] = {}
    path: list[Condition] = []
    depths: list[int] = []
    for line in description.splitlines():
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while depths and depths[-1] >= depth:
            depths.pop()
            path.pop()
        depths.append(depth)
        path.append((int(found[3]), found[4], float(found[5])))
        rules[tuple(sorted(set(path)))] = None
    return sorted(rules, key=lambda rule: (len(rule), rule))


def fit_rules(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS, l1: float = 0.002) -> RuleModel:
    """Fit a model on about ``sample_rows`` labelled documents among those where ``learn`` holds.

    ``labels`` has doc_id and quality. Sampling by a hash of the id bounds the broadcast side and
    everything that is learned from; documents are scanned once, and only the sampled are measured.
    """
    known = labels.where(F.col("quality").isNotNull() & learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    n = known.count()
    sample = materialize(known.where(draw < (sample_rows / max(n, 1))).select("doc_id", F.col("quality").cast("double").alias("label")))
    names = list(text_statistics(F.col("text")))
    measured = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", *(c.alias(s) for s, c in text_statistics(F.col("text")).items()))
    measured = materialize(measured)
    counts = {row["label"]: row["count"] for row in measured.groupBy("label").count().collect()}
    positive, all_rows = counts.get(1.0, 0), sum(counts.values())
    if len(counts) < 2:
        prior = (positive + 1) / (all_rows + 2)
        return RuleModel(math.log(prior / (1 - prior)), ())

    features = VectorAssembler(inputCols=names, outputCol="features").transform(measured).select("label", "features")
    forest = RandomForestClassifier(numTrees=20, maxDepth=3, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.7, seed=7)
    rules = tree_rules(forest.fit(features).toDebugString)
    columns = [F.col(name) for name in names]
    met = measured.select("label", *(conjunction(rule, columns).cast("double").alias(f"r{i}") for i, rule in enumerate(rules)))
    assembled = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(met).select("label", "features")
    assembled = materialize(assembled)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=l1, maxIter=60, standardization=True).fit(assembled)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), tuple((rule, float(w)) for rule, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def with_score(docs: DataFrame, model: RuleModel, name: str) -> DataFrame:
    """``docs`` with the column ``name``: the score of its text, between 0 and 1."""
    measured = fresh_name(docs, "statistics_")
    statistics = text_statistics(F.col("text"))
    held = evaluated_once(docs, measured, F.struct(*(c.alias(s) for s, c in statistics.items())))
    return held.withColumn(name, model.score([F.col(measured)[s] for s in statistics])).drop(measured)


def keep_quality(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    score = fresh_name(docs, "score_")
    return with_score(docs, model, score).where(F.col(score) >= threshold).drop(score)

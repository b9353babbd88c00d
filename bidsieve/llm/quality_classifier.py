"""Quality classifier: a sparse ensemble of rules over text statistics.

A small random forest is grown on a bounded labelled sample; every path from a root to a node becomes a conjunctive rule; a
logistic model with a lasso penalty weighs the rules and leaves few; those are compiled into one Spark column expression,
so scoring is a projection over the statistics, without Python, joins or shuffles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, kept_rows, row_key, text_of
from .quality_rules import _BLANKS, _SPACE, let

#: Statistics of a text, in the order of the model's features. Labels, language, source and id are none of them.
FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "marks", "exclaims", "pipes", "distinct_words", "repeated_lines", "line_words")

Rule = tuple[tuple[int, float, float], ...]


def features(text: Column) -> list[Column]:
    """The statistics of a text as columns named as in FEATURES; all are 0 for an empty one."""
    trimmed = F.btrim(text, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    chars = F.length(F.translate(text, _BLANKS, ""))
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    of = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    values = [
        F.log1p(by_word["n"]), of(chars, by_word["n"]), of(count(r"[#*$%&|<>]"), chars), of(count(r"\p{Lu}"), chars), of(count(r"\p{N}"), chars), of(count(r"\p{P}"), chars),
        of(count("!"), chars), of(count(r"\|"), chars), of(by_word["distinct"], by_word["n"]), 1 - of(by_line["distinct"], by_line["n"]), of(by_word["n"], by_line["n"]),
    ]
    return [v.cast("double").alias(name) for v, name in zip(values, FEATURES, strict=True)]


@dataclass(frozen=True)
class RuleModel:
    """Intercept and weighted rules; a rule is (feature, above, up to) bounds that hold together."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of label 1, over the columns in FEATURES."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def condition(rule: Rule) -> Column:
    held = F.lit(True)
    for i, above, up_to in rule:
        c = F.col(FEATURES[i])
        if above > float("-inf"):
            held = held & (c > above)
        if up_to < float("inf"):
            held = held & (c <= up_to)
    return held


def tree_rules(shown: str) -> set[Rule]:
    """Rules of all nodes below the root, from Spark's printed form of a tree."""
    found: set[Rule] = set()
    path: list[tuple[int, str, float]] = []
    for line in shown.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, f"{m[2]} {m[3]}", float(m[4]))]
        bounds: dict[int, list[float]] = {}
        for _, where, at in path:
            i, sign = where.split(" ")
            low_high = bounds.setdefault(int(i), [float("-inf"), float("inf")])
            if sign == "<=":
                low_high[1] = min(low_high[1], at)
            else:
                low_high[0] = max(low_high[0], at)
        found.add(tuple(sorted((i, a, b) for i, (a, b) in bounds.items())))
    return found


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(facts: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 3, penalty: float = 0.002) -> RuleModel:
    """Learn from at most `sample` labelled rows (those of smallest hash; the bound is for the fit alone).

    facts: doc_id and the FEATURES; labels: doc_id, quality 0 or 1. Held-out rows, null ids and other labels are left out;
    of several labels of a document the smallest counts. With a single class, or none, the score is the share of label 1
    (0.5 without labels), kept within 0.001 of the ends.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    rows = facts.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), *FEATURES).limit(sample)
    rows = durable(rows.coalesce(1).select("label", *FEATURES, array_to_vector(F.array(*FEATURES)).alias("features")))
    classes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        share = next(iter(classes), 0.5)
        share = min(max(share, 0.001), 0.999)
        return RuleModel(log(share / (1 - share)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.8, minInstancesPerNode=5, seed=7).fit(rows)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)})
    if not rules:
        share = classes.get(1.0, 0) / sum(classes.values())
        return RuleModel(log(share / (1 - share)))
    hits = rows.select("label", array_to_vector(F.array(*(condition(r).cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(hits)
    return RuleModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6])


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    text = text_of(docs)
    return docs.select(*(docs[c] for c in keep), *features(text))


def classify(docs: DataFrame, labels: DataFrame, **parameters: float) -> DataFrame:
    """Score every row of docs (doc_id long, text string; other columns are ignored, whatever their names).

    Returns one row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), and the FEATURES. A null text
    is empty and is scored like one; null ids are scored, never learned from; repeated rows are scored each; an empty table
    gives an empty result.
    """
    facts = durable(with_features(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")))
    model = fit(facts, labels, **parameters)
    return facts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"), *FEATURES).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs, with all their columns, that the classifier predicts to be good. The statistics are made once."""
    facts = durable(docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("row_key"), *features(text_of(docs))))
    return kept_rows(docs, facts.where(fit(facts, labels).score() >= 0.5))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", "held_out", "score", "predicted")

"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are SQL expressions. Shallow trees are grown on labelled
rows; each path from a root to a node is a conjunction of thresholds, a rule. A
lasso logistic regression weighs the rules and sets most weights to zero. The
others are compiled into one column expression, so that scoring a corpus is a
projection: no model object, no Python, no shuffle.

Training takes at most SAMPLE labelled rows (those with the smallest hashes of
their doc_id), of which only the statistics reach the driver: a few MB.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 6_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 7
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """name -> expression, none of them null; an empty or null text has zeros."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    share = lambda pattern: without(pattern) / chars
    return {
        "chars": F.length(text).cast("double"),
        "upper": share(r"\p{Lu}+"),
        "digits": share(r"\d+"),
        "stops": share(r"[.,]+"),
        "calls": share(r"[!?]+"),
        "signs": share(r"[#$%&*+=<>|{}\[\]\\^~@_/]+"),
        "bars": share(r"\|+"),
        "breaks": share(r"\n+"),
    }


def word_statistics(words: Column) -> dict[str, Column]:
    """Of the array of a text's words."""
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    again = F.size(F.filter(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: a == b), lambda x: x))
    return {
        "words": F.size(words).cast("double"),
        "distinct": F.size(F.array_distinct(words)) / n,
        "same_as_next": again / n,
    }


NAMES = ("chars", "upper", "digits", "stops", "calls", "signs", "bars", "breaks", "words", "distinct", "same_as_next", "word_length")


def with_statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, and each statistic as _s_<name>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*(F.col(c).alias(f"_keep_{c}") for c in keep), text.alias("_text"), F.split(text, r"\s+").alias("_words"))
    made = statistics(F.col("_text")) | word_statistics(F.col("_words"))
    made["word_length"] = made["chars"] / F.greatest(made["words"], F.lit(1.0))
    return rows.select(*(F.col(f"_keep_{c}").alias(c) for c in keep), *(made[n].cast("double").alias(f"_s_{n}") for n in NAMES))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is "<=", threshold), and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, below, at in self.terms:
            value = F.col(f"_s_{name}")
            out = out & (value <= at if below else value > at)
        return out


def tree_rules(debug: str, names: tuple[str, ...] = NAMES) -> set[tuple]:
    """The conjunctions of all paths, from the printed form of a tree or an ensemble."""
    found: set[tuple] = set()
    path: dict[int, tuple[str, bool, float]] = {}
    for line in debug.split("\n"):
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = {d: t for d, t in path.items() if d < depth} | {depth: (names[int(m[2])], m[3] == "<=", float(m[4]))}
        found.add(simplified(path.values()))
    return found


def simplified(terms) -> tuple:
    """One bound of each kind for a statistic: the tightest."""
    best: dict[tuple[str, bool], float] = {}
    for name, below, at in terms:
        known = best.get((name, below))
        best[name, below] = at if known is None else min(known, at) if below else max(known, at)
    return tuple(sorted((n, b, at) for (n, b), at in best.items()))


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...] = ()

    def score(self) -> Column:
        """0 to 1, over the columns of with_statistics."""
        margin = F.lit(self.intercept)
        for r in self.rules:
            margin = margin + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-margin))


def fit(labelled: DataFrame, label: str, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """A model from the statistics of labelled rows: columns of with_statistics, and label (0 or 1; not null).

    At most sample rows are taken, in the order of a hash of their statistics.
    Without rows of both labels there are no rules, and the score is the
    smoothed share of ones.
    """
    import math

    import numpy as np
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    columns = [f"_s_{n}" for n in NAMES]
    chosen = labelled.select(*columns, F.col(label).cast("double").alias("label")).orderBy(F.xxhash64(*columns, "label"), *columns, "label").limit(sample).toPandas()
    y, x = chosen["label"].to_numpy(float), chosen[columns].to_numpy(float)
    share = (y.sum() + 1) / (len(y) + 2)
    prior = RuleEnsemble(math.log(share / (1 - share)))
    if len(set(y)) < 2:
        return prior
    spark = labelled.sparkSession
    table = lambda m: spark.createDataFrame([(float(t), Vectors.dense(r)) for t, r in zip(y, m)], ["label", "features"]).coalesce(1)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=max(2, len(y) // 400), featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=SEED)
    conjunctions = sorted(tree_rules(forest.fit(table(x)).toDebugString))
    at = {n: i for i, n in enumerate(NAMES)}
    fires = np.array([np.all([x[:, at[n]] <= t if b else x[:, at[n]] > t for n, b, t in c], axis=0) for c in conjunctions], float).reshape(len(conjunctions), len(y)).T
    _, first = np.unique(fires, axis=1, return_index=True)  # of rules that fire alike, one
    first = [i for i in sorted(first) if 0 < fires[:, i].sum() < len(y)]
    if not first:
        return prior
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(table(fires[:, first]))
    rules = tuple(Rule(conjunctions[i], float(w)) for i, w in zip(first, model.coefficients.toArray()) if abs(w) > 1e-6)
    return RuleEnsemble(float(model.intercept), rules)


def labels_of(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id and label: the mean of a document's labels, rounded; rows that lack either are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return rows.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Fits on the labelled documents outside the held-out quarter. Which rows are taken is settled by ids alone, before any text is read."""
    chosen = labels_of(labels).where(~held_out(F.col("doc_id"), 4, 2)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows of two numbers
    return fit(with_statistics(rows, "label"), "label", sample)


def score_quality(documents: DataFrame, model: RuleEnsemble, *keep: str) -> DataFrame:
    """One row per row of documents: the columns keep, score, predicted. Null and empty texts are scored by their zeros; other columns are ignored."""
    out = with_statistics(documents, *keep).withColumn("_score", model.score())
    return out.select(*keep, F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import table

    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels", "doc_id", "quality"))
    out = score_quality(documents, model, "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")

"""Quality by a sparse rule ensemble.

Statistics of a text are Spark columns.  Boosted trees over them give rules: every path from a root to
a node, a conjunction of comparisons.  A logistic regression with an L1 penalty keeps few
rules; those are compiled back into one Spark column, so that scoring is the scan's own projection
and no row leaves the JVM.

Trees and weights are fitted on at most ``TRAIN_DOCS`` labelled documents (the smallest hashes
of doc_id; a documented bound).

Defined results: null text counts as empty and gets the score of a text with all
statistics 0; labels of one kind only give that label's score, none at all 0; of
repeated labels the largest counts; repeated documents each get their row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.common import held_out
from heddle.llm.trees import condition, paths, trees_of

TRAIN_DOCS = 8000
TREES, DEPTH = 12, 3
PENALTY = 0.003
MARKS = {"bar": "|", "percent": "%", "hash": "#", "dollar": "$", "and": "&", "star": "*", "stop": ".", "comma": ",", "at": "@", "less": "<"}


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text column, all double."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    words, lines = F.split(t, " ", -1), F.split(t, "\n", -1)
    out = {f"s_{name}": count(mark) / n for name, mark in MARKS.items()}
    out |= {
        "s_length": F.length(t),
        "s_word_length": n / (count(" ") + count("\n") + 1),
        "s_lines": (count("\n") + 1) / n,
        "s_same_words": 1 - F.size(F.array_distinct(words)) / F.size(words),
        "s_same_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "s_digits": F.length(F.regexp_replace(t, "[^0-9]+", "")) / n,
        "s_capitals": F.length(F.regexp_replace(t, "[^A-Z]+", "")) / n,
        "s_beyond_ascii": (F.octet_length(t) - F.length(t)) / n,
    }
    return {k: v.cast("double") for k, v in out.items()}


def _vectors(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).select("label", "features")


class RuleEnsemble:
    """``intercept`` and (path, weight) of the kept rules; ``share`` where there is nothing to learn."""

    def __init__(self, sample: DataFrame) -> None:
        """``sample``: label (double) and the statistics."""
        names = [c for c in sample.columns if c != "label"]
        kinds = [r["label"] for r in sample.select("label").distinct().collect()]
        self.rules: list[tuple[tuple, float]] = []
        self.intercept, self.constant = 0.0, None
        if len(kinds) < 2:
            self.constant = float(kinds[0]) if kinds else 0.0
            return
        vectors = _vectors(sample, names)
        trees = trees_of(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(vectors), names)
        found = list(dict.fromkeys(p for tree in trees for p in paths(tree)))
        if not found:  # no split separates anything
            self.constant = sample.agg(F.avg("label")).first()[0]
            return
        flags = [f"r{i}" for i in range(len(found))]
        ruled = sample.select("label", *[condition(p).cast("double").alias(f) for p, f in zip(found, flags)])
        model = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(_vectors(ruled, flags))
        self.intercept = float(model.intercept)
        self.rules = [(p, float(w)) for p, w in zip(found, model.coefficients) if w != 0]

    def column(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        terms = [F.when(condition(p), F.lit(w)).otherwise(0.0) for p, w in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def fit(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(1, 3)).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = texts.select("doc_id", F.col("_label").cast("double").alias("label"), *[v.alias(k) for k, v in statistics(F.col("text")).items()])
    one = sample.groupBy("doc_id").agg(F.min(F.struct(*[c for c in sample.columns if c != "doc_id"])).alias("s")).select("s.*")
    return RuleEnsemble(materialise(one).coalesce(8))  # few rows by now: the scan above runs in as many tasks as it has


def quality(docs: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[v.alias(k) for k, v in statistics(F.col("text")).items()])
    scored = named.select("doc_id", held_out(1, 3).alias("held_out"), ensemble.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

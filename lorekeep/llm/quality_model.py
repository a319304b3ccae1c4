"""Operator 8: quality classifier by a sparse rule ensemble.

Statistics of each whole text are Spark columns. A forest of shallow trees (Spark ML) is fitted on a bounded sample of labelled
rows; every path from a root is a conjunction of comparisons, a rule. A logistic regression with lasso weighs the rules'
indicators, and the few with weight are compiled to one Spark column expression, so scoring is a projection over statistics.

The sample: at most MAX_ROWS labelled rows, those first in the order of a hash of their id.

Defined results: null and empty texts have statistics 0 and get a score; null labels and null doc_ids are never learned from; without
labels the score is the prior 0.5, with one class it is that class; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WORD, documents, written
from .language_id import remainder

#: Bound of the training sample.
MAX_ROWS = 4000
TREES, DEPTH = 12, 3
CUT = 0.3
FEATURES = ["n_words", "word_length", "symbols", "upper", "digits", "marks", "distinct_words", "distinct_lines", "letters"]


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and FEATURES, all doubles, from one pass over each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = docs.select(*keep, text.alias("__text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"), lines.alias("__lines"))
    count = lambda p: F.regexp_count("__text", F.lit(p)).cast("double")
    n, size = F.greatest(F.size("__words"), F.lit(1)), F.greatest(F.length("__text"), F.lit(1))
    return df.select(
        *keep,
        F.size("__words").cast("double").alias("n_words"),
        (F.length(F.array_join("__words", "")) / n).alias("word_length"),
        (count("[#*$%&|<>]") / n).alias("symbols"),
        (count("[A-Z]") / size).alias("upper"),
        (count("[0-9]") / size).alias("digits"),
        (count("[!?]") / n).alias("marks"),
        (F.size(F.array_distinct("__words")) / n).alias("distinct_words"),
        (F.size(F.array_distinct("__lines")) / F.greatest(F.size("__lines"), F.lit(1))).alias("distinct_lines"),
        (count(r"[\p{L}]") / size).alias("letters"),
    )


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(printed: str) -> list[Rule]:
    """All distinct paths, of every length, in the text that Spark prints for a tree ensemble."""
    out: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in printed.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (FEATURES[int(m[2])], m[3], float(m[4])))]
            out[tuple(sorted({p[1] for p in path}))] = None
        elif line.strip().startswith("Tree"):
            path = []
    return list(out)


def rule_column(rule: Rule) -> Column:
    held = F.lit(True)
    for name, op, at in rule:
        held = held & (F.col(name) <= at if op == "<=" else F.col(name) > at)
    return held.cast("double")


@dataclass
class RuleModel:
    bias: float
    weights: list[tuple[Rule, float]]

    def score(self) -> Column:
        z = F.lit(float(self.bias))
        for rule, w in self.weights:
            z = z + F.lit(float(w)) * rule_column(rule)
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel:
    """labels: doc_id, y in (0, 1). Ids are chosen before any text is read for training."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).select("doc_id", F.col("y").cast("double").alias("y"))
    chosen = usable.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "y").limit(max_rows).drop("h")
    rows = docs.join(F.broadcast(chosen), "doc_id")
    data = written(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(statistics(rows, ["y"])), "quality-sample")
    counts = {r["y"]: r["count"] for r in data.groupBy("y").count().collect()}
    if len(counts) < 2:
        return RuleModel({0.0: -5.0, 1.0: 5.0}.get(next(iter(counts), None), 0.0), [])
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=8, subsamplingRate=0.8).fit(data)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel(0.0, [])
    marked = data.select("y", F.array(*[rule_column(r) for r in rules]).alias("held")).selectExpr("y", "held")
    from pyspark.ml.functions import array_to_vector

    marked = written(marked.select("y", array_to_vector("held").alias("rules")), "quality-rules")
    lasso = LogisticRegression(featuresCol="rules", labelCol="y", elasticNetParam=1.0, regParam=0.002, maxIter=60, standardization=False).fit(marked)
    return RuleModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6])


def op8_quality_rules_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    model = fit(docs, labels.where(~held))
    scored = statistics(docs, ["doc_id"]).withColumn("score", model.score())
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

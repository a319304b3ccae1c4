"""Operator 3: hierarchical language identification.

A text becomes the relative frequencies of its hashed byte trigrams (letters folded to lower case, other ASCII as spaces). A
multinomial logistic regression names the language family; inside a family, one linear support vector machine per pair of
languages votes, and the margin decides ties. Models are Spark ML's, fitted on at most PER_LANG labelled rows of each language,
those first in the order of a hash of their id; scoring covers every whole text, a few hundred kilobytes of text at a time.

A language that FAMILIES does not know is a family of its own.

Defined results: null text, or text without a letter: `und`, score 0; with no labelled row at all every text is `und`; with one
language every text with a letter is that language; null labels are never learned from, nor are null doc_ids; ties between
languages go to the first in name order; repeated rows are scored alike; other columns pass through `predict`.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import documents, written
from ._text import chunks, utf8

#: Families of common languages.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "turkic": ["az", "kk", "tr", "uz"],
    "uralic": ["et", "fi", "hu"],
}
DIM = 2048
#: Bound of the training sample, in rows per language.
PER_LANG = 300

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _trigrams(column: pa.Array):
    """For chunks of rows: (first, last, hashed trigram at each place, row of each place)."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        part, off = _FOLD[data[offsets[a] : offsets[b]]].astype(np.uint32), offsets[a : b + 1] - offsets[a]
        n = np.diff(off)
        if len(part) < 3:
            yield a, b, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64) % DIM
        row = np.repeat(np.arange(b - a), n)
        same = row[:-2] == row[2:]
        yield a, b, slot[same], row[:-2][same]


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and x, an array of relative trigram frequencies times DIM."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            for a, b, slot, row in _trigrams(batch.column("text")):
                counts = np.bincount(row * DIM + slot, minlength=(b - a) * DIM).reshape(b - a, DIM).astype(np.float32)
                counts *= DIM / np.maximum(counts.sum(1, keepdims=True), 1)
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * DIM + 1, DIM, dtype=np.int32)), pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in keep] + [x], names=[*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


@dataclass
class Model:
    """families[i] has the languages of family i; weights: one column a linear model, families first, then pairs of languages."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v), lang)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """docs: doc_id, text, lang. Only rows with a label and an id are learned from, at most per_lang of each language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("doc_id", "lang")
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    sample = sample.withColumn("family", F.coalesce(*[F.when(F.col("lang").isin(v), k) for k, v in FAMILIES.items()], F.col("lang")))
    data = written(features(sample, ["lang", "family"]).select("lang", "family", array_to_vector("x").alias("x")), "lang-sample")
    langs = sorted(r["lang"] for r in data.select("lang").distinct().collect())
    names = sorted({family_of(x) for x in langs})
    families = [[x for x in langs if family_of(x) == f] for f in names]
    pairs = [p for f in families for p in combinations(f, 2)]
    columns, bias = [], []
    if len(names) > 1:
        labelled = data.withColumn("y", F.array_position(F.array(*[F.lit(x) for x in names]), F.col("family")).cast("double") - 1)
        m = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", maxIter=15, regParam=0.001).fit(labelled)
        columns += list(m.coefficientMatrix.toArray())
        bias += list(m.interceptVector.toArray())
    else:
        columns += [np.zeros(DIM)] * len(names)
        bias += [0.0] * len(names)
    for one, two in pairs:
        part = data.where(F.col("lang").isin(one, two)).withColumn("y", (F.col("lang") == one).cast("double"))
        m = LinearSVC(featuresCol="x", labelCol="y", maxIter=15, regParam=0.001).fit(part)
        columns.append(m.coefficients.toArray())
        bias.append(m.intercept)
    weights = np.stack(columns, 1).astype(np.float32) if columns else np.zeros((DIM, 0), np.float32)
    return Model(families, pairs, weights, np.array(bias, np.float64))


def decide(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into the languages in family order, score) from the rows' margins."""
    n, k = len(margins), len(model.families)
    z = margins[:, :k] - margins[:, :k].max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    family = p.argmax(1)
    best, score = np.zeros(n, np.int64), np.zeros(n)
    base = 0
    for f, langs in enumerate(model.families):
        own = np.flatnonzero(family == f)
        votes, total = np.zeros((len(own), len(langs))), np.zeros((len(own), len(langs)))
        for j, (one, two) in enumerate(model.pairs):
            if one in langs:
                m = margins[own, k + j]
                for lang, side in ((one, m), (two, -m)):
                    votes[:, langs.index(lang)] += side > 0
                    total[:, langs.index(lang)] += np.tanh(side)
        best[own] = base + (votes + total / (2 * len(langs))).argmax(1)
        sure = 1 / (1 + np.exp(-2 * total.max(1) / max(1, len(langs) - 1))) if len(langs) > 1 else np.ones(len(own))
        score[own] = p[own, f] * sure
        base += len(langs)
    return best, np.clip(score, 0, 1)


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score, without a shuffle. Columns of docs that have these names are replaced."""
    names = pa.array([x for f in model.families for x in f] + ["und"])
    und = len(names) - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # the row as one struct: no name of its columns can clash with ours
    others = [c for c in docs.columns if c not in (lang, score)]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").rlike(r"\p{L}").alias("letters"))
    place = others.index("text")
    schema = T.StructType([packed.schema["row"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            margins = np.zeros((batch.num_rows, m.weights.shape[1]))
            for a, b, slot, row in _trigrams(batch.column("row").field(place)):
                n = np.bincount(row, minlength=b - a)
                for j in range(margins.shape[1]):
                    margins[a:b, j] = np.bincount(row, m.weights[slot, j], b - a) * DIM / np.maximum(n, 1)
            best, sure = np.full(batch.num_rows, und), np.zeros(batch.num_rows)
            if und and batch.num_rows:
                letters = np.array(batch.column("letters").fill_null(False))
                best[:], sure[:] = decide(m, margins + m.bias)
                best[~letters], sure[~letters] = und, 0
            yield pa.RecordBatch.from_arrays([batch.column("row"), names.take(pa.array(best)), pa.array(sure)], names=["row", "lang", "score"])

    return packed.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in others], F.col("lang").alias(lang), F.col("score").alias(score))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")

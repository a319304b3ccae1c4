"""A partitioned vector index: coarse lists around centroids, scope in the key, exact scores inside, and bounds that make the search exact.

Centroids are fitted on a bounded sample; every row is then put into its nearest list, with its angle to the centroid, in a written table. Angles obey
the triangle inequality, so a list whose centroid is at angle t from a query, and whose rows of the query's scope reach as far as r from
the centroid, holds no cosine above cos(t - r). A search first reads the nearest lists, as many as are asked for and as it takes to have enough
rows of the scope; with exact=True it then reads every other list that the bound does not rule out, which gives the result of a
full scan. Rows of zero vectors are a list of their own that is always read.

Sizes: centroids (lists x dimensions) go to all executors; queries x lists rows rank the lists; rows meet only the queries that probe their
list, in blocks of bounded size (vector_blocks.met), whatever the list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as c
from .retrieval import in_scope, top_k
from .tables import checkpointed
from .vector_blocks import met

#: Rows from which centroids are fitted: those of least hash, so reruns agree.
SAMPLE_ROWS = 20_000
_ZERO = -1


@dataclass
class VectorIndex:
    rows: DataFrame  # doc_id, scope columns, __list, __angle, __v
    lists: DataFrame  # __list, scope columns, __n, __radius
    centroids: list[list[float]]
    scope: tuple[str, ...]


def _list_angles(vectors: DataFrame, centroids: list[list[float]], keep: list[str], nearest: bool) -> DataFrame:
    """The rows of vectors (keep, __v unit vectors) with __list and __angle: the nearest list only, or each."""
    import numpy as np

    shared = vectors.sparkSession.sparkContext.broadcast(np.array(centroids, float) if centroids else np.zeros((0, 1)))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            x = np.array(pdf["__v"].tolist(), float).reshape(len(pdf), -1)
            zero = ~x.any(axis=1)
            own = shared.value
            angle = np.arccos(np.clip(x @ own.T if len(own) else np.zeros((len(x), 0)), -1, 1))
            if nearest:
                best = angle.argmin(axis=1)
                yield pdf.assign(__list=np.where(zero, _ZERO, best), __angle=np.where(zero, np.pi, angle[np.arange(len(x)), best]))
            else:
                n = len(own) + 1
                at = np.repeat(np.arange(len(pdf)), n)
                yield pdf.iloc[at].assign(__list=np.tile(np.arange(n) - 1, len(pdf)), __angle=np.concatenate([np.zeros((len(x), 1)), angle], axis=1).ravel())

    fields = ", ".join(f"{x} {vectors.schema[x].dataType.simpleString()}" for x in keep)
    return vectors.select(*keep).mapInPandas(run, f"{fields}, __list int, __angle double")


def build(items: DataFrame, n_lists: int, scope: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> VectorIndex:
    """Indexes every row of items (doc_id, embedding, scope columns) with an embedding."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    units = items.where(F.col("embedding").isNotNull()).select("doc_id", *scope, c.unit(F.col("embedding")).alias("__v"))
    sample = units.where(F.exists("__v", lambda x: x != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(array_to_vector("__v").alias("x"))
    sample = checkpointed(sample)
    some = sample.limit(2).count()
    centroids: list[list[float]] = []
    if some:
        k = max(2, n_lists)
        model = KMeans(featuresCol="x", k=k, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample) if some > 1 else None
        points = [list(p) for p in model.clusterCenters()] if model else [list(sample.first()["x"])]
        norms = [sum(v * v for v in p) ** 0.5 for p in points]
        centroids = [[float(v / n) for v in p] for p, n in zip(points, norms) if n > 0]
    rows = checkpointed(_list_angles(units, centroids or [[1.0]], ["doc_id", *scope, "__v"], nearest=True) if centroids else units.select("*", F.lit(_ZERO).alias("__list"), F.lit(3.2).alias("__angle")))
    lists = checkpointed(rows.groupBy("__list", *scope).agg(F.count("*").alias("__n"), F.max("__angle").alias("__radius")))
    return VectorIndex(rows, lists, centroids, tuple(scope))


def _bound(angle: str, radius: str):
    """The largest cosine that a list can hold, a little above it."""
    return F.cos(F.greatest(F.lit(0.0), F.col(angle) - F.col(radius) - 1e-7)) + 1e-9


def _probed(index: VectorIndex, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score) of the k best rows in scope, of every block, of the lists that queries probe. probes: query_id, __q, __q_ scope columns, __list."""
    return met(index.rows.select("__list", "doc_id", *index.scope, "__v"), probes, ("__list",), index.scope, k=k).select("query_id", "doc_id", "score")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, enough: int = 4, exact: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best by cosine. queries: query_id, embedding, scope columns (null for no restriction).

    Reads each query's `probes` nearest lists that hold rows of its scope, and more while these have fewer than enough * k of them."""
    wide = queries.select("query_id", *[F.col(x).alias("__q_" + x) for x in index.scope], c.unit(F.col("embedding")).alias("__v"))
    keep = ["query_id", *["__q_" + x for x in index.scope], "__v"]
    near = _list_angles(wide, index.centroids, keep, nearest=False).withColumnRenamed("__v", "__q")
    held = near.join(F.broadcast(index.lists), "__list").where(in_scope(index.scope))
    held = held.groupBy(*[x if x != "__v" else "__q" for x in keep], "__list", "__angle").agg(F.sum("__n").alias("__n"), F.max("__radius").alias("__radius"))
    order = Window.partitionBy("query_id").orderBy("__angle", "__list")
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = checkpointed(held.withColumn("__first", (F.row_number().over(order) <= probes) | (before < enough * k) | (F.col("__list") == _ZERO)))
    best = top_k(_probed(index, ranked.where("__first").drop("__n", "__radius", "__angle", "__first"), k), k)
    if not exact:
        return best
    best = checkpointed(best)
    worst = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("__worst"))
    rest = ranked.where("not __first").join(worst, "query_id", "left").where(_bound("__angle", "__radius") >= F.coalesce("__worst", F.lit(-2.0)))
    more = top_k(_probed(index, rest.select(*[x for x in ranked.columns if x not in ("__n", "__radius", "__angle", "__first")]), k), k)
    return top_k(best.drop("rank").unionByName(more.drop("rank")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, expected, hit): how many of the exact results were found; a row that ties with the last counts."""
    floor = exact.groupBy("query_id").agg(F.count("*").alias("expected"), F.min("score").alias("__floor"))
    return floor.join(found, "query_id", "left").groupBy("query_id", "expected").agg(F.count_if(F.col("score") >= F.col("__floor")).alias("hit"))


def pairs_at(items: DataFrame, floor: float, n_lists: int, by: str = "space") -> DataFrame:
    """Exact cosine of pairs within a space at the floor: (space, a, b, cosine), through the lists. items: space, uid, embedding.

    An item meets only the lists of its space that the bound allows, so at a high floor little more than each list meets itself."""
    index = build(items.select(F.col("uid").alias("doc_id"), by, "embedding"), n_lists, (by,))
    units = index.rows.select(F.col("doc_id").alias("query_id"), F.col(by).alias("__q_" + by), "__v")
    near = _list_angles(units, index.centroids, ["query_id", "__q_" + by, "__v"], nearest=False).withColumnRenamed("__v", "__q")
    held = near.join(F.broadcast(index.lists.withColumnRenamed(by, "__q_" + by)), ["__list", "__q_" + by]).where(_bound("__angle", "__radius") >= floor)
    own = index.rows.where(F.col(by).isNotNull()).select("__list", by, "doc_id", "__v")
    out = met(own, held.select("__list", F.col("__q_" + by).alias(by), "query_id", "__q"), ("__list", by), floor=floor)
    return out.select(by, F.col("query_id").alias("a"), F.col("doc_id").alias("b"), F.col("score").alias("cosine"))

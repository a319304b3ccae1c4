"""The vector index next to a full scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval, vector_index
from .fixtures import table, view
from .recall import cosine_sql, query

LISTS, PROBES, K = 24, 20, 10


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("p"), F.col("vec_id") % 4).alias("persona_id"), "embedding")
    queries = view(spark, sf_dir, "fx_vector_queries").withColumn("persona_id", F.when(F.col("query_id") % 100 == 0, "p1"))
    return items, queries


@query(f"""with q as (select vec_id as query_id, embedding, case when vec_id % 100 = 0 then 'p1' end as persona from embeddings where vec_id % 50 = 0),
s as (select query_id, e.vec_id as doc_id, round({cosine_sql('q.embedding', 'e.embedding')}, 9) as score from q cross join embeddings e where persona is null or persona = 'p' || e.vec_id % 4)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, doc_id) as rank from s qualify rank <= {K}""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows in scope by the index, made exact by its bounds."""
    items, queries = _sides(spark, sf_dir)
    out = vector_index.search(vector_index.build(items, LISTS, ("persona_id",)), queries, K, 4, exact=True)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def indexed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's nearest rows the index finds by its nearest lists alone."""
    items, queries = _sides(spark, sf_dir)
    found = vector_index.search(vector_index.build(items, LISTS, ("persona_id",)), queries, K, PROBES)
    return vector_index.recall(found, retrieval.vector_top_k(items, queries, K, scope=("persona_id",)))


@query(f"""with t as (select vec_id as uid, embedding, 'space' || cast(vec_id % 3 as varchar) as space from embeddings)
select space, a, b, round(cosine, 6) as cosine from (select a.space, a.uid as a, b.uid as b, round({cosine_sql('a.embedding', 'b.embedding')}, 9) as cosine from t a join t b on a.space = b.space and a.uid < b.uid) where cosine >= 0.3""")
def indexed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a space at a floor, through the lists of the index."""
    items = view(spark, sf_dir, "fx_topics").select(F.col("memory_space_id").alias("space"), F.col("topic_id").alias("uid"), "embedding")
    return vector_index.pairs_at(items, 0.3, LISTS).select("space", "a", "b", F.round("cosine", 6).alias("cosine"))

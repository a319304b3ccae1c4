"""Topic recall and the unified answer: support from context, boosts, supplements, and what fills the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .retrieval import top_k


def context_support(branches: DataFrame, cap: float = 0.08) -> DataFrame:
    """branches: query_id, topic_id, branch, weight, score. Only the primary branch qualifies a topic; the others add at most the cap, by
    noisy-or. Returns query_id, topic_id, relevance, support."""
    other = F.col("branch") != "current"
    miss = F.product(F.when(other, 1 - c.clamp(F.greatest(F.lit(0.0), F.col("weight")) * F.greatest(F.lit(0.0), F.col("score")))).otherwise(1.0))
    out = branches.groupBy("query_id", "topic_id").agg(F.max(F.when(~other, F.col("score"))).alias("relevance"), (F.lit(cap) * (1 - miss)).alias("support"))
    return out.where(F.col("relevance").isNotNull())


def affect_boost(similarity: Column, explicit: Column, confidence: Column, cap: float = 0.04) -> Column:
    return F.when(explicit, F.lit(min(0.12, cap)) * c.clamp(similarity) * c.clamp(confidence)).otherwise(F.lit(0.0))


def topic_recall(supported: DataFrame, topics: DataFrame, k: int, actor_boost: float = 0.04, minimum: float = 0.0) -> DataFrame:
    """supported: query_id, topic_id, relevance, support, actor_hit, affect (boost). topics: topic_id, importance_now, confidence. Rank score is
    0.82 relevance + 0.10 importance + 0.08 confidence, plus support and boosts, at most 1."""
    df = supported.join(topics, "topic_id").where(F.col("relevance") >= minimum)
    score = c.topic_rank(F.col("relevance"), F.col("importance_now"), F.col("confidence")) + F.col("support") + F.when(F.col("actor_hit"), actor_boost).otherwise(0.0) + F.col("affect")
    return top_k(df.withColumn("score", F.round(F.least(F.lit(1.0), score), 9)).select("query_id", "topic_id", "score", "relevance"), k, ids=("topic_id",))


def fragment_supplements(fragments: DataFrame, recalled: DataFrame, k: int, near: float = 0.82) -> DataFrame:
    """fragments: query_id, topic_id, fragment_id, cosine, terms, features, parent_features. Own score 0.85 cosine + 0.15 terms, mixed 0.78 to 0.22
    with the parent's; a body that repeats its parent is left out."""
    df = fragments.join(recalled.select("query_id", "topic_id", F.col("score").alias("parent")), ["query_id", "topic_id"]).where(c.jaccard(F.col("features"), F.col("parent_features")) < near)
    own = 0.85 * F.col("cosine") + 0.15 * F.col("terms")
    return top_k(df.withColumn("score", F.round(0.78 * own + 0.22 * F.col("parent"), 9)).select("query_id", "topic_id", "fragment_id", "score"), k, ids=("fragment_id",))


def timeline_supplements(timelines: DataFrame, recalled: DataFrame, links: DataFrame, k: int, near: float = 0.82) -> DataFrame:
    """timelines: query_id, doc_id, score, features; recalled: query_id, topic_id, features; links: topic_id, doc_id. Timelines that nearly repeat a
    recalled topic are left out; linked ones come first."""
    tops = recalled.select("query_id", "topic_id", F.col("features").alias("__tf"))
    close = timelines.join(tops, "query_id", "left").groupBy("query_id", "doc_id", "score").agg(F.coalesce(F.max(c.jaccard(F.col("features"), F.col("__tf"))), F.lit(0.0)).alias("near")).where(F.col("near") < near)
    linked = tops.join(links, "topic_id").select("query_id", "doc_id", F.lit(1.0).alias("linked")).distinct()
    ranked = close.join(linked, ["query_id", "doc_id"], "left").withColumn("order_score", F.coalesce("linked", F.lit(0.0)) + c.clamp(F.col("score")) / 2)
    return top_k(ranked, k, score="order_score").select("query_id", "doc_id", "score", "rank")


def unified(topics: DataFrame, fragments: DataFrame, timelines: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """topics, fragments, timelines: query_id, id, score. Topics first; fragments next; timelines only for queries without fragments (all of them
    where there is no topic either). Returns query_id, kind, id, score, place: at most k a query."""
    has = lambda df, name: df.select("query_id", F.lit(True).alias(name)).distinct()
    state = queries.select("query_id").join(has(topics, "t"), "query_id", "left").join(has(fragments, "f"), "query_id", "left")
    part = lambda df, kind, order: df.select("query_id", F.lit(kind).alias("kind"), F.lit(order).alias("o"), "id", "score")
    rows = part(topics, "topic", 3).unionByName(part(fragments, "fragment", 2)).unionByName(part(timelines, "timeline", 1)).join(state, "query_id")
    rows = rows.where((F.col("kind") != "timeline") | F.col("f").isNull()).where((F.col("kind") != "fragment") | F.col("t"))
    ranked = rows.withColumn("key", F.col("o") * 10 + c.clamp(F.col("score")))
    return top_k(ranked, k, score="key", ids=("id",), rank="place").select("query_id", "kind", "id", "score", "place")

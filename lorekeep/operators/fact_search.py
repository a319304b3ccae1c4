"""Search in facts: keywords weighed by decay, and containment for the queries that keywords leave empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import SENT_TERMS, bm25, in_scope, top_k
from .tables import checkpointed

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters, found in one pass by an empty match that looks ahead."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def containing(facts: DataFrame, queries: DataFrame, scope: tuple[str, ...] = (), newest: int | None = None) -> DataFrame:
    """(query_id, doc_id): facts whose content holds a part of a query, in any case. facts: doc_id, content, scope columns; queries: query_id, parts (array), scope
    columns, null for no restriction. With `newest`, at least the facts of highest id are there, that many of each query.

    Each part is looked up once, by its rarest substring of three characters (of all of it where it is shorter): only facts that have that one are compared.
    Facts are read twice, to count substrings and to compare; neither their substrings nor their contents are shuffled."""
    parts = queries.select("query_id", *[F.col(x).alias("__q_" + x) for x in scope], F.explode("parts").alias("part")).withColumn("part", F.lower("part")).where(F.length("part") > 0)
    parts = checkpointed(parts.withColumn("n", F.least(F.lit(GRAM), F.length("part"))))
    needed = parts.select("part", "n", F.explode(F.coalesce(*[F.when(F.col("n") == n, _grams(F.col("part"), n)) for n in range(1, GRAM + 1)])).alias("gram")).distinct()
    needed = checkpointed(needed)
    wanted = needed.select("gram").distinct()
    sent = lambda df: F.broadcast(df) if df.limit(SENT_TERMS + 1).count() <= SENT_TERMS else df
    low = facts.select("doc_id", *scope, F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    own = low.select("doc_id", *scope, "content", F.explode(F.concat(*[_grams(F.col("content"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    held = own.select("gram").join(sent(wanted), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rarest = needed.join(held, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("least")).where("least.df > 0").select("part", F.col("least.gram").alias("gram"))
    rarest = checkpointed(rarest)
    hits = own.join(sent(rarest), "gram").where(F.contains(F.col("content"), F.col("part"))).select("part", *scope, "doc_id")
    if newest:
        hits = top_k(hits, newest, by=["part", *scope], score="doc_id", ids=(), rank="__n").drop("__n")
    return parts.join(hits, "part").where(in_scope(scope)).select("query_id", "doc_id").distinct()


def fact_search(facts: DataFrame, queries: DataFrame, k: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, base, score, found_by, rank): the k best facts. facts: doc_id, content, tokens, temporal (decay) and scope columns; queries: query_id,
    tokens, parts and scope columns.

    The 2 k best by keywords, normalised, times their decay. A query without any takes the 2 k newest (highest id) of the facts that contain one of its parts;
    these count alike, so decay orders them."""
    keyed = checkpointed(bm25(facts, queries, 2 * k, scope=scope).select("query_id", "doc_id", F.col("score").alias("base"), F.lit("keywords").alias("found_by")))
    empty = queries.join(keyed.select("query_id").distinct(), "query_id", "left_anti")
    found = containing(facts, empty, scope, 2 * k).withColumn("__new", F.col("doc_id"))
    newest = top_k(found, 2 * k, score="__new").select("query_id", "doc_id", F.lit(1.0).alias("base"), F.lit("containment").alias("found_by"))
    both = keyed.unionByName(newest).join(facts.select("doc_id", "temporal"), "doc_id")
    return top_k(both.withColumn("score", F.round(F.col("base") * F.col("temporal"), 9)), k).select("query_id", "doc_id", "base", "score", "found_by", "rank")

"""Ranking memories for many queries at once: keyword and vector routes, fusion, weighting, diversity, gates.

Tables: queries (query_id, ...), candidates (query_id, doc_id, score). All joins are on keys; top-k is a row_number filter, which
Spark applies before and after the shuffle. Ties are always broken by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from .tables import checkpointed
from .vector_blocks import best_rows, met, slices


def top_k(df: DataFrame, k: int, by: list[str] | None = None, score: str = "score", ids: tuple[str, ...] = ("doc_id",), rank: str = "rank") -> DataFrame:
    """The k best rows of each group, with their rank from 1."""
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.col(score).desc(), *ids)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def widened(k: int, factor: int = 2, most: int = 100) -> int:
    return min(most, k * factor)


#: Rows up to which a table of query terms or of query vectors is sent to every executor; counted first, with another way beyond.
SENT_TERMS = 200_000
SENT_NUMBERS = 4_000_000


def in_scope(scope: tuple[str, ...], queries: str = "__q_") -> Column:
    """A query meets the rows of its scope; a null scope of a query meets all. Query columns carry the prefix."""
    return reduce(lambda x, y: x & y, [F.col(queries + x).isNull() | (F.col(queries + x) == F.col(x)) for x in scope], F.lit(True))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, scope: tuple[str, ...] = (), normalise: bool = True, sent_terms: int = SENT_TERMS) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents for any token of a query.

    docs: doc_id, tokens and the scope columns; queries: query_id, tokens and the scope columns, null for no restriction. Scopes hold before
    the cut. Tokens are made once and written; totals, document frequencies and scores read that table. The query terms are counted: up to
    `sent_terms` they are sent to the scan, and no posting moves by its term, so a frequent word is no hot key; beyond, postings
    are shuffled by term, which Spark splits where a term is hot. Frequencies and totals are those of all documents, whatever the scope."""
    index = checkpointed(docs.select("doc_id", *scope, F.size("tokens").cast("long").alias("length"), "tokens"))
    terms = checkpointed(queries.select("query_id", *[F.col(x).alias("__q_" + x) for x in scope], F.explode(F.array_distinct("tokens")).alias("term")))
    totals = index.agg(F.count("*").alias("n"), F.avg("length").alias("avg")).first()
    n_docs, average = F.lit(totals["n"]), F.lit(float(totals["avg"] or 1.0))
    wanted = terms.select("term").distinct()
    send = F.broadcast if terms.limit(sent_terms + 1).count() <= sent_terms else (lambda x: x)
    rows = index.select("doc_id", *scope, "length", F.explode("tokens").alias("term")).join(send(wanted), "term", "left_semi")
    hits = checkpointed(rows.groupBy("doc_id", *scope, "length", "term").agg(F.count("*").alias("tf")))
    df_terms = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(df_terms, "term").withColumn("idf", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # by document, so that what a document's terms add to a query's score is summed where it lies, and only the k best of a task are sent on
    scored = hits.repartition("doc_id").join(send(weighed), "term").where(in_scope(scope))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
    best = top_k(scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score")), k)
    return min_max(best) if normalise else best


def min_max(df: DataFrame, score: str = "score") -> DataFrame:
    """Per query over the rows given: best 1, worst 0, all equal 1. So it depends on the cut before it."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(F.lit(1.0)))


def vector_top_k(items: DataFrame, queries: DataFrame, k: int, scope: tuple[str, ...] = (), sent_numbers: int = SENT_NUMBERS) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine, exact. items: doc_id, embedding and the scope columns; queries: query_id, embedding and the scope
    columns, null for no restriction, which holds before the cut.

    Queries are counted. Up to `sent_numbers` vector components they are sent to every executor as one matrix: items stream by, a batch
    meets the queries slice by slice, and passes on its k best a query with all ties. Beyond, queries and items are dealt to blocks
    (vector_blocks.met), whose products pass on the same."""
    wide = queries.select("query_id", *[F.col(x).alias("__q_" + x) for x in scope], c.unit(F.col("embedding")).alias("__q"))
    size = wide.agg(F.count("*").alias("n"), F.sum(F.size("__q")).alias("numbers")).first()
    if size["numbers"] and size["numbers"] <= sent_numbers and wide.schema["query_id"].dataType.simpleString() in ("bigint", "int", "string"):
        return top_k(_streamed_best(items, wide, k, scope), k)
    return top_k(met(items.select("doc_id", *scope, c.unit(F.col("embedding")).alias("__v")), wide, scope=scope, k=k), k)


def _streamed_best(items: DataFrame, wide: DataFrame, k: int, scope: tuple[str, ...]) -> DataFrame:
    import numpy as np

    sent = wide.toPandas()
    shared = items.sparkSession.sparkContext.broadcast((sent["query_id"].to_numpy(), np.array(sent["__q"].tolist(), float), [sent["__q_" + x].to_numpy() for x in scope]))
    kind = {x: wide.schema["query_id"].dataType.simpleString() if x == "query_id" else items.schema["doc_id"].dataType.simpleString() for x in ("query_id", "doc_id")}

    def best(batches):
        import pandas as pd

        ids, q, scopes = shared.value
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == q.shape[1] for v in pdf["embedding"]]]
            if pdf.empty:
                continue
            x = np.array(pdf["embedding"].tolist(), float)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            units = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            for start, scores in slices(q, units):
                part = slice(start, start + len(scores))
                for own, name in zip(scopes, scope):
                    free = np.array([v is None or v != v for v in own[part]])
                    scores[~((own[part, None] == pdf[name].to_numpy()[None, :]) | free[:, None])] = -np.inf
                at, row = np.nonzero(best_rows(scores, k))
                yield pd.DataFrame({"query_id": ids[at + start], "doc_id": pdf["doc_id"].to_numpy()[row], "score": scores[at, row]})

    return items.select("doc_id", *scope, "embedding").mapInPandas(best, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double")


def reciprocal_rank_fusion(routes: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): sum over routes of 1 / (constant + rank)."""
    rows = routes[0].select("query_id", "doc_id", "rank")
    for r in routes[1:]:
        rows = rows.unionByName(r.select("query_id", "doc_id", "rank"))
    return top_k(rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 12).alias("score")), k)


def weighted(fused: DataFrame, memories: DataFrame, now: float, alpha: float = 0.5, beta: float = 0.25, gamma: float = 0.25, rate: float = 0.01) -> DataFrame:
    """Final score of fused candidates from rank, importance and recency. memories: doc_id, importance, create_epoch, last_access_epoch.
    A candidate without a memory row stays, as one of importance 0.5 made now. The best rank score is taken over all fused candidates."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    reference = F.greatest(F.coalesce("create_epoch", F.lit(now)), F.coalesce("last_access_epoch", F.lit(0.0)))
    days = F.greatest(F.lit(0.0), (F.lit(now) - reference) / 86400)
    joined = fused.withColumn("__best", best).join(memories.select("doc_id", "importance", "create_epoch", "last_access_epoch"), "doc_id", "left")
    final = alpha * F.col("score") / F.col("__best") + beta * c.clamp(F.col("importance"), default=0.5) + gamma * F.exp(F.lit(-rate) * days)
    return joined.select("query_id", "doc_id", F.col("score").alias("rrf_score"), final.alias("final_score"))


def mmr(candidates: DataFrame, k: int, diversity: float = 0.3, keep_short: bool = True) -> DataFrame:
    """Greedy diverse choice: each round takes the best (1 - diversity) * score - diversity * (largest Jaccard with a chosen one).

    candidates: query_id, doc_id, score, features (array); all come in, so a group is what the routes before have cut to. With keep_short, a
    query of at most k candidates is returned in score order. Returns query_id, doc_id, score, position. Values are compared at nine digits."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = candidates.withColumn("__rank", F.row_number().over(order))

    def choose(pdf):
        pdf = pdf.sort_values(["__rank"]).reset_index(drop=True)
        sets, scores = [set(x) for x in pdf["features"]], pdf["score"].to_numpy()
        order, left = [], list(range(len(pdf)))
        if keep_short and len(pdf) <= k:
            order = left
        else:
            near = [0.0] * len(pdf)
            while left and len(order) < k:
                best = max(left, key=lambda i: (round((1 - diversity) * scores[i] - diversity * near[i], 9), -i))
                order.append(best)
                left.remove(best)
                for i in left:
                    union = len(sets[i] | sets[best])
                    near[i] = max(near[i], len(sets[i] & sets[best]) / union if union and sets[i] and sets[best] else 0.0)
        out = pdf.loc[order, ["query_id", "doc_id", "score"]].copy()
        out["position"] = range(1, len(order) + 1)
        return out

    return ranked.groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, score double, position int")


def hybrid(keyword: DataFrame, vector: DataFrame | None, memories: DataFrame, k: int, now: float) -> DataFrame:
    """Keyword and vector routes fused and weighted; a missing route leaves the other alone."""
    fused = reciprocal_rank_fusion([r for r in (keyword, vector) if r is not None], widened(k))
    return top_k(weighted(fused, memories, now), k, score="final_score")


def route_weights(text: Column, document: float = 0.6, graph: float = 0.4, terms: dict[str, list[str]] | None = None) -> Column:
    """Struct (document_weight, graph_weight, intent) by the kinds of words in a query."""
    terms = terms or INTENT_TERMS
    t = F.lower(F.coalesce(text, F.lit("")))
    has = lambda kind: F.array_max(F.array(*[t.contains(x) for x in terms[kind]]))
    relation, temporal, factual = has("relationship"), has("temporal"), has("factual") & ~has("relationship")
    shift = F.when(relation, 0.2).otherwise(0.0) + F.when(temporal, 0.1).otherwise(0.0) - F.when(factual, 0.15).otherwise(0.0)
    d, g = F.greatest(F.lit(0.15), F.least(F.lit(0.9), F.lit(document) - shift)), F.greatest(F.lit(0.1), F.least(F.lit(0.85), F.lit(graph) + shift))
    names = F.array_compact(F.array(F.when(relation, "relationship"), F.when(temporal, "temporal"), F.when(factual, "factual")))
    intent = F.when(F.size(names) == 0, "default").otherwise(F.array_join(names, "+"))
    return F.struct((d / (d + g)).alias("document_weight"), (g / (d + g)).alias("graph_weight"), intent.alias("intent"))


#: Words that tell what a query is about.
INTENT_TERMS = {
    "relationship": ["谁", "和谁", "关系", "认识", "朋友", "同事", "家人", "父母", "妈妈", "爸爸", "老师", "同学", "partner", "friend", "relationship", "with whom"],
    "temporal": ["上次", "昨天", "前天", "刚才", "之前", "什么时候", "哪天", "最近", "last time", "yesterday", "recently", "when"],
    "factual": ["是什么", "什么是", "解释", "定义", "怎么", "如何", "why", "what is", "explain", "define", "how to"],
}


def dual_route(document: DataFrame, graph: DataFrame, weights: DataFrame, k: int, bonus: float = 0.08) -> DataFrame:
    """Merge document and graph results (query_id, doc_id, final_score). weights: query_id, document_weight, graph_weight. A query
    without graph results keeps its document scores."""
    w = Window.partitionBy("query_id")
    d = document.select("query_id", "doc_id", F.col("final_score").alias("__d"), F.max("final_score").over(w).alias("__dmax"))
    g = graph.select("query_id", "doc_id", F.col("final_score").alias("__g"), F.max("final_score").over(w).alias("__gmax"))
    both = d.join(g, ["query_id", "doc_id"], "full").join(weights, "query_id")
    share = lambda x, most: F.coalesce(F.when(F.col(most) > 0, F.col(x) / F.col(most)), F.lit(0.0))
    extra = F.when(F.col("__d").isNotNull() & F.col("__g").isNotNull(), bonus).otherwise(0.0)
    merged = F.least(F.lit(1.0), F.col("document_weight") * share("__d", "__dmax") + F.col("graph_weight") * share("__g", "__gmax") + extra)
    has_graph = F.max(F.col("__g").isNotNull()).over(w)
    return top_k(both.withColumn("final_score", F.when(has_graph, merged).otherwise(F.col("__d"))).select("query_id", "doc_id", "final_score"), k, score="final_score")


def fuse_branches(hits: DataFrame, bonus: float = 0.03, most: float = 0.06) -> DataFrame:
    """hits: query_id, doc_id, branch, weight, score, relevance. Noisy-or over branches, plus a bonus for each further branch."""
    miss = lambda x: F.product(1 - c.clamp(F.col("weight") * F.round(x, 6)))
    extra = F.least(F.lit(most), (F.count("*") - 1) * bonus)
    return hits.groupBy("query_id", "doc_id").agg(c.clamp(1 - miss("score") + extra).alias("fused"), c.clamp(1 - miss("relevance")).alias("relevance"), F.count("*").alias("n_branches"))


def gates(candidates: DataFrame, minimum: float, relative: float, selection: float) -> DataFrame:
    """Adds filter_reason: absolute floor, then floor relative to the query's best, then the floor for selection; null passes."""
    best = F.max("relevance").over(Window.partitionBy("query_id"))
    r = F.col("relevance")
    return candidates.withColumn("filter_reason", F.when(r < minimum, "below_minimum").when(r < best * relative, "below_relative").when(r < selection, "below_selection"))


def query_branches(messages: DataFrame, now: float, max_age: float, last: int = 4) -> DataFrame:
    """(session_id, branch, weight, text): the newest user message, then recent user and assistant messages of the last few, not
    older than max_age seconds, each text once."""
    recent = messages.where(F.col("ts_epoch") >= now - max_age)
    order = Window.partitionBy("session_id").orderBy(F.col("ts_epoch").desc(), F.col("id").desc())
    recent = recent.where(F.col("role").isin("user", "assistant")).withColumn("__n", F.row_number().over(order))
    newest_user = F.min(F.when(F.col("role") == "user", F.col("__n"))).over(Window.partitionBy("session_id"))
    recent = recent.withColumn("__current", newest_user)
    current = recent.where(F.col("__n") == F.col("__current")).select("session_id", F.lit("current").alias("branch"), F.lit(1.0).alias("weight"), F.col("content").alias("text"))
    others = recent.where(F.col("__current").isNotNull() & (F.col("__n") > F.col("__current")) & (F.col("__n") <= F.col("__current") + last))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("__n", "content"))), lambda x: x["content"])
    joined = others.groupBy("session_id", "role").agg(F.array_join(F.array_distinct(texts), " | ").alias("text"))
    context = joined.select("session_id", F.concat(F.lit("recent_"), F.col("role")).alias("branch"), F.when(F.col("role") == "user", 0.45).otherwise(0.40).alias("weight"), "text")
    return current.unionByName(context)


def context_coverage(sources: DataFrame, visible: DataFrame) -> DataFrame:
    """Share of each item's source spans (item_id, session_id, start_index, end_index) that overlap the session's visible span
    (session_id, lo, hi); relevance is scaled by 1 - 0.25 * coverage where it is partial."""
    hit = sources.join(visible, "session_id", "left").withColumn("__in", F.coalesce((F.col("start_index") <= F.col("hi")) & (F.col("end_index") >= F.col("lo")), F.lit(False)))
    return hit.groupBy("item_id").agg(F.avg(F.col("__in").cast("double")).alias("coverage")).withColumn("scale", F.when(F.col("coverage") >= 1, 0.0).otherwise(1 - 0.25 * F.col("coverage")))


def merge_best(results: list[DataFrame], score: str = "final_score") -> DataFrame:
    """Results of several scopes, each id once with its best score."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    return rows.groupBy("query_id", "doc_id").agg(F.max(score).alias(score))


def rerank_ranks(df: DataFrame) -> DataFrame:
    """df: query_id, item_id, score. Min-rank of ties, percentile (0 for a single result) and the response's confidence."""
    w = Window.partitionBy("query_id")
    n, rank = F.count("*").over(w), F.rank().over(w.orderBy(F.col("score").desc()))
    out = df.withColumn("rank", rank).withColumn("percentile", F.when(n == 1, 0.0).otherwise((n - rank) / (n - 1)))
    stats = df.groupBy("query_id").agg(F.max("score").alias("__top"), F.percentile("score", F.lit(0.5)).alias("__mid"))
    contrast = c.clamp((F.col("__top") - F.col("__mid")) / 0.15)
    return out.join(stats, "query_id").withColumn("confidence", F.sqrt(c.clamp(F.col("__top")) * contrast)).drop("__top", "__mid")


def relative_rank(df: DataFrame, by: list[str]) -> DataFrame:
    """Average rank of ties as a percentile in [0, 1]; 1 for a single row. df: by, score."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    rank = F.rank().over(w.orderBy(F.col("score").desc())) + (F.count("*").over(Window.partitionBy(*by, "score")) - 1) / 2
    return df.withColumn("percentile", F.when(n == 1, 1.0).otherwise((n - rank) / (n - 1)))


def topic_relevance(cosine: Column, coverage: Column) -> Column:
    return 0.82 * cosine + 0.18 * coverage


def access_record(log: DataFrame, memories: DataFrame, now: float) -> DataFrame:
    """Each consumed memory once: access_count + 1, last access now."""
    used = log.select("doc_id").distinct().withColumn("__used", F.lit(True))
    joined = memories.join(used, "doc_id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("__used", F.lit(False)).cast("int")).withColumn("last_access_epoch", F.when(F.col("__used"), F.lit(now)).otherwise(F.col("last_access_epoch"))).drop("__used")

"""Counts, catalogues and assemblies over topics, timelines, links, atoms and actors.

Tables: topics (topic_id, memory_space_id, title, revision, status, updated_at), timelines (timeline_id, session_id, memory_space_id, status,
updated_at), links (topic_id, timeline_id, revision, cluster_id, contribution, similarity, affinity, status), actors (topic_id, actor_id,
display_name). Each branch of a count is aggregated before it is joined, so that no branch multiplies another one's rows. Null keys join with
nothing; empty tables give empty results, or zeros where a left side has rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top_k


def status_counts(rows: DataFrame, by: str, known: list[str]) -> DataFrame:
    """(by, n): rows by status or type; a known value without rows has 0, an unknown one is listed too."""
    zeros = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, known))).alias(by), F.lit(0).cast("long").alias("n"))
    return rows.groupBy(by).agg(F.count("*").alias("n")).unionByName(zeros).groupBy(by).agg(F.sum("n").alias("n"))


def topic_support(topics: DataFrame, links: DataFrame) -> DataFrame:
    """Active timelines and distinct time clusters of each topic, the sum of contributions, and mean similarity and affinity."""
    active = links.where(F.col("status") == "active").groupBy("topic_id")
    per = active.agg(F.count("*").alias("n_timelines"), F.countDistinct("cluster_id").alias("n_clusters"), F.sum("contribution").alias("contribution"), F.avg("similarity").alias("similarity"), F.avg("affinity").alias("affinity"))
    zero = {x: 0 for x in ("n_timelines", "n_clusters", "contribution", "similarity", "affinity")}
    return topics.select("topic_id").join(per, "topic_id", "left").fillna(zero)


def memory_spaces(topics: DataFrame, timelines: DataFrame) -> DataFrame:
    """Active topics and timelines of each space, and its last update."""
    one = lambda df, key, name: df.where(F.col("status") == "active").groupBy("memory_space_id").agg(F.countDistinct(key).alias(name), F.max("updated_at").alias(f"at_{name}"))
    both = one(topics, "topic_id", "n_topics").join(one(timelines, "timeline_id", "n_timelines"), "memory_space_id", "full")
    return both.select("memory_space_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_topics", "n_timelines")], F.greatest("at_n_topics", "at_n_timelines").alias("updated_at"))


def space_overview(counted: dict[str, DataFrame]) -> DataFrame:
    """counted: name to a table with memory_space_id. One row a space with the number of rows in each table, 0 where it has none."""
    per = [df.groupBy("memory_space_id").agg(F.count("*").alias(name)) for name, df in counted.items()]
    return reduce(lambda a, b: a.join(b, "memory_space_id", "full"), per).fillna(0, list(counted))


def timeline_topics(timelines: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """(timeline_id, n_topics): how many active topics an active link ties to a timeline."""
    active = links.where(F.col("status") == "active").join(topics.where(F.col("status") == "active").select("topic_id"), "topic_id", "left_semi")
    return timelines.select("timeline_id").join(active.groupBy("timeline_id").agg(F.countDistinct("topic_id").alias("n_topics")), "timeline_id", "left").fillna(0, ["n_topics"])


def session_impact(timelines: DataFrame, links: DataFrame) -> DataFrame:
    """What a session would take along: its timelines, and the topics and links that rest on them."""
    own = timelines.groupBy("session_id").agg(F.countDistinct("timeline_id").alias("n_timelines"))
    tied = links.join(timelines.select("timeline_id", "session_id"), "timeline_id").groupBy("session_id").agg(F.countDistinct("topic_id").alias("n_topics"), F.count("*").alias("n_links"))
    return own.join(tied, "session_id", "left").fillna(0, ["n_topics", "n_links"])


def topics_with(actors: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: request_id, actor_ids (a JSON list). The (request_id, topic_id) of topics that name one of them."""
    asked = wanted.select("request_id", F.explode(F.from_json("actor_ids", "array<string>")).alias("actor_id")).groupBy("request_id").agg(F.array_sort(F.collect_set("actor_id")).alias("actor_ids"))
    # requests for the same actors share one list of topics, so what is found for a request is distinct already
    each = asked.select("actor_ids").distinct().select("actor_ids", F.explode("actor_ids").alias("actor_id"))
    found = actors.select("topic_id", "actor_id").distinct().join(each, "actor_id").select("actor_ids", "topic_id").distinct()
    # few bytes of requests make many rows, so they are dealt to all tasks
    dealt = asked.repartition(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_id")
    return dealt.join(found, "actor_ids").select("request_id", "topic_id")


def current_links(links: DataFrame, topics: DataFrame) -> DataFrame:
    """Active links of a topic's current revision only."""
    now = topics.where(F.col("status") == "active").select("topic_id", "revision")
    return links.where(F.col("status") == "active").join(now, ["topic_id", "revision"], "left_semi")


def payloads(topics: DataFrame, links: DataFrame, actors: DataFrame) -> DataFrame:
    """Each topic with its sources (timelines of active links) and actors as sorted arrays, empty where it has none."""
    sources = links.where(F.col("status") == "active").groupBy("topic_id").agg(F.array_sort(F.collect_set("timeline_id")).alias("sources"))
    named = actors.where(F.col("actor_id").isNotNull()).groupBy("topic_id").agg(F.array_sort(F.collect_set("actor_id")).alias("actors"))
    out = topics.select("topic_id", "title").join(sources, "topic_id", "left").join(named, "topic_id", "left")
    return out.select("topic_id", "title", F.coalesce("sources", F.array().cast("array<long>")).alias("sources"), F.coalesce("actors", F.array().cast("array<string>")).alias("actors"))


def actor_catalogue(actors: DataFrame) -> DataFrame:
    """(actor_key, resolved, name, n_topics): known actors by id; mentions without an id are one actor if their names fold to the same."""
    folded = F.lower(F.trim(F.regexp_replace(F.coalesce("display_name", F.lit("")), r"\s+", " ")))
    keyed = actors.withColumn("resolved", F.col("actor_id").isNotNull()).withColumn("actor_key", F.coalesce("actor_id", F.concat(F.lit("unresolved:"), folded)))
    return keyed.groupBy("actor_key", "resolved").agg(F.min(F.trim("display_name")).alias("name"), F.countDistinct("topic_id").alias("n_topics"))


def penalised(confidence: Column, repairs: Column, units: Column) -> Column:
    """Confidence less a penalty of at most 0.15 for the share of weighted repairs in the units."""
    share = F.least(F.lit(1.0), repairs / F.greatest(F.lit(1), units))
    return F.greatest(F.lit(0.0), confidence - F.least(F.lit(0.15), share * 0.12))


def session_spaces(timelines: DataFrame, topics: DataFrame, k: int = 10) -> DataFrame:
    """The k spaces that a session's active timelines feed and that have an active topic, newest first."""
    alive = topics.where(F.col("status") == "active").select("memory_space_id")
    per = timelines.where(F.col("status") == "active").join(alive, "memory_space_id", "left_semi").groupBy("session_id", "memory_space_id").agg(F.max("updated_at").alias("updated_at"))
    return top_k(per, min(max(1, k), 100), by=["session_id"], score="updated_at", ids=("memory_space_id",))


#: The marks of a chat-room prompt.
ROOM_HEAD = "You are now in a chatroom. The chat history is as follows:"
ROOM_NEW = "Now, a new message is coming:"


def actual_message(prompt: Column) -> Column:
    """The new message out of a chat-room prompt, between backticks and behind an optional line on the sender; any other text as it is."""
    found = F.regexp_extract(prompt, rf"(?s){ROOM_NEW}\s*`\s*(?:\[User ID:[^\]]+\]\s*\n)?(.+?)`", 1)
    return F.when(prompt.contains(ROOM_HEAD) & prompt.contains(ROOM_NEW) & (found != ""), F.trim(found)).otherwise(prompt)


def by_time(candidates: DataFrame, k: int, order: str) -> DataFrame:
    """The k earliest or latest candidates (query_id, doc_id, started_at, ended_at) of a query, whatever their relevance. Earliest goes by the
    start, else the end; latest by the end, else the start; those without a time come last."""
    if order not in ("earliest", "latest"):
        raise ValueError("order must be earliest or latest")
    first, second = ("started_at", "ended_at") if order == "earliest" else ("ended_at", "started_at")
    at = F.coalesce(F.col(first), F.col(second))
    score = F.coalesce(-at if order == "earliest" else at, F.lit(float("-inf")))
    return top_k(candidates.withColumn("score", score), k).drop("score")


#: Patterns that tell the kind of a fact.
FACT_PATTERNS = {
    "time": r"明天|后天|大后天|昨天|前天|今天|(?:上周|本周|下下周|下周)?周[一二三四五六日天]|上周|本周|下下周|下周|下个?月|上个?月|明年|后年|去年|前年|\d{1,2}月\d{1,2}[日号]|\d{4}年\d{1,2}月|上午|下午|晚上|凌晨|早上|中午|傍晚|\d{1,2}[点时：:]\d{1,2}",
    "action": r"开会|讨论|参加|组织|安排|举办|进行|执行|完成|提交|发送|发布|去|来|到|做|要|准备|计划|打算",
    "stative": r"是|有|属于|等于|代表|意味|包含|包括|位于",
    "relation": r"同事|朋友|同学|家人|亲戚|队友|搭档|伙伴|老板|上司|下属|合作|合伙|夫妻|情侣|邻居|室友|老乡",
    "preference": r"喜欢|讨厌|爱|不爱|偏好|最爱|不喜欢|热衷于|沉迷|爱吃|爱喝|喜欢喝|喜欢去|讨厌吃|讨厌去",
}
#: Kinds of facts in the order of their rules, with the confidence of each.
FACT_KINDS = [("planned", ("time", "action"), 0.85), ("preference", ("preference",), 0.82), ("relational", ("relation",), 0.80), ("factual", ("stative",), 0.78), ("episodic", ("action",), 0.75), ("unknown", (), 0.60)]


def fact_kind(fact: Column, patterns: dict[str, str] | None = None) -> Column:
    """Struct (kind, confidence): the first kind all of whose patterns the fact has. patterns: others, for other languages."""
    patterns = patterns or FACT_PATTERNS
    kinds = []
    for kind, needs, confidence in FACT_KINDS:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
        kinds.append(F.when(reduce(lambda a, b: a & b, [fact.rlike(patterns[x]) for x in needs], F.lit(True)), value))
    return F.coalesce(*kinds)

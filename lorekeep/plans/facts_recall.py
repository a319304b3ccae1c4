"""Queries on fact times and topic recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import facts, recall, retrieval
from ..operators.tables import checkpointed
from .fixtures import NOW, table, view, with_views
from .recall import query


#: Phrases of every kind, and what each means of ts in SQL.
SAID = [
    ("三天前", "ts - interval 3 day"), ("2小时后", "ts + interval 2 hour"), ("二十五分钟前", "ts - interval 25 minute"), ("两周后", "ts + interval 14 day"), ("一个月前", "ts - interval 30 day"), ("2年后", "ts + interval 730 day"),
    ("明天", "ts + interval 1 day"), ("大后天", "ts + interval 3 day"), ("昨天晚上八点见面", "date_trunc('day', ts) - interval 4 hour"), ("前天凌晨12点", "date_trunc('day', ts) - interval 2 day"),
    ("周五", "ts + to_days(cast(5 - isodow(ts) as int))"), ("上周周日下午两点半", "date_trunc('day', ts) + to_days(cast(0 - isodow(ts) as int)) + interval 14 hour"), ("下周一", "ts + to_days(cast(1 - isodow(ts) as int))"), ("下下周周三", "ts + to_days(cast(17 - isodow(ts) as int))"),
    ("2026年7月28日下午三点十五分开会", "timestamp '2026-07-28 15:15:00'"), ("2024-03-05", "timestamp '2024-03-05 00:00:00'"), ("2024-13-40", "cast(null as timestamp)"), ("6月1日9点", "make_timestamp(year(ts), 6, 1, 9, 0, 0)"), ("nothing", "cast(null as timestamp)"),
]


@query(f"""with e as (select event_id, case event_id % {len(SAID)} {' '.join(f'when {k} then {sql}' for k, (_, sql) in enumerate(SAID))} end as event_ts from events)
select event_id, cast(floor(epoch(event_ts)) as bigint) as event_s from e""")
def event_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.get(F.array(*[F.lit(text) for text, _ in SAID]), (F.col("event_id") % len(SAID)).cast("int"))
    return e.withColumn("said", said).select("event_id", F.unix_timestamp(facts.event_time(F.col("said"), F.col("ts").cast("timestamp"), "UTC")).alias("event_s"))


@query(with_views("fx_messages") + """, f as (select id // 1000 as memory_id, role as fact, id, ts_epoch from fx_messages), w as (select memory_id, fact, min(case when id % 2 = 0 then ts_epoch end) as lo, max(case when id % 2 = 0 then ts_epoch end) as hi, count(*) filter (id % 2 = 0) as n_refs from f group by all)
select memory_id, fact, coalesce(lo, 5) as start_s, coalesce(hi, 9) as end_s, case when lo is null then 'source_window' else 'messages' end as basis, n_refs from w""")
def fact_windows(spark, sf_dir):
    m = view(spark, sf_dir, "fx_messages").withColumn("memory_id", F.floor(F.col("id") / 1000)).withColumn("fact", F.col("role"))
    refs = m.where("id % 2 = 0").select("memory_id", "fact", F.col("id").alias("message_id"))
    return facts.fact_windows(m.select("memory_id", "fact", F.lit(9.0).alias("window_start_s"), F.lit(5.0).alias("window_end_s")).distinct(), refs, m)


@query()
def bound_facts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    f = d.select(F.col("doc_id").alias("memory_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "fact")).withColumn("start_s", F.lit(NOW))
    return facts.bind_anchors(d.select(F.col("doc_id").alias("memory_id"), "text"), f)


@query()
def topic_recall(spark, sf_dir):
    """Topics by vector, with support from a second branch, then fragments and timelines around them."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = view(spark, sf_dir, "fx_vector_queries")
    hits = checkpointed(retrieval.vector_top_k(items, queries, 30))  # read twice below
    branches = hits.select("query_id", F.col("doc_id").alias("topic_id"), F.lit("current").alias("branch"), F.lit(1.0).alias("weight"), "score").unionByName(hits.where("rank % 2 = 0").select("query_id", F.col("doc_id").alias("topic_id"), F.lit("recent_user").alias("branch"), F.lit(0.45).alias("weight"), "score"))
    supported = recall.context_support(branches).withColumn("actor_hit", F.col("topic_id") % 5 == 0).withColumn("affect", F.lit(0.0))
    known = items.select(F.col("doc_id").alias("topic_id"), (F.col("doc_id") % 10 / 10).alias("importance_now"), F.lit(0.7).alias("confidence"))
    found = checkpointed(recall.topic_recall(supported, known, 5))
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    features = d.select("doc_id", c.retrieval_features(F.col("text")).alias("features"))
    asked = features.select(F.col("doc_id").alias("query_id"), F.col("features").alias("asked"))
    # a topic's fragments are the lines of its document, with the topic's vector; a fragment's id holds both
    lines = d.select(F.col("doc_id").alias("topic_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where("trim(line) <> ''")
    lines = lines.select("topic_id", (F.col("topic_id") * 1000000 + F.col("i")).alias("fragment_id"), c.retrieval_features(F.col("line")).alias("features"))
    near = found.select("query_id", "topic_id", F.col("relevance").alias("cosine")).join(lines, "topic_id").join(asked, "query_id")
    near = near.withColumn("terms", F.size(F.array_intersect("features", "asked")) / F.size("asked")).join(features.select(F.col("doc_id").alias("topic_id"), F.col("features").alias("parent_features")), "topic_id")
    fragments = recall.fragment_supplements(near, found, 3)
    # timelines are the documents of all hits; those of a recalled topic's label are linked to it
    tops = found.select("query_id", "topic_id").join(features.withColumnRenamed("doc_id", "topic_id"), "topic_id")
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    one, two = labels.select(F.col("vec_id").alias("topic_id"), "label"), labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("other"))
    links = tops.select("query_id", "topic_id").join(hits.select("query_id", "doc_id"), "query_id").join(one, "topic_id").join(two, "doc_id").where("label = other").select("topic_id", "doc_id").distinct()
    timelines = recall.timeline_supplements(hits.select("query_id", "doc_id", "score").join(features, "doc_id"), tops, links, 8)
    return recall.unified(found.select("query_id", F.col("topic_id").alias("id"), "score"), fragments.select("query_id", F.col("fragment_id").alias("id"), "score"), timelines.select("query_id", F.col("doc_id").alias("id"), "score"), queries, 8)



"""Views over the given tables that stand for the library's own tables. The same text runs in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: All ages and decays are taken at this time, 2024-07-01 UTC.
NOW = 1719792000.0

VIEWS = {
    "fx_messages": "select conv_id * 1000 + turn as id, 'bot' || cast(conv_id % 7 as string) || ':FriendMessage:u' || cast(conv_id as string) as session_id, role, text as content, case when role = 'user' then 'u' || cast(conv_id as string) else 'bot' || cast(conv_id % 7 as string) end as sender_id, cast(1704067200 + conv_id * 1800 + turn * 600 as double) as ts_epoch from {conversations}",
    "fx_memories": "select doc_id, text, source as session_id, lang as persona_id, cast(doc_id * 37 % 100 as double) / 100 as importance, cast(1704067200 + (doc_id % 90) * 86400 as double) as create_epoch, cast(1704067200 + (doc_id % 45) * 172800 as double) as last_access_epoch, doc_id % 12 as access_count, case when doc_id % 17 = 0 then 'archived' when doc_id % 23 = 0 then 'deleted' else 'active' end as status from {documents}",
    "fx_queries": "select item_id as query_id, text as query_text from {benchmark}",
    "fx_vector_queries": "select vec_id as query_id, embedding from {embeddings} where vec_id % 50 = 0",
    "fx_topics": "select vec_id as topic_id, embedding, label, 'space' || cast(vec_id % 3 as string) as memory_space_id from {embeddings}",
    "fx_entities": "select l.l_orderkey as memory_id, l.l_linenumber as pos, p.p_brand as topic, p.p_name as fact, s.s_name as person from {lineitem} l join {part} p on l.l_partkey = p.p_partkey join {supplier} s on l.l_suppkey = s.s_suppkey",
    "fx_spans": "select event_id as memory_id, user_id as memory_space_id, ts as started_at, value as minutes from {events}",
    "fx_changes": "select event_id as sequence, user_id as scope, cast(user_id as string) || '-' || event_type as timeline_uid, case event_type when 'error' then 'delete' when 'signup' then 'restore' else 'upsert' end as operation, value from {events}",
    "fx_aliases": "select distinct conv_id as alias_id, conv_id - 1 as canonical_id from {conversations} where conv_id % 8 <> 0",
    "fx_topic_rows": "select p_partkey as topic_id, 'space' || cast(p_partkey % 5 as string) as memory_space_id, p_brand as title, p_partkey % 3 as revision, case when p_partkey % 7 = 0 then 'archived' else 'active' end as status, cast(1704067200 + p_partkey * 3600 as double) as updated_at from {part}",
    "fx_timelines": "select o_orderkey as timeline_id, 's' || cast(o_custkey as string) as session_id, 'space' || cast(o_custkey % 5 as string) as memory_space_id, case when o_orderstatus = 'P' then 'deleted' else 'active' end as status, cast(1704067200 + o_orderkey * 60 as double) as updated_at from {orders}",
    "fx_links": "select l_partkey as topic_id, l_orderkey as timeline_id, max(l_linenumber % 3) as revision, l_orderkey % 40 as cluster_id, avg(cast(l_discount as double)) * 5 as contribution, avg(cast(l_tax as double)) * 10 as similarity, max(cast(l_quantity as double)) / 50 as affinity, max(case when l_linestatus = 'O' then 'active' else 'archived' end) as status from {lineitem} group by l_partkey, l_orderkey, l_orderkey % 40",
    "fx_actors": "select l_partkey as topic_id, case when s_suppkey % 4 = 0 then null else cast(s_suppkey as string) end as actor_id, case when s_suppkey % 4 = 0 then case when s_suppkey % 8 = 0 then ' Nobody  Known' else 'nobody known' end else s_name end as display_name from {lineitem} join {supplier} on l_suppkey = s_suppkey",
    "fx_judgements": "select doc_id, quality as relevant, toxic as forbidden from {labels}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def with_views(*names: str) -> str:
    """A WITH list of the views, in DuckDB's words; more common tables and a select may follow."""
    return "with " + ", ".join(f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)

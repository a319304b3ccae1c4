"""Repeated contexts, clusters that grow, exports, and the upkeep of topics and fragments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import profiles, topics
from ..sources import transfer
from .fixtures import table, view, with_views
from .recall import query

_EVIDENCE = "user_id % 50 as profile, event_id as ref, event_id - event_id % 3 as timeline, event_type as term, case when event_id % 11 > 0 then hour(ts) * 60 + minute(ts) end as minute"


@query(f"""with ev as (select {_EVIDENCE}, epoch(ts) as at_s from events), np as (select profile, count(distinct ref) as n_all from ev group by 1),
ok as (select profile, term, count(distinct ref) as df, any_value(n_all) as n_all from ev join np using (profile) group by all), e as (select ev.*, df from ev join ok using (profile, term) where minute is not null and df >= 4 and df < greatest(3, 0.9 * n_all)),
p as (select s.profile, s.term, s.df, s.ref as seed, o.timeline, o.ref, o.at_s, least(abs(s.minute - o.minute), 1440 - abs(s.minute - o.minute)) as gap from e s join e o on s.profile = o.profile and s.term = o.term),
m as (select * from p where gap <= 30 qualify row_number() over (partition by profile, term, seed, timeline order by gap, ref) = 1),
st as (select profile, term, df, seed, list(ref order by ref) as refs, count(*) as n, (max(at_s) - min(at_s)) / 86400 as days from m group by all having count(*) >= 4 and (max(at_s) - min(at_s)) / 86400 + 1e-9 >= 1),
un as (select * exclude (seed) from st qualify row_number() over (partition by profile, refs order by df, term) = 1), cl as (select profile, list(ref) as held from ev where term = 'click' group by 1),
fr as (select un.* from un left join cl using (profile) where held is null or len(list_intersect(refs, held)) < n)
select profile, term, array_to_string(refs, ',') as refs, n, round(days, 6) as days, row_number() over (partition by profile order by n desc, days desc, df, term, refs) as rank from fr qualify rank <= 4""")
def context_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of events of one kind at one time of day; all clicks are in a cluster already."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ev = e.selectExpr(*[x.strip() for x in _EVIDENCE.split(", ")], "double(unix_micros(ts)) / 1e6 as at_s")
    held = ev.where("term = 'click'").select("profile", F.lit("clicks").alias("cluster"), "ref")
    out = profiles.context_candidates(ev, held, minutes=30, min_timelines=4, min_days=1.0)
    return out.select("profile", "term", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"), "n", F.round("days", 6).alias("days"), "rank")


@query("""with ev as (select distinct o_custkey % 100 as profile, o_orderkey as timeline, l_suppkey as term, o_custkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey),
cl as (select distinct 'k' || o_custkey as cluster, profile, term, timeline from ev where o_custkey % 10 = 0 and l_linenumber = 1), an as (select distinct cluster, profile, term from cl),
s as (select an.cluster, an.profile, ev.timeline, count(distinct ev.term)::double as score from an join ev using (profile, term) where not exists (select 1 from cl where cl.cluster = an.cluster and cl.timeline = ev.timeline) group by all)
select cluster, profile, timeline, score, row_number() over (partition by cluster order by score desc, timeline) as rank from s qualify rank <= 24""")
def cluster_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of every tenth customer's first lines, with orders of their profile that share a supplier."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    ev = both.select((F.col("o_custkey") % 100).alias("profile"), F.col("o_orderkey").alias("timeline"), F.col("l_suppkey").alias("term"), "o_custkey", "l_linenumber")
    clusters = ev.where("o_custkey % 10 = 0 and l_linenumber = 1").select(F.concat(F.lit("k"), "o_custkey").alias("cluster"), "profile", "term", "timeline").distinct()
    return profiles.expand_clusters(clusters, ev.select("profile", "timeline", "term").distinct())


@query(with_views("fx_memories") + """, s as (select conv_id as doc_id, to_json(list(struct_pack(turn, role) order by turn)) as m from conversations group by 1)
select doc_id as original_id, sha256(case when regexp_matches(text, '^[=+\\-@\\t\\r]') then chr(39) || text else text end) as content, session_id, persona_id, coalesce(case when doc_id % 3 = 0 then 0.25::double end, importance) as importance, '{"status":"' || status || '"}' as metadata, m::varchar as source_messages from fx_memories left join s using (doc_id)""")
def portable_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories as they leave: base importance first, no internal keys, formulas quoted, messages kept with them."""
    m = view(spark, sf_dir, "fx_memories").withColumns({"base_importance": F.when(F.col("doc_id") % 3 == 0, 0.25), "metadata": F.create_map(F.lit("status"), F.col("status"), F.lit("index_state"), F.lit("ready"))})
    kept = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("memory_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("messages"))
    return transfer.portable(m, kept).withColumn("content", F.sha2(c.csv_safe(F.col("text")), 256)).drop("text")


_SPAN = "case when event_id % 5 > 0 then event_id * 60.0 end as a, case when event_id % 7 > 0 then event_id * 60.0 + value * 60 - 3000 end as b"


@query(f"with s as (select event_id, {_SPAN} from events), t as (select event_id, coalesce(a, b) as a, coalesce(b, a) as b from s) select event_id, coalesce(least(a, b) <= 240000 and greatest(a, b) >= 60000, false) as meets from t")
def range_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a span with open or reversed ends meets a range."""
    s = table(spark, sf_dir, "events").selectExpr("event_id", f"struct({_SPAN}) as s")
    return s.select("event_id", c.overlaps(F.col("s.a"), F.col("s.b"), F.lit(60000.0), F.lit(240000.0)).alias("meets"))


@query(with_views("fx_topic_rows", "fx_links") + """, gone as (select topic_id from fx_topic_rows where status = 'archived' and topic_id % 2 = 0), kept as (select topic_id, timeline_id from fx_links where topic_id not in (select topic_id from gone)),
lost as (select distinct timeline_id from fx_links where topic_id in (select topic_id from gone) and timeline_id not in (select timeline_id from kept))
select 'topic' as kind, topic_id, null::bigint as fragment_id from fx_topic_rows where topic_id not in (select topic_id from gone) union all select 'link', topic_id, timeline_id from kept
union all select 'fragment', null, o_orderkey from orders where o_orderkey not in (select timeline_id from lost)""")
def archived_topics_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when every second archived topic goes for good: topics, links, and fragments but those that only such a topic held."""
    links = view(spark, sf_dir, "fx_links").select("topic_id", F.col("timeline_id").alias("fragment_id"))
    t = view(spark, sf_dir, "fx_topic_rows")
    left = topics.drop_archived(t, links, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fragment_id")), t.where("topic_id % 2 = 0").select("topic_id"))
    none = F.lit(None).cast("long")
    parts = [("topic", left[0], F.col("topic_id"), none), ("link", left[1], F.col("topic_id"), F.col("fragment_id")), ("fragment", left[2], none, F.col("fragment_id"))]
    rows = [df.select(F.lit(kind).alias("kind"), a.alias("topic_id"), b.alias("fragment_id")) for kind, df, a, b in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("with f as (select distinct l_orderkey::varchar as uid, l_returnflag || l_linestatus as semantic from lineitem) select uid, semantic, case when count(*) over (partition by uid) > 1 then sha1(uid || ':' || semantic) else uid end as final_uid from f")
def fragment_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of one uid but different meaning get uids of their own."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("uid"), F.concat("l_returnflag", "l_linestatus").alias("semantic")).distinct()
    return topics.collision_free(f)

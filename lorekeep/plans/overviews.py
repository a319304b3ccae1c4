"""Queries on overviews of topics, timelines and actors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import audit
from ..operators import overviews as o
from .conversations import _scan_sql
from .fixtures import table, view, with_views
from .recall import query

ALL = with_views("fx_topic_rows", "fx_timelines", "fx_links", "fx_actors")


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(view(spark, sf_dir, x) for x in ("fx_topic_rows", "fx_timelines", "fx_links", "fx_actors"))


@query(ALL + ", k as (select unnest(['active', 'archived', 'deleted']) as status), n as (select status, count(*) as n from fx_timelines group by 1) select status, coalesce(n, 0) as n from k full join n using (status)")
def status_counts(spark, sf_dir):
    return o.status_counts(_views(spark, sf_dir)[1], "status", ["active", "archived", "deleted"])


@query(ALL + """, p as (select topic_id, count(*) as n_timelines, count(distinct cluster_id) as n_clusters, sum(contribution) as contribution, avg(similarity) as similarity, avg(affinity) as affinity from fx_links where status = 'active' group by 1)
select topic_id, coalesce(n_timelines, 0) as n_timelines, coalesce(n_clusters, 0) as n_clusters, round(coalesce(contribution, 0), 6) as contribution, round(coalesce(similarity, 0), 6) as similarity, round(coalesce(affinity, 0), 6) as affinity from fx_topic_rows left join p using (topic_id)""")
def topic_support(spark, sf_dir):
    t, _, links, _ = _views(spark, sf_dir)
    return o.topic_support(t, links).select("topic_id", "n_timelines", "n_clusters", *[F.round(x, 6).alias(x) for x in ("contribution", "similarity", "affinity")])


@query(ALL + """, t as (select memory_space_id, count(*) as n_topics, max(updated_at) as a from fx_topic_rows where status = 'active' group by 1), l as (select memory_space_id, count(*) as n_timelines, max(updated_at) as b from fx_timelines where status = 'active' group by 1)
select memory_space_id, coalesce(n_topics, 0) as n_topics, coalesce(n_timelines, 0) as n_timelines, greatest(a, b) as updated_at from t full join l using (memory_space_id)""")
def memory_spaces(spark, sf_dir):
    t, timelines, _, _ = _views(spark, sf_dir)
    return o.memory_spaces(t, timelines)


@query(ALL + """, a as (select memory_space_id, count(*) as topics from fx_topic_rows group by 1), b as (select memory_space_id, count(*) as timelines from fx_timelines group by 1), c as (select memory_space_id, count(*) as links from fx_links join fx_timelines using (timeline_id) group by 1),
d as (select memory_space_id, count(*) as actors from fx_actors join fx_topic_rows using (topic_id) group by 1)
select memory_space_id, coalesce(topics, 0) as topics, coalesce(timelines, 0) as timelines, coalesce(links, 0) as links, coalesce(actors, 0) as actors from a full join b using (memory_space_id) full join c using (memory_space_id) full join d using (memory_space_id)""")
def space_overview(spark, sf_dir):
    t, timelines, links, actors = _views(spark, sf_dir)
    return o.space_overview({"topics": t, "timelines": timelines, "links": links.join(timelines.select("timeline_id", "memory_space_id"), "timeline_id"), "actors": actors.join(t.select("topic_id", "memory_space_id"), "topic_id")})


@query(ALL + ", n as (select l.timeline_id, count(distinct l.topic_id) as n from fx_links l join fx_topic_rows t on l.topic_id = t.topic_id and t.status = 'active' where l.status = 'active' group by 1) select timeline_id, coalesce(n, 0) as n_topics from fx_timelines left join n using (timeline_id)")
def timeline_topics(spark, sf_dir):
    t, timelines, links, _ = _views(spark, sf_dir)
    return o.timeline_topics(timelines, links, t)


@query(ALL + """, a as (select session_id, count(distinct timeline_id) as n_timelines from fx_timelines group by 1), b as (select session_id, count(distinct topic_id) as n_topics, count(*) as n_links from fx_links join fx_timelines using (timeline_id) group by 1)
select session_id, n_timelines, coalesce(n_topics, 0) as n_topics, coalesce(n_links, 0) as n_links from a left join b using (session_id)""")
def session_impact(spark, sf_dir):
    _, timelines, links, _ = _views(spark, sf_dir)
    return o.session_impact(timelines, links)


@query(ALL + ", w as (select c_custkey as request_id, cast(c_custkey % 10 + 1 as varchar) as a, cast(c_custkey % 7 + 1 as varchar) as b from customer) select distinct request_id, topic_id from w join fx_actors on actor_id in (a, b)")
def topics_with_actors(spark, sf_dir):
    one = lambda n: F.concat(F.lit('"'), (F.col("c_custkey") % n + 1).cast("string"), F.lit('"'))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("["), one(10), F.lit(","), one(7), F.lit("]")).alias("actor_ids"))
    return o.topics_with(_views(spark, sf_dir)[3], wanted)


@query(ALL + " select l.topic_id, l.timeline_id from fx_links l join fx_topic_rows t on l.topic_id = t.topic_id and l.revision = t.revision where l.status = 'active' and t.status = 'active'")
def current_links(spark, sf_dir):
    t, _, links, _ = _views(spark, sf_dir)
    return o.current_links(links, t).select("topic_id", "timeline_id")


@query(ALL + """, s as (select topic_id, list_sort(list(distinct timeline_id)) as sources from fx_links where status = 'active' group by 1), a as (select topic_id, list_sort(list(distinct actor_id)) as actors from fx_actors where actor_id is not null group by 1)
select topic_id, title, coalesce(sources, []) as sources, coalesce(actors, []) as actors from fx_topic_rows left join s using (topic_id) left join a using (topic_id)""")
def topic_payloads(spark, sf_dir):
    t, _, links, actors = _views(spark, sf_dir)
    return o.payloads(t, links, actors)


@query(ALL + """, k as (select *, actor_id is not null as resolved, coalesce(actor_id, 'unresolved:' || lower(trim(regexp_replace(display_name, '\\s+', ' ', 'g')))) as actor_key from fx_actors)
select actor_key, resolved, min(trim(display_name)) as name, count(distinct topic_id) as n_topics from k group by 1, 2""")
def actor_catalogue(spark, sf_dir):
    return o.actor_catalogue(_views(spark, sf_dir)[3])


@query("select o_orderkey as topic_id, round(greatest(0, o_custkey % 100 / 100.0::double - least(0.15, least(1, (o_orderkey % 9)::double / greatest(1, o_custkey % 6)) * 0.12)), 6) as confidence from orders")
def quality_penalty(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("topic_id"), F.round(o.penalised(F.col("o_custkey") % 100 / 100, F.col("o_orderkey") % 9, F.col("o_custkey") % 6), 6).alias("confidence"))


@query(ALL + """, a as (select distinct memory_space_id from fx_topic_rows where status = 'active'), p as (select session_id, memory_space_id, max(updated_at) as updated_at from fx_timelines join a using (memory_space_id) where status = 'active' group by 1, 2)
select *, row_number() over (partition by session_id order by updated_at desc, memory_space_id) as rank from p qualify rank <= 10""")
def session_spaces(spark, sf_dir):
    t, timelines, _, _ = _views(spark, sf_dir)
    return o.session_spaces(timelines, t).select("session_id", "memory_space_id", "updated_at", "rank")


@query("select conv_id, turn, case when (conv_id + turn) % 3 = 0 or trim(coalesce(text, ''), ' ') = '' then coalesce(text, '') when (conv_id + turn) % 3 = 1 then trim(text, ' ') else 'plain: ' || text end as message from conversations where not contains(coalesce(text, ''), '`')")
def actual_messages(spark, sf_dir):
    """Turns wrapped as chat-room prompts, with and without a sender, and turns as they are."""
    m = table(spark, sf_dir, "conversations").where(~F.coalesce("text", F.lit("")).contains("`")).withColumn("text", F.coalesce("text", F.lit("")))
    kind, empty = (F.col("conv_id") + F.col("turn")) % 3, F.trim("text") == ""
    sender = F.when(F.col("turn") % 2 == 0, "[User ID: 1, Nickname: x]\n").otherwise("")
    room = F.concat(F.lit(o.ROOM_HEAD + "\n---\n" + o.ROOM_NEW + " `\n"), sender, F.col("text"), F.lit("`.\nPlease react"))
    prompt = F.when((kind == 0) | empty, F.col("text")).when(kind == 1, room).otherwise(F.concat(F.lit("plain: "), F.col("text")))
    return m.select("conv_id", "turn", o.actual_message(prompt).alias("message"))


def _time_sql(score: str) -> str:
    return f"with e as (select user_id as query_id, event_id as doc_id, case when event_id % 4 > 0 then event_id * 37 % 1000 end as s, case when event_id % 6 > 0 then event_id * 37 % 1000 + event_id % 50 end as e from events) select query_id, doc_id, row_number() over (partition by query_id order by {score} desc nulls last, doc_id) as rank from e qualify rank <= 5"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") * 37 % 1000
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 4 > 0, at).cast("double").alias("started_at"), F.when(F.col("event_id") % 6 > 0, at + F.col("event_id") % 50).cast("double").alias("ended_at"))


@query(_time_sql("-coalesce(s, e)"))
def earliest_first(spark, sf_dir):
    return o.by_time(_timed(spark, sf_dir), 5, "earliest").select("query_id", "doc_id", "rank")


@query(_time_sql("coalesce(e, s)"))
def latest_first(spark, sf_dir):
    return o.by_time(_timed(spark, sf_dir), 5, "latest").select("query_id", "doc_id", "rank")


#: Facts of each kind, for the customers' names to stand in.
PHRASES = ["明天{}去开会", "{}喜欢喝茶", "{}和我是同事", "{}位于城里", "{}参加比赛", "{}", "下周三{}提交报告", "8月15日{}", "{}讨厌吃鱼", "{}的邻居很吵", "{}属于公司", "12:30 {}来"]
_KINDS = [("planned", "t and a", 0.85), ("preference", "p", 0.82), ("relational", "r", 0.80), ("factual", "s", 0.78), ("episodic", "a", 0.75), ("unknown", "true", 0.60)]


@query(f"""with f as (select c_custkey as atom_id, replace({PHRASES!r}[c_custkey % {len(PHRASES)} + 1], '{{}}', c_name) as fact from customer),
m as (select *, {', '.join(f"regexp_matches(fact, '{v}') as {k}" for k, v in zip("tasrp", o.FACT_PATTERNS.values(), strict=True))} from f)
select atom_id, case {' '.join(f"when {w} then '{k}'" for k, w, _ in _KINDS)} end as kind, case {' '.join(f"when {w} then {x}::double" for _, w, x in _KINDS)} end as confidence from m""")
def fact_kinds(spark, sf_dir):
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("c_custkey") % len(PHRASES)).cast("int"))
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("atom_id"), F.replace(phrase, F.lit("{}"), F.col("c_name")).alias("fact"))
    return f.select("atom_id", o.fact_kind(F.col("fact")).alias("k")).select("atom_id", "k.kind", "k.confidence")


#: All spellings, and some with an adapter's suffix or prefix.
SPELLINGS = [x for v in c.PLATFORMS.values() for x in v] + ["QQ Official-2", "my.lark", "Ding-Talk", "matrix", "  ", "wechatpadpro_v3"]


@query(f"""with n as (select c_custkey as id, trim(regexp_replace(lower({SPELLINGS!r}[c_custkey % {len(SPELLINGS)} + 1]), '[^a-z0-9]+', '_', 'g'), '_') as t from customer),
a as (select unnest({[x for v in c.PLATFORMS.values() for x in v]!r}) as alias, unnest({[k for k, v in c.PLATFORMS.items() for _ in v]!r}) as platform),
h as (select id, t, platform, row_number() over (partition by id order by t = alias desc, length(alias) desc) as n from n join a on t = alias or starts_with(t, alias || '_') or ends_with(t, '_' || alias))
select n.id, coalesce(h.platform, n.t) as platform from n left join h on n.id = h.id and h.n = 1""")
def platform_names(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, SPELLINGS)), (F.col("c_custkey") % len(SPELLINGS)).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), c.canonical_platform(name).alias("platform"))


#: One line that each rule matches, and lines that none does; made up, none is a credential.
SECRET_LINES = ["-----BEGIN " + "PRIVATE KEY-----", "sk" + "-" + "a1B2" * 6, "ghp" + "_" + "a1B2" * 6, "Authorization: Bearer " + "x.y~" * 6, "api_key = '" + "q1w2" * 4 + "'", "https://user" + ":word@host.example/x", "C:\\Users\\someone\\x", "/home" + "/someone/x", "/mnt" + "/c/someone", "/home/<name>", "https://host.example/x", "sk-short"]
_SECRET_TEXT = f"c_name || chr(10) || {SECRET_LINES!r}[c_custkey % {len(SECRET_LINES)} + 1]".replace("\\\\", "\\").replace('"', "'").replace("api_key = 'q1w2q1w2q1w2q1w2'", "api_key = ''q1w2q1w2q1w2q1w2''")


@query(f"with documents as (select c_custkey as doc_id, {_SECRET_TEXT} as text from customer), " + _scan_sql(audit.SECRETS).removeprefix("with "))
def secret_rules(spark, sf_dir):
    """Every rule of the scan, on lines that it matches and on lines that come near."""
    line = F.get(F.array(*map(F.lit, SECRET_LINES)), (F.col("c_custkey") % len(SECRET_LINES)).cast("int"))
    return audit.scan_text(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat("c_name", F.lit("\n"), line).alias("text")))

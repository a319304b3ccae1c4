"""Queries on messages, sessions, spans, aliases and transfers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import audit, profiles, retrieval, sessions, tables
from ..sources import transfer
from .fixtures import NOW, table, view, with_views
from .recall import query, tokens_sql

M = with_views("fx_messages")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_messages")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages of each session are summarised: a third, rounded down."""
    return _messages(spark, sf_dir).groupBy("session_id").agg(F.floor(F.count("*") / 3).alias("n_summarised"))


PROGRESS = ", pr as (select session_id, cast(floor(count(*) / 3.0) as bigint) as n_summarised from fx_messages group by 1)"
ORDERED = ", o as (select *, row_number() over (partition by session_id order by ts_epoch, id) as i from fx_messages)"


@query(M + " select session_id, sender_id, count(*) as n from fx_messages where role = 'user' group by all")
def sender_counts(spark, sf_dir):
    return sessions.sender_counts(_messages(spark, sf_dir))


@query(M + " select session_id, count(*) as message_count, min(id) as first_id, max(id) as last_id, max(ts_epoch) as last_active, array_to_string(list_sort(list_distinct(list(sender_id))), ',') as participants from fx_messages group by 1")
def session_rollup(spark, sf_dir):
    out = sessions.session_rollup(_messages(spark, sf_dir))
    return out.select("session_id", "message_count", "first_id", "last_id", "last_active", F.array_join("participants", ",").alias("participants"))


@query(M + PROGRESS + """, ms as (select distinct source as session_id from documents), r as (select session_id, count(*) as message_count, min(id) as first_id, max(id) as last_id from fx_messages group by 1),
k as (select * from r union all select session_id, 0, null, null from ms where session_id not in (select session_id from r)),
a as (select k.*, least(coalesce(n_summarised, 0), message_count) as n_summarised from k left join pr on k.session_id = pr.session_id)
select session_id, message_count, first_id, last_id, cast(n_summarised as bigint) as n_summarised, cast(message_count - n_summarised as bigint) as pending, message_count > 0 and message_count = n_summarised as safe_to_clean, cast(0 as bigint) as n_possible_aliases from a""")
def session_audit(spark, sf_dir):
    memory_sessions = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"))
    return sessions.session_audit(_messages(spark, sf_dir), _progress(spark, sf_dir), memory_sessions)


@query(M + ", st as (select session_id, count(*) + (case when session_id like '%3' then 1 else 0 end) as stored from fx_messages group by 1) select session_id, stored, count(*) as actual from st join fx_messages using (session_id) group by all having stored <> count(*)")
def count_drift(spark, sf_dir):
    m = _messages(spark, sf_dir)
    stored = m.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", (F.col("n") + F.col("session_id").endswith("3").cast("int")).alias("stored"))
    return sessions.count_drift(stored, m)


@query(M + PROGRESS + ORDERED + " select session_id, min(id) as first_id, max(id) as last_id, count(*) as n from o join pr using (session_id) where i <= n_summarised group by 1")
def summarised_span(spark, sf_dir):
    return sessions.summarised_span(_messages(spark, sf_dir), _progress(spark, sf_dir))


UNITS = ", u as (select *, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by session_id order by ts_epoch, id rows unbounded preceding) as bigint) as unit from fx_messages)"


@query(M + UNITS + " select session_id, unit, min(id) as first_id, count(*) as n_messages, coalesce(min_by(content, id) filter (role = 'user'), string_agg(content, chr(10) order by ts_epoch, id)) as anchor from u group by all")
def dialogue_units(spark, sf_dir):
    return sessions.unit_table(_messages(spark, sf_dir))


@query(M + PROGRESS + ORDERED + """, l as (select o.*, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by session_id order by ts_epoch, id rows unbounded preceding) as bigint) as unit from o join pr using (session_id) where i - 1 >= n_summarised)
select session_id, cast(floor(greatest(unit - 1, 0) / 2.0) as bigint) as "window", min(i - 1) as start_index, max(i) as end_index, count(distinct unit) as n_units from l group by 1, 2""")
def summary_windows(spark, sf_dir):
    return sessions.fixed_windows(_messages(spark, sf_dir), _progress(spark, sf_dir), 2)


@query(M + PROGRESS + ORDERED + """, l as (select o.*, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by session_id order by ts_epoch, id rows unbounded preceding) as bigint) as unit from o join pr using (session_id) where i - 1 >= n_summarised),
w as (select session_id, cast(floor(greatest(unit - 1, 0) / 1.0) as bigint) as "window", min(i - 1) as start_index, max(i) as end_index, count(distinct unit) as n_units from l group by 1, 2)
select w.* from w join pr using (session_id) where end_index > n_summarised + 1 qualify row_number() over (partition by session_id order by end_index, start_index) = 1""")
def next_window(spark, sf_dir):
    done = _progress(spark, sf_dir)
    return sessions.next_window(sessions.fixed_windows(_messages(spark, sf_dir), done, 1), done.select("session_id", (F.col("n_summarised") + 1).alias("completed_end")))


@query(M + ", d as (select *, row_number() over (partition by session_id order by ts_epoch desc, id desc) as n from fx_messages) select session_id, id, row_number() over (partition by session_id order by ts_epoch, id) as place from d where n <= 3")
def last_messages(spark, sf_dir):
    return sessions.last_messages(_messages(spark, sf_dir), 3).select("session_id", "id", "place")


@query(M + ORDERED + " select session_id, id from o where i between 2 and 4")
def message_slice(spark, sf_dir):
    return sessions.message_slice(_messages(spark, sf_dir), 1, 3).select("session_id", "id")


@query(M + ", h as (select *, row_number() over (partition by session_id order by ts_epoch desc, id desc) as rank from fx_messages where contains(lower(content), 'then')) select session_id, id, rank from h where rank <= 2")
def search_messages(spark, sf_dir):
    return sessions.search_messages(_messages(spark, sf_dir), "then", 2).select("session_id", "id", "rank")


@query(M + " select session_id, count(*) as message_count, max(ts_epoch) as last_active from fx_messages group by 1 having max(ts_epoch) <= 1704100000")
def idle_sessions(spark, sf_dir):
    return sessions.idle_sessions(_messages(spark, sf_dir), 1704100000.0)


@query(M + ", x as (select session_id, max(ts_epoch) < 1704100000 as gone from fx_messages group by 1) select gone as removed, count(*) as n from fx_messages join x using (session_id) group by 1")
def expired_sessions(spark, sf_dir):
    kept, gone = sessions.split_expired(_messages(spark, sf_dir), 1704100000.0)
    return kept.select(F.lit(False).alias("removed")).unionByName(gone.select(F.lit(True).alias("removed"))).groupBy("removed").agg(F.count("*").alias("n"))


@query(M + """, t as (select id, case when id % 5 = 0 then '<memory>' || content || '</memory>' || case when id % 2 = 0 then ' and more' else '' end else content end as content from fx_messages),
k as (select *, case when id % 5 = 0 then trim(case when id % 2 = 0 then ' and more' else '' end) else content end as cleaned from t)
select case when cleaned = content then 'untouched' when cleaned = '' then 'emptied' else 'cleaned' end as status, count(*) as n from k group by 1""")
def clean_injected(spark, sf_dir):
    m = _messages(spark, sf_dir)
    marked = m.withColumn("content", F.when(F.col("id") % 5 == 0, F.concat(F.lit("<memory>"), "content", F.lit("</memory>"), F.when(F.col("id") % 2 == 0, " and more").otherwise(""))).otherwise(F.col("content")))
    return sessions.clean_injected(marked).groupBy("status").agg(F.count("*").alias("n"))


SPANS = ", sp as (select id as memory_id, session_id, id + 2 as a, id - 1 as b, (id % 10) / 10.0::double as importance from fx_messages where role = 'assistant')"


def _spans(spark, sf_dir):
    return _messages(spark, sf_dir).where("role = 'assistant'").select(F.col("id").alias("memory_id"), "session_id", (F.col("id") + 2).alias("a"), (F.col("id") - 1).alias("b"), (F.col("id") % 10 / 10).alias("importance"))


@query(M + SPANS + " select memory_id, m.id from sp join fx_messages m on sp.session_id = m.session_id and m.id between least(a, b) and greatest(a, b)")
def source_messages(spark, sf_dir):
    return sessions.messages_of_spans(_spans(spark, sf_dir), _messages(spark, sf_dir)).select("memory_id", "id")


@query(M + SPANS + " select memory_id, count(*) as n, string_agg(m.role, ',' order by m.id) as roles from sp join fx_messages m on sp.session_id = m.session_id and m.id between least(a, b) and greatest(a, b) where importance >= 0.2 group by 1")
def source_snapshots(spark, sf_dir):
    out = sessions.snapshots(_spans(spark, sf_dir), _messages(spark, sf_dir), 0.2)
    return out.select("memory_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query(M + """, b as (select session_id, sender_id, role from fx_messages) select code, count(*) as n from (select unnest(list_filter([case when coalesce(sender_id, '') = '' then 'missing_sender' end,
 case when role = 'assistant' and not starts_with(sender_id, 'bot') then 'assistant_with_user_id' end, case when role = 'user' and starts_with(sender_id, 'bot') then 'user_with_bot_id' end, case when role = 'system' then 'unknown_role' end], lambda x: x is not null)) as code
 from (select case when role = 'system' then 'tool' else role end as r2, * from b)) group by 1""".replace("when role = 'system' then 'unknown_role'", "when r2 = 'tool' then 'unknown_role'"))
def identity_audit(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return sessions.identity_audit(m.withColumn("role", F.when(F.col("role") == "system", "tool").otherwise(F.col("role"))))


@query(M + PROGRESS + ORDERED + " select o.session_id, id from (select *, count(*) over (partition by session_id) as n from o) o join pr using (session_id) where i <= least(n - 3, case when n_summarised > n then 0 else n_summarised end)")
def trim_messages(spark, sf_dir):
    return sessions.trim_plan(_messages(spark, sf_dir), _progress(spark, sf_dir), 3)


@query("""with recursive a as (select distinct conv_id as alias_id, conv_id - 1 as canonical_id from conversations where conv_id % 8 <> 0),
w(alias_id, dest, hops) as (select alias_id, canonical_id, 1 from a union all select w.alias_id, a.canonical_id, hops + 1 from w join a on w.dest = a.alias_id where hops < 15),
l as (select alias_id, arg_max(dest, hops) as dest from w group by 1)
select l.alias_id, case when a.alias_id is not null then l.alias_id else l.dest end as canonical_id from l left join a on l.dest = a.alias_id""")
def session_aliases(spark, sf_dir):
    return sessions.resolve_aliases(view(spark, sf_dir, "fx_aliases"))


SPAN_S = ", s as (select memory_id, memory_space_id, epoch(started_at) as start_s, epoch(started_at) + minutes as end_s from fx_spans)"


def _span_seconds(spark, sf_dir):
    s = view(spark, sf_dir, "fx_spans")
    start = F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    return s.select("memory_id", "memory_space_id", start.alias("start_s"), (start + F.col("minutes")).alias("end_s"))


@query(with_views("fx_spans") + SPAN_S + """, b as (select *, max(end_s) over (partition by memory_space_id order by start_s, memory_id rows between unbounded preceding and 1 preceding) as before from s),
o as (select *, case when before is null or start_s - before > 21600 then memory_id end as opens from b)
select memory_id, last_value(opens ignore nulls) over (partition by memory_space_id order by start_s, memory_id rows unbounded preceding) as cluster from o""")
def time_clusters(spark, sf_dir):
    return sessions.time_clusters(_span_seconds(spark, sf_dir)).select("memory_id", "cluster")


@query(with_views("fx_spans") + SPAN_S + ", r as (select memory_id as range_id, start_s - 300 as lo, start_s + 300 as hi from s) select memory_id as item_id, range_id from s join r on start_s <= hi and end_s >= lo")
def range_overlap(spark, sf_dir):
    s = _span_seconds(spark, sf_dir)
    ranges = s.select(F.col("memory_id").alias("range_id"), (F.col("start_s") - 300).alias("lo"), (F.col("start_s") + 300).alias("hi"))
    return sessions.range_overlap_join(s.select(F.col("memory_id").alias("item_id"), F.col("start_s").alias("s"), F.col("end_s").alias("e")), ranges).select("item_id", "range_id")


@query(M + UNITS + """, w as (select session_id, unit as "window", min(id) as a, max(id) as b from u group by all)
select w.session_id, w."window", count(distinct case when role = 'user' then sender_id end) as n_humans, count(distinct case when role = 'assistant' then sender_id end) as n_bots, min(case when role = 'assistant' then sender_id end) as narrator
from w join fx_messages m on w.session_id = m.session_id and m.id between a and b group by all""")
def role_bindings(spark, sf_dir):
    m = _messages(spark, sf_dir)
    windows = sessions.dialogue_units(m).groupBy("session_id", F.col("unit").alias("window")).agg(F.min("id").alias("a"), F.max("id").alias("b"))
    out = sessions.role_bindings(m, windows)
    return out.select("session_id", "window", F.col("n_humans").cast("long").alias("n_humans"), F.col("n_bots").cast("long").alias("n_bots"), "narrator")


@query(M + """, p as (select distinct 'p' || cast(c_custkey as varchar) as person_id, case when c_custkey % 2 = 0 then 'QQ' end as platform, 'U' || cast(c_custkey as varchar) as user_id from customer),
m as (select id, lower(sender_id) as u, case when id % 3 = 0 then 'qq' else 'telegram' end as platform from fx_messages),
h as (select id, person_id, 0 as o from m join p on m.u = lower(p.user_id) and lower(p.platform) = m.platform union all select id, person_id, 1 from m join p on m.u = lower(p.user_id) and p.platform is null)
select id, person_id from h qualify row_number() over (partition by id order by o, person_id) = 1""")
def known_person(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 2 == 0, "QQ").alias("platform"), F.concat(F.lit("U"), "c_custkey").alias("user_id"))
    m = _messages(spark, sf_dir).withColumn("platform", F.when(F.col("id") % 3 == 0, "aiocqhttp").otherwise("telegram_bot"))
    return sessions.known_person(m, people)


L = with_views("fx_memories")


@query(L + " select doc_id, round(importance, 6) as importance from fx_memories where status = 'active' order by case when importance <= 1 then importance * 10 else importance end desc, doc_id limit 50 offset 10")
def list_memories(spark, sf_dir):
    out = sessions.list_memories(view(spark, sf_dir, "fx_memories"), c.importance_sort_key(F.col("importance")).desc(), 50, 10)
    return out.select("doc_id", F.round("importance", 6).alias("importance"))


@query(L + """ select doc_id, case when doc_id % 3 = 0 then create_epoch + 5 when doc_id % 3 = 1 then create_epoch + 7 else create_epoch end as anchor_s,
 case when doc_id % 3 = 0 then 'source_window' when doc_id % 3 = 1 then 'temporal' else 'create_time' end as basis, doc_id % 3 = 2 as fallback from fx_memories""")
def event_anchor(spark, sf_dir):
    m = view(spark, sf_dir, "fx_memories").withColumn("window_start", F.when(F.col("doc_id") % 3 == 0, F.col("create_epoch") + 5)).withColumn("temporal_start", F.when(F.col("doc_id") % 3 == 1, F.col("create_epoch") + 7))
    return sessions.event_anchor(m).select("doc_id", "anchor_s", "basis", "fallback")


@query(L + """, n as (select doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) || chr(31) || session_id || chr(31) || persona_id) as k, doc_id % 4 = 0 as old from fx_memories)
select doc_id from n where not old and k not in (select k from n where old) qualify row_number() over (partition by k order by doc_id) = 1""")
def import_duplicates(spark, sf_dir):
    m = view(spark, sf_dir, "fx_memories")
    return tables.import_duplicates(m.where("doc_id % 4 <> 0"), m.where("doc_id % 4 = 0")).select("doc_id")


@query(L + f", t as (select unnest({tokens_sql('text')}) as term from fx_memories) select term, count(*) as n from t group by 1")
def word_counts(spark, sf_dir):
    return view(spark, sf_dir, "fx_memories").select(F.explode(c.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _scan_sql(rules: dict[str, str]) -> str:
    """The rules line by line; DuckDB's expressions have no look-ahead, so the character behind it is said outright."""
    plain = lambda p: p.replace(r"(?![<{$%])[^\\\s]+", r"[^<{$%\\\s][^\\\s]*").replace(r"(?![<{$%])[^/\s]+", r"[^<{$%/\s][^/\s]*").replace("'", "''")
    lines = "with l as (select doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as line, unnest(string_split(coalesce(text, ''), chr(10))) as t from documents) "
    return lines + "select * from (" + " union all ".join(f"select doc_id, line, '{k}' as rule from l where regexp_matches(t, '{plain(v)}')" for k, v in rules.items()) + ")"


@query(_scan_sql(audit.SECRETS))
def secret_scan(spark, sf_dir):
    return audit.scan_text(table(spark, sf_dir, "documents"))


@query(_scan_sql(audit.PERSONAL))
def personal_scan(spark, sf_dir):
    return audit.scan_text(table(spark, sf_dir, "documents"), rules=audit.PERSONAL)


QUALITY = L + """, f as (select doc_id, string_split(coalesce(text, ''), chr(10)) as facts, length(trim(coalesce(text, ''))) as n, importance * 1.2 as importance from fx_memories),
i as (select doc_id, unnest(list_filter([case when n = 0 then 'missing_summary' end, case when n between 1 and 9 then 'short_summary' end, case when importance < 0 or importance > 1 then 'importance_domain' end,
 case when len(list_filter(facts, lambda x: trim(x) = '')) > 0 then 'empty_fact' end, case when len(list_distinct(facts)) < len(facts) then 'duplicate_fact' end], lambda x: x is not null)) as code from f),
s as (select doc_id, code, case when code in ('short_summary', 'duplicate_fact') then 'warning' else 'error' end as severity from i)"""


def _quality_records(spark, sf_dir):
    return view(spark, sf_dir, "fx_memories").withColumn("key_facts", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("importance", F.col("importance") * 1.2)


@query(QUALITY + " select * from s")
def record_quality(spark, sf_dir):
    return audit.record_issues(_quality_records(spark, sf_dir))


@query(QUALITY + """, w as (select doc_id, count(*) filter (severity = 'error') as errors, count(*) as n from s group by 1)
select doc_id, case when errors > 0 then 'reject' when n > 0 then 'review' else 'accept' end as verdict from fx_memories left join w using (doc_id)""")
def record_verdicts(spark, sf_dir):
    m = _quality_records(spark, sf_dir)
    return audit.verdicts(m, audit.record_issues(m))


@query("""select case when vec_id % 7 = 0 then 'missing' when vec_id % 5 = 0 then 'provider_changed' when vec_id % 11 = 0 then 'dimension_changed' end as reason, count(*) as n from embeddings group by 1""")
def embedding_reasons(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 != 0, F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))).alias("embedding"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("p").alias("provider"), F.lit("m").alias("model"))
    return audit.embedding_reasons(v, "p", "m", 64).groupBy("reason").agg(F.count("*").alias("n"))


@query("""with v as (select label, vec_id % 7 = 0 as bad from embeddings) select label, count(*) as n, count(*) filter (not bad) as usable, count(*) filter (bad) as unusable from v group by 1""")
def embedding_health(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("reason", F.when(F.col("vec_id") % 7 == 0, "missing"))
    return audit.embedding_health(v, "label")


@query("select event_type as trace_type, case when user_id % 10 = 0 then 'failed' else 'ok' end as status, count(*) as n, round(avg(value), 6) as mean_ms, round(quantile_cont(value, 0.5), 6) as p50_ms, round(quantile_cont(value, 0.95), 6) as p95_ms from events group by all")
def trace_summary(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("trace_type"), F.when(F.col("user_id") % 10 == 0, "failed").otherwise("ok").alias("status"), F.col("value").alias("elapsed_ms"))
    return audit.trace_summary(t).select("trace_type", "status", "n", *[F.round(x, 6).alias(x) for x in ("mean_ms", "p50_ms", "p95_ms")])


@query("select event_type as trace_type, event_id as trace_id from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 100")
def trace_retention(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("trace_type"), F.col("event_id").alias("trace_id"), F.col("ts").alias("created_at"))
    return tables.keep_newest(t, 100).select("trace_type", "trace_id")


@query("""with o as (select user_id, event_type, value, event_id as version, 1000 - event_id as created from events where event_id % 2 = 0), n as (select user_id, event_type, value, event_id, 1000 - event_id from events where event_id % 2 = 1),
a as (select * from o union all select * from n) select user_id, event_type, value, version, min(created) over (partition by user_id, event_type) as created from a qualify row_number() over (partition by user_id, event_type order by version desc) = 1""")
def keyed_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("version"), (1000 - F.col("event_id")).alias("created"))
    return tables.upsert(e.where("version % 2 = 0"), e.where("version % 2 = 1"), ["user_id", "event_type"], "version", "created")


CH = with_views("fx_changes")


@query(CH + ", l as (select * from fx_changes qualify row_number() over (partition by scope, timeline_uid order by sequence desc) = 1) select scope, timeline_uid, sequence, operation, value from l where operation not in ('delete', 'archive')")
def change_fold(spark, sf_dir):
    return tables.fold_changes(view(spark, sf_dir, "fx_changes"))


STATUS = "case sequence % 3 when 0 then 'pending' when 1 then 'completed' else 'failed' end"


@query(CH + f", e as (select *, {STATUS} as status from fx_changes) select scope, max(sequence) as last, count(distinct sequence) as n, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'failed') as resumable, max(sequence) - min(sequence) + 1 > count(distinct sequence) as has_gap from e group by 1")
def projection_gaps(spark, sf_dir):
    return tables.gap_status(view(spark, sf_dir, "fx_changes").withColumn("status", F.expr(STATUS)))


@query(CH + f", e as (select *, {STATUS} as status from fx_changes), m as (select *, max(case when status = 'completed' then sequence end) over (partition by scope, timeline_uid) as top from e) select sequence, status from m where status <> 'completed' or sequence >= top")
def event_compaction(spark, sf_dir):
    return tables.compact_events(view(spark, sf_dir, "fx_changes").withColumn("status", F.expr(STATUS))).select("sequence", "status")


@query("""with x as (select l_orderkey as k from lineitem union all select 10000000 + l_orderkey from lineitem where l_orderkey % 50 = 0)
select 'line_without_order' as kind, cast(k as varchar) as id from (select distinct k from x) where k not in (select o_orderkey from orders)
union all select 'order_without_line', cast(o_orderkey as varchar) from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def orphan_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    more = li.union(li.where("k % 50 = 0").select((F.col("k") + 10000000).alias("k")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return tables.orphans({"line_without_order": (more, o, "k"), "order_without_line": (o, li, "k")})


@query("""with d as (select doc_id from documents), i as (select vec_id as doc_id from embeddings)
select 'vectors' as "index", (select count(*) from d) as n_documents, (select count(*) from i) as n_indexed, (select count(*) from d where doc_id not in (select doc_id from i)) as missing,
 (select count(*) from i where doc_id not in (select doc_id from d)) as surplus, case when (select count(*) from d where doc_id not in (select doc_id from i)) + (select count(*) from i where doc_id not in (select doc_id from d)) = 0 then 'consistent' else 'repair' end as verdict
union all select 'keywords', count(*), count(*), 0, 0, 'consistent' from d""")
def index_consistency(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return tables.index_consistency(d, {"vectors": table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "keywords": d})


@query("""with v as (select p_size as id, p_partkey as pos, case when p_partkey % 2 = 0 then upper(p_name) else ' ' || p_name || '.' end as value, lower(p_name) as k from part),
f as (select id, k, min(pos) as pos, min_by(value, pos) as value from v group by all) select id, string_agg(value, '|' order by pos) as items from f group by 1""")
def distinct_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("id"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("."))).alias("value"))
    return tables.distinct_by_canonical(p).select("id", F.array_join("items", "|").alias("items"))


@query("""with d as (select doc_id, trim(case when doc_id % 9 <> 0 then text end) as t, (doc_id % 12)::double as s from documents)
select doc_id::varchar as original_id, case when coalesce(t, '') <> '' or doc_id % 18 = 0 then least(1, case when s > 1 and s <= 10 then s / 10 else s end) end as importance, case when coalesce(t, '') = '' and doc_id % 18 <> 0 then 'neither text nor two messages' end as error from d""")
def transfer_import(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("content"), F.col("source").alias("session"), (F.col("doc_id") % 12).cast("string").alias("score"), F.when(F.col("doc_id") % 18 == 0, '[{"role":"ai","content":"a"},{"role":"me","content":"b"}]').alias("history"))
    good, rejected = transfer.normalise(raw)
    return good.select("original_id", "importance", F.lit(None).cast("string").alias("error")).unionByName(rejected.select("original_id", F.lit(None).cast("double").alias("importance"), "error"))


@query("select event_id, cast(coalesce(json_extract_string(props, '$.k'), '-1') as bigint) as k, -1 as missing from events")
def json_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", transfer.json_field(F.col("props"), "k", "bigint", -1).alias("k"), transfer.json_field(F.col("props"), "nothing", "int", -1).alias("missing"))


@query(with_views("fx_memories") + f", u as (select distinct doc_id from benchmark b join fx_memories on doc_id = item_id) select doc_id, access_count + case when doc_id in (select doc_id from u) then 1 else 0 end as access_count, case when doc_id in (select doc_id from u) then {NOW}::double else last_access_epoch end as last_access_epoch from fx_memories")
def access_record(spark, sf_dir):
    log = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return retrieval.access_record(log, view(spark, sf_dir, "fx_memories"), NOW).select("doc_id", "access_count", "last_access_epoch")


@query("select o_custkey as profile, count(*) as n_messages from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0) group by 1 having count(*) >= 5")
def profile_candidates(spark, sf_dir):
    return profiles.build_candidates(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile")), table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("profile")), 5)

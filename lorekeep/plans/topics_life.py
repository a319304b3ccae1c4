"""Queries on topics, lifecycle, profiles, text and column functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import audit, lifecycle, profiles, retrieval, topics
from ..operators.tables import checkpointed
from .fixtures import NOW, table, view, with_views
from .recall import cosine_sql, features_sql, query

L = with_views("fx_memories")
T = with_views("fx_topics")


@query(L + f""", d as (select doc_id, access_count, round(greatest(0.01, round(importance * pow(1 - 0.0513 * (1 - 0.5 * least(1, access_count / 10.0) * (case when last_access_epoch >= {NOW} - 30 * 86400 then 1 else 0.5 end)), 3), 4)), 4) as importance from fx_memories)
select doc_id, importance, cast(floor(access_count * 0.5) as bigint) as access_count from d""")
def daily_decay(spark, sf_dir):
    return lifecycle.daily_decay(view(spark, sf_dir, "fx_memories"), 0.0513, 3, NOW).select("doc_id", "importance", "access_count")


@query(L + f" select doc_id from fx_memories where greatest(create_epoch, last_access_epoch) < {NOW} - 60 * 86400 and importance < 0.3")
def cleanup_candidates(spark, sf_dir):
    return lifecycle.cleanup_candidates(view(spark, sf_dir, "fx_memories"), NOW, 60.0).select("doc_id")


KIND = "case doc_id % 6 when 0 then 'episodic' when 1 then 'planned' when 2 then 'factual' when 3 then 'relational' when 4 then 'preference' else 'unknown' end"
TTL_SQL = f"""greatest(1.0, (case kind when 'episodic' then 7 when 'planned' then 2 + (case when doc_id % 4 = 1 then doc_id % 9 else 0 end) when 'factual' then 180 when 'relational' then 90 when 'preference' then 60 else 30 end) * (0.5 + importance) * (1 + least(0.5, access_count * 0.1)))"""
ATOMS = L + f", a as (select *, {KIND} as kind from fx_memories), t as (select *, {TTL_SQL} as ttl, ({NOW} - create_epoch) / 86400 as days from a)"


def _atoms(spark, sf_dir):
    a = view(spark, sf_dir, "fx_memories").withColumn("kind", F.expr(KIND))
    event = F.when(F.col("doc_id") % 4 == 1, (F.col("doc_id") % 9).cast("double"))
    return a.withColumn("ttl", c.ttl_days(F.col("kind"), F.col("importance"), F.col("access_count"), event)).withColumn("days", (F.lit(NOW) - F.col("create_epoch")) / 86400)


@query(ATOMS + " select doc_id, kind, round(ttl, 6) as ttl, round(case when kind = 'relational' then greatest(0, 1 - days / ttl) when kind = 'planned' then (case when days <= ttl then 1 else 0.05 end) else exp(-ln(2.0) * days / greatest(0.5, ttl / 2)) end, 6) as decay from t")
def fact_decay(spark, sf_dir):
    a = _atoms(spark, sf_dir)
    return a.select("doc_id", "kind", F.round("ttl", 6).alias("ttl"), F.round(c.decay_score(c.ttl_decay(F.col("kind")), F.col("ttl"), F.col("days")), 6).alias("decay"))


@query(ATOMS + f""", e as (select doc_id, status, {NOW} - (create_epoch + ttl * 86400) as late from t), x as (select doc_id, late, case when status = 'active' and late >= 0 then 'expired' else status end as s from e), y as (select doc_id, late, case when s = 'expired' and late >= 30 * 86400 then 'forgotten' else s end as s from x)
select doc_id, case when s = 'forgotten' and late >= 90 * 86400 then 'purged' else s end as status from y""")
def fact_states(spark, sf_dir):
    a = _atoms(spark, sf_dir).withColumn("expires_s", F.col("create_epoch") + F.col("ttl") * 86400)
    return lifecycle.atom_states(a, NOW).select("doc_id", "status")


@query(ATOMS + f""", h as (select doc_id, count(*) * case when doc_id % 3 = 0 then 2 else 1 end as k from labels group by 1), r as (select doc_id, kind, importance, access_count + k as n, k, importance * 0.5 + 0.4 as c from a join h using (doc_id)),
x as (select *, greatest(1.0, (case kind when 'episodic' then 7 when 'planned' then 2 when 'factual' then 180 when 'relational' then 90 when 'preference' then 60 else 30 end) * (0.5 + importance) * (1 + least(0.5, n * 0.1))) as ttl from r)
select doc_id as atom_id, kind, importance, round(0.9 + (c - 0.9) * pow(0.7, k), 6) as confidence, n as reinforcement_count, round(ttl, 6) as ttl_days, round({NOW} + ttl * 86400, 3) as expires_s from x""")
def fact_reinforcement(spark, sf_dir):
    a = _atoms(spark, sf_dir).select(F.col("doc_id").alias("atom_id"), "kind", "importance", (F.col("importance") * 0.5 + 0.4).alias("confidence"), F.col("access_count").alias("reinforcement_count"))
    hits = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("atom_id"), (F.col("doc_id") * 10).alias("new_id"), F.lit(0.9).alias("confidence"))
    out = lifecycle.reinforce(a, hits.unionByName(hits.withColumn("new_id", F.col("new_id") + 1).where("atom_id % 3 = 0")), NOW)
    return out.withColumns({"confidence": F.round("confidence", 6), "ttl_days": F.round("ttl_days", 6), "expires_s": F.round("expires_s", 3)})


FACTS = "with f as (select l_orderkey as fragment_id, l_orderkey % 500 as topic_id, l_suppkey as source, l_discount::double * 10 as importance, l_tax::double * 10 as confidence, l_linenumber from lineitem)"


def _facts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fragment_id"), (F.col("l_orderkey") % 500).alias("topic_id"), F.col("l_suppkey").alias("source"), (F.col("l_discount").cast("double") * 10).alias("importance"), (F.col("l_tax").cast("double") * 10).alias("confidence"), "l_linenumber")


@query(FACTS + ", t as (select fragment_id, least(1, greatest(0, importance)) as importance from f qualify row_number() over (partition by fragment_id order by least(1, greatest(0, importance)) desc) <= 3) select fragment_id, round(0.7 * max(importance) + 0.3 * avg(importance), 6) as importance from t group by 1")
def fragment_importance(spark, sf_dir):
    return lifecycle.fragment_importance(_facts(spark, sf_dir)).select("fragment_id", F.round("importance", 6).alias("importance"))


@query(FACTS + ", w as (select topic_id, importance, greatest(0.01, least(1, greatest(0, confidence))) as w from f) select topic_id, round(0.6 * max(importance) + 0.4 * sum(importance * w) / sum(w), 5) as importance from w group by 1")
def topic_importance(spark, sf_dir):
    return lifecycle.topic_importance(_facts(spark, sf_dir)).select("topic_id", F.round("importance", 5).alias("importance"))


@query(FACTS + """, s as (select topic_id, source % 7 as cluster, importance as base, importance * 0.8 as effective, confidence as weight from f),
z as (select *, case when max(weight) over (partition by topic_id) <= 0 then 1.0 / count(*) over (partition by topic_id) else weight end as w from s),
p as (select topic_id, cluster, sum(base * w) / sum(w) as b, sum(effective * w) / sum(w) as e, max(w) as cw from z where w > 0 group by all)
select topic_id, round(sum(b * cw) / sum(cw), 9) as source_base, round(greatest(0.05, least(1, sum(e / greatest(0.01, b) * cw) / sum(cw))), 9) as dynamic_factor from p group by 1""")
def source_importance(spark, sf_dir):
    s = _facts(spark, sf_dir).select("topic_id", (F.col("source") % 7).alias("cluster"), F.col("importance").alias("base"), (F.col("importance") * 0.8).alias("effective"), F.col("confidence").alias("weight"))
    return lifecycle.source_importance(s).select("topic_id", F.round("source_base", 9).alias("source_base"), F.round("dynamic_factor", 9).alias("dynamic_factor"))


@query(FACTS + """, g as (select topic_id, fragment_id as fact_id, max(importance) as mass, list_distinct(list(source)) as sources from f group by all), x as (select topic_id, unnest(sources) as timeline, mass / len(sources) as each from g),
s as (select topic_id, timeline, sum(each) as w from x group by all) select topic_id, timeline, round(w / sum(w) over (partition by topic_id), 9) as weight from s""")
def contribution_weights(spark, sf_dir):
    g = _facts(spark, sf_dir).groupBy("topic_id", F.col("fragment_id").alias("fact_id")).agg(F.max("importance").alias("mass"), F.collect_set("source").alias("sources"))
    return lifecycle.contribution_weights(g).select("topic_id", "timeline", F.round("weight", 9).alias("weight"))


@query(FACTS + ", s as (select topic_id, count(distinct source % 7) as nc, count(distinct source) as nt, avg(confidence) as conf from f group by 1) select topic_id, round(0.7 * least(1, 0.45 + 0.18 * (nc - 1)) + 0.3 * least(1, 0.55 + 0.1 * (nt - 1)), 6) as strength, round((conf * nt + 1.2) / (nt + 2), 5) as calibrated from s")
def evidence_strength(spark, sf_dir):
    s = _facts(spark, sf_dir).groupBy("topic_id").agg(F.countDistinct(F.col("source") % 7).alias("nc"), F.countDistinct("source").alias("nt"), F.avg("confidence").alias("conf"))
    return s.select("topic_id", F.round(lifecycle.evidence_strength(F.col("nc"), F.col("nt")), 6).alias("strength"), F.round(lifecycle.calibrated_confidence(F.col("conf"), F.col("nt")), 5).alias("calibrated"))


@query("select event_type, count(value) as n, round(min(value), 6) as lo, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.9), 6) as p90, round(max(value), 6) as hi from events group by 1")
def score_distribution(spark, sf_dir):
    out = lifecycle.score_distribution(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(x, 6).alias(x) for x in ("lo", "p10", "median", "p90", "hi")])


PF = f"with p as (select o_orderkey as fact_uid, o_custkey as profile, case o_orderkey % 4 when 0 then 'active' when 1 then 'pending' when 2 then 'stale' else 'archived' end as status, o_orderkey % 10 = 0 as pinned, case when o_orderkey % 3 <> 0 then {NOW} - 200 * 86400 + (o_orderkey % 300) * 86400 end as review_after from orders)"


def _profile_facts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("fact_uid"), F.col("o_custkey").alias("profile"), F.expr("case o_orderkey % 4 when 0 then 'active' when 1 then 'pending' when 2 then 'stale' else 'archived' end").alias("status"), (k % 10 == 0).alias("pinned"), F.when(k % 3 != 0, F.lit(NOW) - 200 * 86400 + (k % 300) * 86400).alias("review_after"))


@query(PF + f" select fact_uid, case when not pinned and review_after <= {NOW} and status = 'active' then 'stale' when not pinned and review_after <= {NOW} and status = 'pending' then 'archived' when not pinned and review_after <= {NOW} - 90 * 86400 and status = 'stale' then 'archived' else status end as status from p")
def profile_lifecycle(spark, sf_dir):
    return lifecycle.profile_lifecycle(_profile_facts(spark, sf_dir), NOW).select("fact_uid", "status")


@query(PF + f" select fact_uid from p where status = 'active' and (pinned or review_after is null or review_after > {NOW})")
def current_facts(spark, sf_dir):
    return _profile_facts(spark, sf_dir).where(lifecycle.fact_is_current(F.col("status"), F.col("pinned"), F.col("review_after"), NOW)).select("fact_uid")


@query(PF + ", q as (select c_custkey as profile from customer) select q.profile, count(*) filter (status = 'active') as n_active, count(*) filter (status = 'stale') as n_stale, count(*) filter (status = 'pending') as n_pending, count(*) filter (status = 'archived') as n_archived, count(distinct fact_uid % 100) as n_timelines from q left join p on q.profile = p.profile group by 1")
def profile_counts(spark, sf_dir):
    f = _profile_facts(spark, sf_dir).withColumn("timeline", F.col("fact_uid") % 100)
    return profiles.profile_counts(f, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile")))


EV = "with e as (select l_partkey as fact_uid, l_orderkey as timeline, epoch(l_shipdate::timestamp) as at_s, l_discount::double * 10 as confidence, case when l_suppkey % 3 = 0 then 'guess' else 'explicit' end as claim_type from lineitem)"


def _claims(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("fact_uid"), F.col("l_orderkey").alias("timeline"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double").alias("at_s"), (F.col("l_discount").cast("double") * 10).alias("confidence"), F.when(F.col("l_suppkey") % 3 == 0, "guess").otherwise("explicit").alias("claim_type"))


@query(EV + """, g as (select fact_uid, count(distinct timeline) as n, (max(at_s) - min(at_s)) / 86400 as days, max(confidence) as confidence, bool_or(claim_type = 'explicit') as ok from e group by 1)
select fact_uid, n, round(confidence, 6) as confidence, array_to_string(list_filter([case when n < 30 then 'too_few_timelines' end, case when days < 1 then 'too_short' end, case when confidence < 0.6 then 'low_confidence' end, case when not ok then 'claim_type' end], lambda x: x is not null), ',') as reasons,
 n >= 30 and days >= 1 and confidence >= 0.6 and ok as admitted from g""")
def fact_admission(spark, sf_dir):
    out = profiles.admission(_claims(spark, sf_dir), min_timelines=30)
    return out.select("fact_uid", "n", F.round("confidence", 6).alias("confidence"), "reasons", "admitted")


@query("""with s as (select o_custkey % 300 as session_id, max('u' || cast(o_custkey % 300 as varchar)) as target, list_distinct(list(case when o_orderkey % 5 = 0 then 'u' || cast(o_custkey % 300 as varchar) end)) as native, list_distinct(list(case when o_orderkey % 7 = 0 then 'u' || cast(o_custkey as varchar) end)) as message_actor, list_distinct(list(case when o_orderkey % 11 = 0 then 'u' || cast(o_custkey % 300 as varchar) end)) as human from orders group by 1),
n as (select session_id, target, list_filter(native, lambda x: x is not null) as native, list_filter(message_actor, lambda x: x is not null) as message_actor, list_filter(human, lambda x: x is not null) as human from s),
e as (select *, list_distinct(native || message_actor || human) as every from n),
k as (select *, list_filter([case when len(native) > 1 then 'several_native' end, case when len(message_actor) > 1 then 'several_message_actor' end, case when len(human) > 1 then 'several_human' end, case when len(every) = 1 and every[1] <> target then 'target_differs' end, case when len(every) = 0 then 'no_evidence' end], lambda x: x is not null) as codes from e)
select session_id, array_to_string(codes, ',') as conflicts, case when len(codes) = 0 and len(every) = 1 then every[1] end as account from k""")
def identity_resolution(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = F.concat(F.lit("u"), (F.col("o_custkey") % 300).cast("string"))
    k = F.col("o_orderkey")
    s = o.select((F.col("o_custkey") % 300).alias("session_id"), own.alias("target"), F.when(k % 5 == 0, own).alias("native"), F.when(k % 7 == 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).alias("message_actor"), F.when(k % 11 == 0, own).alias("human"))
    return profiles.resolve_identity(s)


@query()
def fact_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = o.select(F.col("o_custkey").alias("profile"), F.col("o_orderkey").alias("fact_uid"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 40 + 10).cast("int")).alias("content"), (F.col("o_orderkey") % 10 == 0).alias("pinned"), (F.col("o_orderkey") % 100 / 100).alias("importance"))
    return profiles.budget_facts(f, 120)


@query(PF + ", s as (select fact_uid, status, fact_uid % 60 as n from p) select profile, count(*) as n_facts from p where status = 'active' group by 1")
def profile_fingerprints(spark, sf_dir):
    f = _profile_facts(spark, sf_dir).withColumn("content", F.col("fact_uid").cast("string"))
    return profiles.profile_fingerprint(f).select("profile", "n_facts")


@query("""with s as (select l_orderkey * 10 + l_linenumber as source_uid, l_partkey as fact_uid, l_orderkey as timeline, epoch(l_shipdate::timestamp) as at_s, l_discount::double as confidence, l_orderkey % 2 = 1 as active from lineitem),
u as (select fact_uid, min(source_uid) as source_uid from s group by 1), v as (select fact_uid, count(distinct timeline) as n, (max(at_s) - min(at_s)) / 86400 as days from s where active group by 1)
select u.fact_uid, case when n is null then 'archived' when u.fact_uid % 2 = 0 and (n < 15 or days < 1) then 'stale' else 'active' end as status, coalesce(n, 0) as n_timelines from u left join v using (fact_uid)""")
def fact_judgement(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_uid"), F.col("l_partkey").alias("fact_uid"), F.col("l_orderkey").alias("timeline"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double").alias("at_s"), F.col("l_discount").cast("double").alias("confidence"), F.lit(True).alias("active"))
    s = s.groupBy("source_uid", "fact_uid", "timeline").agg(F.max("at_s").alias("at_s"), F.max("confidence").alias("confidence"), F.first("active").alias("active"))
    changed = s.where("timeline % 2 = 0").select("timeline").distinct()
    after = profiles.replace_contributions(s, changed, s.limit(0))
    facts = s.groupBy("fact_uid").agg(F.min("source_uid").alias("source_uid")).select("fact_uid", F.when(F.col("fact_uid") % 2 == 0, "behaviour").otherwise("trait").alias("kind"), F.lit("active").alias("status"), "source_uid")
    return profiles.judge_facts(facts, after, min_timelines=15).select("fact_uid", "status", "n_timelines").distinct()


@query()
def claim_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("source").alias("profile"), "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "text"))
    return profiles.collapse_claims(lines.select("profile", F.struct("doc_id", "i").alias("claim_id"), "text", F.col("doc_id").cast("double").alias("at_s")))


@query()
def repeated_contexts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    ev = e.select((F.col("user_id") % 50).alias("profile"), F.col("event_id").alias("timeline"), F.col("event_type").alias("term"), c.minute_of_day(ts, "UTC").alias("minute"), F.unix_timestamp(ts).cast("double").alias("at_s"))
    return profiles.repeated_contexts(ev, min_timelines=4, min_days=1.0)


P = T + f""", pr as (select a.memory_space_id as space, a.topic_id as a, b.topic_id as b, round({cosine_sql('a.embedding', 'b.embedding')}, 9) as cosine from fx_topics a join fx_topics b on a.memory_space_id = b.memory_space_id and a.topic_id < b.topic_id), pf as (select * from pr where cosine >= 0.2)"""


def _items(spark, sf_dir):
    return view(spark, sf_dir, "fx_topics").select(F.col("memory_space_id").alias("space"), F.col("topic_id").alias("uid"), "embedding", "label")


def _pairs(spark, sf_dir, floor=0.2):
    return topics.vector_pairs(_items(spark, sf_dir), floor)


@query(P + " select space, a, b, round(cosine, 6) as cosine from pf")
def similar_topics(spark, sf_dir):
    return _pairs(spark, sf_dir).select("space", "a", "b", F.round("cosine", 6).alias("cosine"))


RANK = """, bo as (select space, a as uid, b as other, cosine from pf union all select space, b, a, cosine from pf), rk as (select *, row_number() over (partition by space, uid order by cosine desc, other) as rank from bo qualify rank <= 5)"""


@query(P + RANK + " select space, uid, other, rank, round(cosine, 6) as cosine, round(cosine - coalesce(lead(cosine) over (partition by space, uid order by cosine desc, other), 0.2), 6) as margin from rk")
def topic_neighbours(spark, sf_dir):
    out = topics.margins(topics.vector_neighbours(_items(spark, sf_dir), 0.2, 5), 0.2)
    return out.select("space", "uid", "other", "rank", F.round("cosine", 6).alias("cosine"), F.round("margin", 6).alias("margin"))


@query(P + ", sc as (select pf.space, a, b, round(cosine + case when x.label = y.label then 0.08 else 0 end, 9) as score from pf join fx_topics x on a = x.topic_id join fx_topics y on b = y.topic_id) select space, a, b, round(score, 6) as score from sc where score >= 0.3")
def fragment_pairs(spark, sf_dir):
    return topics.vector_pairs(_items(spark, sf_dir), 0.2, label="label", minimum=0.3, bonus=0.08).select("space", "a", "b", F.round("score", 6).alias("score"))


@query(T.replace("with ", "with recursive ", 1) + f""", ne as (select a.topic_id as a, b.topic_id as b from fx_topics a join fx_topics b on a.memory_space_id = b.memory_space_id and a.topic_id < b.topic_id where round({cosine_sql('a.embedding', 'b.embedding')}, 9) >= 0.35),
bo as (select a, b from ne union select b, a from ne), reach(uid, seen) as (select topic_id, topic_id from fx_topics union select uid, b from reach join bo on seen = a) select uid, min(seen) as root from reach group by 1""")
def topic_groups(spark, sf_dir):
    items = _items(spark, sf_dir)
    return topics.connected(_pairs(spark, sf_dir, 0.35).select("a", "b"), items.select("uid"))


@query()
def topic_clusters(spark, sf_dir):
    items = _items(spark, sf_dir)
    scores = topics.vector_pairs(items, 0.2, label="label", minimum=0.25, bonus=0.08).select("space", "a", "b", "score")
    return topics.clusters_of_all(scores, topics.seed_edges(scores, strong=0.4, mutual=0.3), items.select("uid"), 0.25, 0.3)


@query()
def orphan_relations(spark, sf_dir):
    pairs = checkpointed(_pairs(spark, sf_dir).select("space", "a", "b", F.col("cosine").alias("score")))
    chosen = topics.bounded_edges(pairs.where("score >= 0.3"), 3, by="space")
    return topics.orphan_swaps(chosen, pairs, _items(spark, sf_dir).select("uid"), 3)


CE = "with e as (select vec_id, label, embedding, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings)"


@query(CE + ", m as (select label, i, avg(x) as x from e group by all) select label, round(list_sum(list(x)), 5) as total, round(sqrt(list_sum(list(x * x))), 5) as norm from m group by 1")
def centroids(spark, sf_dir):
    out = topics.centroid(table(spark, sf_dir, "embeddings"), ["label"])
    return out.select("label", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.sqrt(c.dot(F.col("centroid"), F.col("centroid"))), 5).alias("norm"))


@query()
def shared_features(spark, sf_dir):
    """Whole texts and all features: exact, and of a cost that grows with the square of a language's documents."""
    f = view(spark, sf_dir, "fx_memories").select(F.col("doc_id").alias("uid"), F.col("persona_id").alias("space"), F.explode(c.retrieval_features(F.col("text"))).alias("item"))
    return topics.shared_items(f, ["space"], digits=6).select("space", "a", "b", "jaccard")


@query("""with l as (select distinct l_suppkey as topic_id, l_orderkey as timeline, l_orderkey % 50 as cluster, case when l_linenumber % 2 = 0 then l_discount::double end as confidence from lineitem),
p as (select topic_id, timeline, cluster, coalesce(avg(confidence), 0.5) as similarity from l group by all), n as (select *, count(*) over (partition by topic_id, cluster) as n from p)
select topic_id, timeline, cluster, round(similarity, 6) as similarity, round(least(1, 0.6 + 0.4 / n), 6) as contribution, round(1.0 / n, 6) as affinity from n""")
def link_weights(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("topic_id"), F.col("l_orderkey").alias("timeline"), (F.col("l_orderkey") % 50).alias("cluster"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount").cast("double")).alias("confidence")).distinct()
    return topics.link_weights(li).select("topic_id", "timeline", "cluster", *[F.round(x, 6).alias(x) for x in ("similarity", "contribution", "affinity")])


@query("""select o_custkey as topic_id, case o_orderkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end as kind, count(distinct o_orderkey % 20) as n_sources, max(o_orderkey % 100) / 100.0::double as importance from orders group by all""")
def atom_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.expr("case o_orderkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end")
    a = o.select(F.col("o_custkey").alias("topic_id"), kind.alias("kind"), F.lit("Same, fact!").alias("content"), (F.col("o_orderkey") % 100 / 100).alias("importance"), F.lit(0.5).alias("confidence"), (F.col("o_orderkey") % 20).alias("timeline"))
    return topics.merge_atoms(a).select("topic_id", "kind", "n_sources", "importance")


MEM = "with m as (select o_orderkey as uid, 1 + o_orderkey % 2 as revision, 's' || cast(o_custkey % 3 as varchar) as space from orders), l as (select distinct l_orderkey as uid, cast(1 as bigint) as revision, 's' || cast(o_custkey % 3 as varchar) as space, l_suppkey as topic_id from lineitem join orders on l_orderkey = o_orderkey where l_linenumber <= 3), t as (select s_suppkey as topic_id from supplier where s_suppkey % 2 = 0)"


def _index(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderkey").alias("uid"), (1 + F.col("o_orderkey") % 2).alias("revision"), F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("space"))
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("uid"), F.lit(1).cast("long").alias("revision"), F.col("l_suppkey").alias("topic_id")).distinct()
    return m, li.join(m.select("uid", "space"), "uid"), table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("topic_id"))


@query(MEM + ", k as (select l.* from l join t using (topic_id)) select uid, revision, space from m where not exists (select 1 from k where k.uid = m.uid and k.revision = m.revision and k.space = m.space)")
def unindexed_memories(spark, sf_dir):
    return topics.unindexed(*_index(spark, sf_dir)).select("uid", "revision", "space")


@query(MEM + """, k as (select l.* from l join t using (topic_id)), n as (select uid from m where not exists (select 1 from k where k.uid = m.uid and k.revision = m.revision and k.space = m.space))
select 'memory' as kind, uid as id from n union all select distinct 'topic', topic_id from k where uid in (select uid from n)""")
def incremental_scope(spark, sf_dir):
    return topics.incremental_scope(*_index(spark, sf_dir))


@query(MEM + " select l.uid, topic_id, case when m.revision > l.revision then 'stale' else 'active' end as status from l join m using (uid)")
def stale_links(spark, sf_dir):
    m, links, _ = _index(spark, sf_dir)
    changed = m.select(F.col("uid").alias("timeline"), "revision")
    return topics.stale_links(links.withColumnRenamed("uid", "timeline").withColumn("status", F.lit("active")), changed).select(F.col("timeline").alias("uid"), "topic_id", "status")


@query("""with p as (select user_id as profile, event_type as term, count(*) as n from events group by all), d as (select term, row_number() over (partition by profile order by n desc, term) as r, profile, n from p) select profile as root, term as label, n from d where r = 1""")
def dominant_labels(spark, sf_dir):
    return topics.dominant_label(table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.col("event_type").alias("label")))


@query("""with m as (select l_partkey as topic_id, l_suppkey as actor, case l_linenumber % 3 when 0 then 'speaker' when 1 then 'mentioned' else 'subject' end as role, l_discount::double as confidence from lineitem)
select topic_id, actor, string_agg(distinct role, ',' order by role) as roles, round(max(confidence), 6) as confidence, bool_or(role = 'speaker') as participant from m group by all""")
def actor_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.select(F.col("l_partkey").alias("topic_id"), F.col("l_suppkey").alias("actor"), F.expr("case l_linenumber % 3 when 0 then 'speaker' when 1 then 'mentioned' else 'subject' end").alias("role"), F.col("l_discount").cast("double").alias("confidence"))
    return topics.actor_rollup(m).select("topic_id", "actor", F.array_join("roles", ",").alias("roles"), F.round("confidence", 6).alias("confidence"), "participant")


@query(T + f" select topic_id, round(least(1, 0.82 * 0.5 + 0.10 * least(1, greatest(0, (topic_id % 10) / 10.0::double * exp(-0.01 * (topic_id % 50) / (1 + ln(1 + topic_id % 7) * 0.25)))) + 0.08 * ((label % 5) / 5.0::double)), 6) as score from fx_topics")
def topic_ranking(spark, sf_dir):
    t = view(spark, sf_dir, "fx_topics")
    k = F.col("topic_id")
    imp = c.topic_importance_now(k % 10 / 10, F.lit(NOW) - (k % 50) * 86400, F.lit(0.0), k % 7, NOW)
    return t.select("topic_id", F.round(c.topic_rank(F.lit(0.5), imp, F.col("label") % 5 / 5), 6).alias("score"))


@query(L + f" select doc_id, length(text) as n, case when length(text) <= 200 then text else substr(text, 1, 99) || chr(10) || '…' || chr(10) || right(text, 98) end as fitted from fx_memories")
def fitted_text(spark, sf_dir):
    return view(spark, sf_dir, "fx_memories").select("doc_id", F.length("text").cast("long").alias("n"), c.fit_content(F.col("text"), 200).alias("fitted"))


@query(with_views("fx_messages") + " select distinct session_id, split_part(session_id, ':', 1) as bot, 'private' as chat_type, split_part(session_id, ':', 3) as target, sha256(session_id || '|' || 'p') as space from fx_messages")
def session_names(spark, sf_dir):
    s = view(spark, sf_dir, "fx_messages").select("session_id").distinct()
    p = c.session_parts(F.col("session_id"))
    return s.select("session_id", p["bot"].alias("bot"), p["chat_type"].alias("chat_type"), p["target"].alias("target"), c.memory_space(F.col("session_id"), F.lit("p")).alias("space"))


@query("select event_id, least(abs(m - 30), 1440 - abs(m - 30)) as distance from (select event_id, extract(hour from ts) * 60 + extract(minute from ts) as m from events)")
def minute_distances(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", c.minute_distance(c.minute_of_day(F.col("ts").cast("timestamp"), "UTC"), F.lit(30)).cast("long").alias("distance"))


@query()
def near_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("scope"), F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("field"))
    return audit.near_fields(p.where("id % 20 = 0"), p)


@query("with v as (select vec_id, embedding from embeddings), x as (select a.vec_id, max(round(" + cosine_sql("a.embedding", "b.embedding") + ", 9)) as s from v a join v b on a.vec_id % 2 = 0 and b.vec_id % 2 = 1 group by 1) select count(*) as n, round(min(s), 6) as least, round(avg(s), 6) as mean from x")
def build_comparison(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "embedding")
    return audit.compare_builds(v.where("uid % 2 = 0"), v.where("uid % 2 = 1")).select("n", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"))


@query("with s as (select o_custkey as space, o_orderkey % 7 as score, o_orderkey from orders), w as (select *, count(*) over (partition by space) as n, rank() over (partition by space order by score desc) + (count(*) over (partition by space, score) - 1) / 2.0 as r from s) select o_orderkey as uid, round(case when n = 1 then 1.0 else (n - r) / (n - 1) end, 6) as percentile from w")
def relative_ranks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("space"), (F.col("o_orderkey") % 7).alias("score"), F.col("o_orderkey").alias("uid"))
    return retrieval.relative_rank(o, ["space"]).select("uid", F.round("percentile", 6).alias("percentile"))


@query(L + ", g as (select session_id, count(*) as n, round(avg(importance), 6) as mean_importance, count(*) filter (status = 'active') as active, count(*) filter (least(9, greatest(0, floor(importance * 10))) = 9) as top_bucket, min(create_epoch) as oldest, max(create_epoch) as newest from fx_memories group by 1) select * from g")
def corpus_statistics(spark, sf_dir):
    m = view(spark, sf_dir, "fx_memories")
    return m.groupBy("session_id").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("importance") * 10))) == 9).alias("top_bucket"), F.min("create_epoch").alias("oldest"), F.max("create_epoch").alias("newest"))


@query(EV + ", k as (select * from e where claim_type = 'explicit' and at_s >= 800000000) select count(*) as n from (select distinct fact_uid, timeline, at_s from k where timeline % 3 <> 0)")
def behaviour_evidence(spark, sf_dir):
    e = _claims(spark, sf_dir).select(F.col("fact_uid").alias("profile"), "timeline", F.col("at_s").cast("string").alias("text"), F.col("timeline").alias("evidence_id"), "at_s", F.when(F.col("claim_type") == "explicit", "observed").otherwise("guess").alias("claim_type"))
    out = profiles.behaviour_evidence(e, e.where("timeline % 3 = 0").select("evidence_id").distinct(), 800000000.0 + 86400.0 * 10, 10.0)
    return out.agg(F.count("*").alias("n"))


@query("select kind, count(*) as n from (select 'big' as kind from orders where o_orderkey % 2 = 0 union all select 'small' from orders where o_orderkey % 5 = 0) group by 1")
def health_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return audit.health(o.where("o_orderkey % 2 = 0").select(F.lit("big").alias("kind")).union(o.where("o_orderkey % 5 = 0").select(F.lit("small").alias("kind"))))


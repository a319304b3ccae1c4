"""New components matched to existing topics, with and without the vote of siblings, with their SQL.

Every given vector is a fragment: an even number one of a topic, an odd one a new one of a component. Terms, actors, facts and sources come from the document
and the order lines of its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, topics
from .fixtures import table
from .recall import cosine_sql, query

_FRAGMENTS = "select vec_id as fragment_id, 'space' || cast(vec_id % 3 as string) as space, case when vec_id % 2 = 0 then 1 else 0 end as formal, vec_id % 3 + 3 * (label * 4 + vec_id % 5 % 4) as owner, embedding, 1000.0 * (vec_id % 37) as start_s, 1000.0 * (vec_id % 37) + 300.0 * (vec_id % 11) as end_s from {embeddings}"
_CONSTANT = 1.1


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Components, topics, fragments of either, and the events of components."""
    f = spark.sql(_FRAGMENTS, embeddings=table(spark, sf_dir, "embeddings")).withColumn("embedding", F.concat("embedding", F.array(F.lit(_CONSTANT).cast("float"))))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fragment_id"), (F.col("l_orderkey") % 15000).alias("source"), (F.col("l_suppkey") % 25).alias("actor"), (F.col("l_orderkey") % 15000 * 10 + F.col("l_linenumber")).alias("fact"))
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fragment_id"), F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("term")).where("term <> ''")
    owners = f.select("fragment_id", "formal", "owner")
    gather = lambda rows, x, name: owners.join(rows.select("fragment_id", x).distinct(), "fragment_id").groupBy("formal", "owner").agg(F.collect_set(x).alias(name))
    base = topics.centroid(f, ["space", "formal", "owner"]).withColumnRenamed("centroid", "embedding").join(f.groupBy("formal", "owner").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")), ["formal", "owner"])
    for rows, x, name in ((words, "term", "terms"), (lines, "actor", "actors"), (lines, "fact", "facts"), (lines, "source", "sources")):
        base = base.join(gather(rows, x, name), ["formal", "owner"], "left").withColumn(name, F.coalesce(name, F.array()))
    base = matching.checkpointed(base)
    new, old = base.where("formal = 0").drop("formal").withColumnRenamed("owner", "uid"), base.where("formal = 1").drop("formal").withColumnRenamed("owner", "topic_uid")
    own, formal = f.where("formal = 0").select(F.col("owner").alias("uid"), "fragment_id", "embedding"), f.where("formal = 1").select(F.col("owner").alias("topic_uid"), "embedding")
    events = f.where("formal = 0").select(F.col("owner").alias("uid"), F.concat("space", F.lit("-"), F.floor(F.col("fragment_id") / 6).cast("long") % 9).alias("event")).distinct()
    return new, old, own, formal, events


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    new, old, own, formal, events = _sides(spark, sf_dir)
    return matching.scored_candidates(matching.candidate_topics(new, old, 4), new, old, own, formal), new, events


SCORED = f"""with f as (select * exclude (embedding), list_append(embedding::double[], {_CONSTANT}::float::double) as e from ({_FRAGMENTS.replace('{embeddings}', 'embeddings')})),
ex as (select space, formal, owner, generate_subscripts(e, 1) as i, unnest(e) as x from f), av as (select space, formal, owner, i, avg(x) as x from ex group by all),
ln as (select l_partkey as fragment_id, l_orderkey % 15000 as source, l_suppkey % 25 as actor, l_orderkey % 15000 * 10 + l_linenumber as fact from lineitem),
wd as (select fragment_id, term from (select doc_id as fragment_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) as term from documents) where term <> ''),
b as (select space, formal, owner, list(x order by i) as e from av group by all), sp as (select formal, owner, min(start_s) as s, max(end_s) as z from f group by all),
tl as (select formal, owner, list(distinct term) as terms from f join wd using (fragment_id) group by all),
nl as (select formal, owner, list(distinct actor) as actors, list(distinct fact) as facts, list(distinct source) as sources from f join ln using (fragment_id) group by all),
g as (select b.*, s, z, coalesce(terms, []) as terms, coalesce(actors, []) as actors, coalesce(facts, []) as facts, coalesce(sources, []) as sources from b join sp using (formal, owner) left join tl using (formal, owner) left join nl using (formal, owner)),
n as (select * from g where formal = 0), t as (select * from g where formal = 1),
v as (select n.space, n.owner as uid, t.owner as topic_uid, round({cosine_sql('n.e', 't.e')}, 9) as cosine from n join t on n.space = t.space),
cd as (select space, uid, topic_uid from (select *, row_number() over (partition by uid order by cosine desc, topic_uid) as r from v) where r <= 4
  union select n.space, n.owner, t.owner from n join t on n.space = t.space where len(list_intersect(n.sources, t.sources)) > 0),
fc as (select uid, topic_uid, a.fragment_id, max(round({cosine_sql('a.e', 'c.e')}, 9)) as best from cd join f a on a.formal = 0 and a.owner = uid join f c on c.formal = 1 and c.owner = topic_uid group by all),
rp as (select uid, topic_uid, least(1, greatest(0, 0.7 * avg(best) + 0.3 * min(best))) as rep from fc group by all),
x as (select cd.*, v.cosine as semantic, round(coalesce(rep, least(1, greatest(0, cosine))), 9) as representative,
  case when len(n.terms) = 0 or len(t.terms) = 0 then 0 else len(list_intersect(n.terms, t.terms))::double / len(list_distinct(list_concat(n.terms, t.terms))) end as lexical,
  len(list_intersect(n.facts, t.facts))::double / greatest(1, len(n.facts)) as continuity, len(list_intersect(n.sources, t.sources))::double / greatest(1, len(list_distinct(list_concat(n.sources, t.sources)))) as overlap,
  len(n.actors) > 0 and len(t.actors) > 0 as known, case when len(n.actors) = 0 or len(t.actors) = 0 then 0 else len(list_intersect(n.actors, t.actors))::double / len(list_distinct(list_concat(n.actors, t.actors))) end as actor,
  case when least(n.z, t.z) >= greatest(n.s, t.s) then (least(n.z, t.z) - greatest(n.s, t.s) + 1) / (greatest(n.z, t.z) - least(n.s, t.s) + 1) else 0 end as affinity,
  exp(-greatest(0, greatest(n.s, t.s) - least(n.z, t.z)) / 604800.0) as proximity
  from cd join v using (space, uid, topic_uid) join n on n.owner = uid join t on t.owner = topic_uid left join rp using (uid, topic_uid)),
y as (select *, continuity > 0 or overlap > 0 as con, least(1, 0.55 * semantic + 0.30 * representative + 0.13 * lexical + 0.05 * proximity) - (case when known then 0.05 * (1 - actor) else 0 end) as ext from x),
sc as (select space, uid, topic_uid, case when con then 'source_continuity' else 'semantic_extension' end as lane, semantic, representative, round(lexical, 9) as lexical,
  round(case when con then 0.4 * continuity + 0.4 * semantic + 0.1 * lexical + 0.05 * (0.5 * actor + 0.5 * affinity) + 0.05 * overlap when semantic >= 0.78 or representative >= 0.65 then ext else least(ext, 0.549999) end, 9) as score from y)"""


@query(SCORED + " select space, uid, topic_uid, lane, round(score, 6) as score, round(semantic, 6) as semantic, round(representative, 6) as representative, round(lexical, 6) as lexical from sc")
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics in question for each new component, from both lanes, with their scores."""
    out, _, _ = _scored(spark, sf_dir)
    return out.withColumns({x: F.round(x, 6) for x in ("score", "semantic", "representative", "lexical")})


DECIDED = SCORED + """,
rk as (select *, row_number() over (partition by uid order by score desc, topic_uid) as r from sc),
p as (select n.space, n.owner as uid, a.topic_uid as t1, a.lane as l1, a.score as s1, c.score as s2, coalesce(a.score, -1) as f, coalesce(c.score, -1) as s,
  coalesce(a.lane = 'semantic_extension' and c.lane = 'semantic_extension' and a.score >= 0.72 and a.semantic >= round(c.semantic + 0.02, 9) and a.representative >= round(c.representative + 0.015, 9) and a.lexical >= c.lexical, false) as dominant
  from n left join rk a on a.uid = n.owner and a.r = 1 left join rk c on c.uid = n.owner and c.r = 2),
q as (select *, s >= 0.55 and round(f - s, 9) < 0.04 as near from p),
de as (select space, uid, case when f < 0.55 then 'create' when not near or dominant then 'update' when s >= 0.72 then 'review' else 'create' end as decision,
  case when f < 0.55 then 'below_match_threshold' when not near then l1 when dominant then 'dominant_semantic_extension' else 'close_candidates' end as reason, case when f >= 0.55 and (not near or dominant) then t1 end as topic_uid, s1 as score, s2 as runner_up from q)"""


@query(DECIDED + " select space, uid, decision, reason, topic_uid, round(score, 6) as score, round(runner_up, 6) as runner_up from de")
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each new component updates a topic, makes one, or asks for review."""
    out, new, _ = _scored(spark, sf_dir)
    return matching.decide(out, new).withColumns({x: F.round(x, 6) for x in ("score", "runner_up")})


@query(DECIDED + """,
ev as (select distinct owner as uid, space || '-' || (fragment_id // 6) % 9 as event from f where formal = 0),
vo as (select event, topic_uid, count(*) as n, sum(score) as total from de join ev using (uid) where decision = 'update' and score >= 0.55 and round(score - coalesce(runner_up, 0), 9) >= 0.03 group by all),
ru as (select * from vo qualify rank() over (partition by event order by n desc) = 1 and count(*) over (partition by event, n) = 1 and n >= 2),
tg as (select uid, ru.topic_uid as target, sum(n) as votes from ev join ru using (event) group by uid, ru.topic_uid qualify row_number() over (partition by uid order by sum(n) desc, round(sum(total), 9) desc, ru.topic_uid) = 1),
ri as (select uid, target, votes, max(case when topic_uid = target then score end) as base, max(case when topic_uid = target then semantic end) as sem, max(case when topic_uid = target then representative end) as rep,
  max(case when topic_uid <> target then score end) as rival from sc join tg using (uid) group by all),
rj as (select ri.*, round(least(1, base + 0.1), 9) as raised, (select bool_or(sc.topic_uid < target) from sc where sc.uid = ri.uid and sc.topic_uid <> target and sc.score = rival) as before from ri),
ok as (select * from rj where base is not null and (sem >= 0.5 or rep >= 0.5) and base >= 0.45 and raised >= 0.55 and (raised > coalesce(rival, 0) or (raised = coalesce(rival, 0) and not coalesce(before, false))) and round(raised - coalesce(rival, 0), 9) >= 0.03),
fin as (select de.*, target, votes, raised, rival, target is not null and not coalesce(decision = 'update' and topic_uid = target, false) as moved from de left join ok using (uid))
select space, uid, case when moved then 'update' else decision end as decision, case when moved then 'dominant_same_event_siblings' else reason end as reason, case when moved then target else topic_uid end as topic_uid,
 round(case when moved then raised else score end, 6) as score, round(case when moved then rival else runner_up end, 6) as runner_up, cast(case when moved then votes end as bigint) as votes from fin""")
def sibling_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions after the vote of siblings in the same event."""
    out, new, events = _scored(spark, sf_dir)
    kept = matching.checkpointed(out)
    return matching.sibling_rescue(matching.decide(kept, new), kept, events).withColumns({x: F.round(x, 6) for x in ("score", "runner_up")})

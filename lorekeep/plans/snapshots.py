"""Snapshots of topics before and after a split and a merge, with SQL that builds the latter from nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots
from .fixtures import table
from .recall import query

#: An order is a fragment of one of 300 topics; its lines name timelines (suppliers), keywords and affects.
_FRAGMENTS = """select l_orderkey as fragment_id, l_orderkey % 300 as topic_id, max(l_linenumber) / 10.0D as importance, min(l_linenumber) / 5.0D as confidence, 1000.0D * (l_orderkey % 77) as start_s, 1000.0D * (l_orderkey % 91) + 500.0D as end_s,
 cast(sum(l_quantity) as double) as x, cast(count(*) as double) as y from {lineitem} group by l_orderkey"""
_SOURCES = "select distinct l_orderkey as fragment_id, l_suppkey as timeline, l_suppkey % 6 as cluster, l_suppkey % 10 / 10.0D as base, l_suppkey % 7 / 8.0D as effective from {lineitem}"


def _parts(spark: SparkSession, sf_dir: str) -> snapshots.Parts:
    lines = table(spark, sf_dir, "lineitem")
    words = lines.groupBy(F.col("l_orderkey").alias("fragment_id")).agg(F.collect_set(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("keywords"))
    f = spark.sql(_FRAGMENTS, lineitem=lines).join(words, "fragment_id").withColumn("embedding", F.array("x", "y")).withColumn("space", F.concat(F.lit("s"), F.col("topic_id") % 3)).drop("x", "y")
    affects = lines.select(F.col("l_orderkey").alias("fragment_id"), F.col("l_suppkey").alias("actor"), F.concat(F.lit("mood"), F.col("l_linenumber")).alias("category"), (F.col("l_suppkey") % 9 / 10).alias("confidence"), (F.col("l_linenumber") / 8).alias("intensity"))
    return snapshots.Parts(f, spark.sql(_SOURCES, lineitem=lines), affects)


def _mapping(fragments: DataFrame) -> DataFrame:
    """Topics of the first forty: every tenth is split by its odd fragments, those that end in 3 join the next."""
    t = F.col("topic_id")
    to = F.when((t < 40) & (t % 10 == 0) & (F.floor(F.col("fragment_id") / 300) % 2 == 1), t + 10000).when((t < 40) & (t % 10 == 3), t + 3)
    return fragments.select("fragment_id", to.alias("topic_id")).where("topic_id is not null")


_SNAPSHOT = f"""with f0 as ({_FRAGMENTS.replace('{lineitem}', 'lineitem').replace('0D', '0::double')}), f as (select * replace (case when topic_id < 40 and topic_id % 10 = 0 and (fragment_id // 300) % 2 = 1 then topic_id + 10000 when topic_id < 40 and topic_id % 10 = 3 then topic_id + 3 else topic_id end as topic_id) from f0),
s as ({_SOURCES.replace('{lineitem}', 'lineitem').replace('0D', '0::double')}), r as (select topic_id, fragment_id, importance, confidence, timeline, cluster from f join s using (fragment_id)),
g as (select topic_id, timeline, min(cluster) as cluster, avg(confidence) as similarity from r group by 1, 2),
m as (select topic_id, fragment_id, max(least(1, importance)) as mass, count(distinct timeline) as n from r group by 1, 2), w as (select r.topic_id, timeline, sum(mass / n) as w from r join m using (topic_id, fragment_id) group by 1, 2),
l as (select g.*, least(1, 0.6 + 0.4 / count(*) over (partition by topic_id, cluster)) as contribution, 1.0 / count(*) over (partition by topic_id, cluster) as affinity, w / sum(w) over (partition by topic_id) as weight from g join w using (topic_id, timeline))"""


@query(_SNAPSHOT + " select topic_id, timeline, cluster, round(contribution, 6) as contribution, round(affinity, 6) as affinity, round(similarity, 6) as similarity, round(weight, 9) as weight from l")
def regrouped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all topics after the split and the merge."""
    old = snapshots.build(_parts(spark, sf_dir))
    new, _ = snapshots.regroup(old, _mapping(old.parts.fragments))
    return new.links.select("topic_id", "timeline", "cluster", *[F.round(x, 6).alias(x) for x in ("contribution", "affinity", "similarity")], F.round("weight", 9).alias("weight"))


@query(_SNAPSHOT + """,
b as (select topic_id, 's' || min((case when topic_id > 9999 then topic_id - 10000 else topic_id end) % 3) as space, count(*) as n_fragments, min(start_s) as start_s, max(end_s) as end_s, avg(least(1, confidence)) as conf, avg(x) as cx, avg(y) as cy,
  0.6 * max(importance) + 0.4 * sum(importance * greatest(0.01, least(1, confidence))) / sum(greatest(0.01, least(1, confidence))) as si from f group by 1),
k as (select topic_id, count(distinct l_returnflag || l_linenumber) as n_keywords from f join lineitem on l_orderkey = fragment_id group by 1),
pc as (select topic_id, cluster, count(*) as n from l group by 1, 2), e as (select topic_id, count(*) as n_clusters, cast(sum(n) as bigint) as n_timelines, max(n) as largest from pc group by 1),
z as (select topic_id, cluster, base, effective, weight as w from l join (select distinct timeline, base, effective from s) using (timeline) where weight > 0),
p as (select topic_id, cluster, sum(base * w) / sum(w) as b, sum(effective * w) / sum(w) as e, max(w) as cw from z group by 1, 2),
dy as (select topic_id, greatest(0.05, least(1, sum(e / greatest(0.01, b) * cw) / sum(cw))) as d from p group by 1),
ab as (select topic_id, l_suppkey as actor, 'mood' || l_linenumber as category, max(l_suppkey % 9 / 10.0 * (l_linenumber / 8.0)) as support from f join lineitem on l_orderkey = fragment_id group by all),
ac as (select topic_id, category, round(sum(support), 9) as score from ab group by 1, 2), ar as (select *, row_number() over (partition by topic_id order by score desc, category) as r from ac), af as (select topic_id, string_agg(category, ',' order by r) as affects from ar where r <= 3 group by 1)
select topic_id, space, n_fragments, start_s, end_s, n_keywords, n_timelines, n_clusters, largest as largest_cluster, round(0.7 * least(1, 0.45 + 0.18 * (n_clusters - 1)) + 0.3 * least(1, 0.55 + 0.1 * (n_timelines - 1)), 6) as evidence_strength,
 round((conf * n_timelines + 1.2) / (n_timelines + 2), 6) as confidence, round(least(1, si) * (0.85 + 0.15 * d), 6) as importance, affects, round(cx, 6) as cx, round(cy, 6) as cy from b join k using (topic_id) join e using (topic_id) join dy using (topic_id) join af using (topic_id)""")
def regrouped_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all topics after the split and the merge, of which only the touched ones were made anew."""
    old = snapshots.build(_parts(spark, sf_dir))
    new, _ = snapshots.regroup(old, _mapping(old.parts.fragments))
    out = new.snapshots.select("topic_id", "space", "n_fragments", "start_s", "end_s", F.size("keywords").cast("long").alias("n_keywords"), "n_timelines", "n_clusters", "largest_cluster", *[F.round(x, 6).alias(x) for x in ("evidence_strength", "confidence", "importance")], F.array_join("affects", ",").alias("affects"))
    return out.join(new.snapshots.select("topic_id", F.round(F.get("centroid", F.lit(0)), 6).alias("cx"), F.round(F.get("centroid", F.lit(1)), 6).alias("cy")), "topic_id")

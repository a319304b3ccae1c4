"""Topic snapshots and their upkeep: one row and the links of each topic from its fragments; splits and merges recompute the touched topics only.

Everything of a snapshot comes from the topic's own fragments, so a topic whose fragments did not change keeps its row. Relations compare topics, so
they follow for the whole space of a touched topic and stay for other spaces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .lifecycle import calibrated_confidence, contribution_weights, effective_importance, evidence_strength, source_importance, topic_importance
from .profiles import affect_profile
from .tables import checkpointed
from .topics import centroid, link_weights


@dataclass
class Parts:
    """What snapshots are made of. fragments: fragment_id, space, topic_id, importance, confidence, start_s, end_s, keywords, embedding. sources: fragment_id,
    timeline, cluster, base, effective (importance of the timeline). affects: fragment_id, actor, category, confidence, intensity."""

    fragments: DataFrame
    sources: DataFrame
    affects: DataFrame

    def of(self, topics: DataFrame) -> Parts:
        """The parts of some topics (topic_id)."""
        fragments = self.fragments.join(topics.select("topic_id").distinct(), "topic_id", "left_semi")
        ids = fragments.select("fragment_id")
        return Parts(fragments, self.sources.join(ids, "fragment_id", "left_semi"), self.affects.join(ids, "fragment_id", "left_semi"))


def topic_links(parts: Parts) -> DataFrame:
    """(topic_id, timeline, cluster, contribution, affinity, similarity, weight): how a topic hangs on its timelines; weight shares out the mass of
    the fragments, sums to 1 a topic, and is equal for all where no fragment has any."""
    f = parts.fragments.select("topic_id", "fragment_id", "importance", "confidence")
    rows = f.join(parts.sources.groupBy("fragment_id", "timeline").agg(F.min("cluster").alias("cluster")), "fragment_id")
    clusters = rows.groupBy("topic_id", "timeline").agg(F.min("cluster").alias("cluster"))
    base = link_weights(rows.drop("cluster").join(clusters, ["topic_id", "timeline"]).select("topic_id", "timeline", "cluster", "confidence"))
    mass = rows.groupBy("topic_id", F.col("fragment_id").alias("fact_id")).agg(F.max(c.clamp(F.col("importance"), default=0.5)).alias("mass"), F.collect_set("timeline").alias("sources"))
    weights = contribution_weights(mass)
    n = clusters.groupBy("topic_id").agg(F.count("*").alias("__n"))
    return base.join(weights, ["topic_id", "timeline"], "left").join(n, "topic_id").withColumn("weight", F.coalesce(F.nanvl("weight", F.lit(None)), 1 / F.col("__n"))).drop("__n")


def snapshots(parts: Parts, links: DataFrame) -> DataFrame:
    """A row a topic: space, span, size, keywords, centroid, semantic importance, evidence, calibrated confidence, importance with its sources', clusters and
    affect. links: topic_links of the same parts."""
    f = parts.fragments
    base = f.groupBy("topic_id").agg(F.min("space").alias("space"), F.count("*").alias("n_fragments"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.avg(c.clamp(F.col("confidence"), default=0.7)).alias("__c"))
    words = f.select("topic_id", F.explode("keywords").alias("w")).groupBy("topic_id").agg(F.array_sort(F.collect_set("w")).alias("keywords"))
    per = links.groupBy("topic_id", "cluster").agg(F.count("*").alias("n"))
    evidence = per.groupBy("topic_id").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_timelines"), F.max("n").alias("largest_cluster"))
    known = parts.sources.groupBy("timeline").agg(F.max("base").alias("base"), F.max("effective").alias("effective"))
    sourced = source_importance(links.join(known, "timeline").select("topic_id", "cluster", "base", "effective", "weight"))
    felt = parts.affects.join(f.select("fragment_id", "topic_id"), "fragment_id").withColumn("weight", F.lit(1.0)).select("topic_id", "actor", "category", "confidence", "intensity", "weight")
    affect = affect_profile(felt).groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "category"))), lambda x: x["category"]).alias("affects"))
    df = base.join(words, "topic_id", "left").join(evidence, "topic_id", "left").join(topic_importance(f).withColumnRenamed("importance", "semantic_importance"), "topic_id").join(sourced, "topic_id", "left").join(affect, "topic_id", "left").join(centroid(f, ["topic_id"]), "topic_id", "left")
    n = F.coalesce("n_timelines", F.lit(0))
    return df.select(
        "topic_id", "space", "n_fragments", "start_s", "end_s", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), n.alias("n_timelines"), F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), F.coalesce("largest_cluster", F.lit(0)).alias("largest_cluster"),
        "semantic_importance", evidence_strength(F.coalesce("n_clusters", F.lit(0)), n).alias("evidence_strength"), calibrated_confidence(F.col("__c"), n).alias("confidence"),
        effective_importance(F.col("semantic_importance"), F.coalesce("dynamic_factor", F.lit(1.0))).alias("importance"), F.coalesce("affects", F.array().cast("array<string>")).alias("affects"), "centroid",
    )


@dataclass
class Build:
    """Snapshots and links of all topics, and the assignment they come from."""

    parts: Parts
    snapshots: DataFrame
    links: DataFrame


def build(parts: Parts) -> Build:
    """From nothing."""
    links = checkpointed(topic_links(parts))
    return Build(parts, checkpointed(snapshots(parts, links)), links)


def regroup(old: Build, mapping: DataFrame) -> tuple[Build, DataFrame]:
    """Splits and merges: mapping (fragment_id, topic_id) gives some fragments another topic. Returns the new build and the touched topics.

    Touched are the topics that fragments leave or join; only their fragments are read again, and a topic left without any is gone. A fragment that is
    mapped to its own topic touches nothing; of several mappings of one fragment the least topic counts."""
    to = mapping.groupBy("fragment_id").agg(F.min("topic_id").alias("__to"))
    moved = old.parts.fragments.join(to, "fragment_id", "left").withColumn("__from", F.col("topic_id")).withColumn("topic_id", F.coalesce("__to", "topic_id"))
    touched = checkpointed(moved.where(F.col("topic_id") != F.col("__from")).select(F.explode(F.array("topic_id", "__from")).alias("topic_id")).distinct())
    parts = Parts(checkpointed(moved.drop("__to", "__from").select(old.parts.fragments.columns)), old.parts.sources, old.parts.affects)
    fresh = build(parts.of(touched))
    kept = lambda before, after: checkpointed(before.join(touched, "topic_id", "left_anti").unionByName(after))
    return Build(parts, kept(old.snapshots, fresh.snapshots), kept(old.links, fresh.links)), touched


def relations_after(old: DataFrame, build: Build, before: Build, touched: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Relations (space, ...) once topics were touched: derived anew, by `derive` from their snapshots, for the spaces of touched topics, and kept for others."""
    spaces = checkpointed(build.snapshots.unionByName(before.snapshots).join(touched, "topic_id", "left_semi").select("space").distinct())
    return old.join(spaces, "space", "left_anti").unionByName(derive(build.snapshots.join(spaces, "space", "left_semi")))

"""New components against existing topics: candidates from two lanes, scores, decisions, and the vote of siblings.

A component is a group of new fragments. Topics come into question if they are among its nearest by vector or have a source in common; both lanes
are united before anything is scored. A topic with a common source or fact is scored for continuity, any other for meaning alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from .retrieval import vector_top_k
from .tables import checkpointed
from .vector_blocks import met

#: Default bounds of the decision.
THRESHOLD, MARGIN, REVIEW, ANCHOR_MARGIN, ANCHORS, BONUS, BAND = 0.55, 0.04, 0.72, 0.03, 2, 0.10, 0.10
SEMANTIC_FLOOR, REPRESENTATIVE_FLOOR, RERANK_FLOOR, RERANK_SURE = 0.78, 0.65, 0.63, 0.75


def candidate_topics(components: DataFrame, topics: DataFrame, k: int = 8) -> DataFrame:
    """(space, uid, topic_uid): each component's k nearest topics of its space, and those with a source in common. components: space, uid, embedding,
    sources; topics: space, topic_uid, embedding, sources."""
    near = vector_top_k(topics.select("space", F.col("topic_uid").alias("doc_id"), "embedding"), components.select("space", F.col("uid").alias("query_id"), "embedding"), k, scope=("space",))
    lane = near.select(F.col("query_id").alias("uid"), F.col("doc_id").alias("topic_uid")).join(components.select("uid", "space"), "uid")
    mine = components.select("space", "uid", F.explode("sources").alias("source"))
    theirs = topics.select("space", "topic_uid", F.explode("sources").alias("source"))
    linked = mine.join(theirs, ["space", "source"]).select("space", "uid", "topic_uid")
    return lane.select("space", "uid", "topic_uid").union(linked).distinct()


def representative_support(candidates: DataFrame, own: DataFrame, formal: DataFrame) -> DataFrame:
    """(uid, topic_uid, representative): 0.7 of the mean and 0.3 of the least of the best cosines of a component's fragments with a topic's; no row
    where either has none. own: uid, fragment_id, embedding; formal: topic_uid, embedding."""
    pairs = checkpointed(candidates.select("uid", "topic_uid"))
    mine = own.select("uid", F.col("fragment_id").alias("query_id"), c.unit(F.col("embedding")).alias("__q"))
    theirs = formal.select("topic_uid", F.lit(0).alias("doc_id"), c.unit(F.col("embedding")).alias("__v"))
    near = met(pairs.join(theirs, "topic_uid"), pairs.join(mine, "uid"), ("uid", "topic_uid"), k=1)
    each = near.groupBy("uid", "topic_uid", "query_id").agg(F.max("score").alias("best"))
    return each.groupBy("uid", "topic_uid").agg(c.clamp(0.70 * F.avg("best") + 0.30 * F.min("best")).alias("representative"))


def _share(part: Column, whole: Column) -> Column:
    return F.size(part) / F.greatest(F.lit(1), F.size(whole))


def scored_candidates(candidates: DataFrame, components: DataFrame, topics: DataFrame, own: DataFrame, formal: DataFrame, reranked: DataFrame | None = None, threshold: float = THRESHOLD, half_life: float = 7 * 86400.0) -> DataFrame:
    """Candidates with their lane, score, and the parts that decide: space, uid, topic_uid, lane, score, semantic, representative, lexical.

    components and topics: space, uid or topic_uid, embedding, and the arrays terms, actors, facts (fingerprints), sources, and start_s, end_s; own, formal: see
    representative_support; reranked: uid, topic_uid, percentile. An extension without enough meaning stays just below the threshold."""
    left = components.select("uid", *[F.col(x).alias("l_" + x) for x in ("embedding", "terms", "actors", "facts", "sources", "start_s", "end_s")])
    right = topics.select("topic_uid", *[F.col(x).alias("r_" + x) for x in ("embedding", "terms", "actors", "facts", "sources", "start_s", "end_s")])
    support = representative_support(candidates, own, formal)
    df = candidates.join(left, "uid").join(right, "topic_uid").join(support, ["uid", "topic_uid"], "left")
    df = df.join(reranked, ["uid", "topic_uid"], "left") if reranked is not None else df.withColumn("percentile", F.lit(0.0))
    both = lambda f, x: f(f"l_{x}", f"r_{x}")
    meet = (F.least("l_end_s", "r_end_s") >= F.greatest("l_start_s", "r_start_s")).cast("boolean")
    times = F.col("l_start_s"), F.col("l_end_s"), F.col("r_start_s"), F.col("r_end_s")
    df = df.withColumns({
        "semantic": F.round(c.cosine(F.col("l_embedding"), F.col("r_embedding")), 9), "lexical": c.jaccard(F.col("l_terms"), F.col("r_terms")),
        "continuity": _share(both(F.array_intersect, "facts"), F.col("l_facts")), "overlap": _share(both(F.array_intersect, "sources"), both(F.array_union, "sources")),
        "known": (F.size("l_actors") > 0) & (F.size("r_actors") > 0), "actor": c.jaccard(F.col("l_actors"), F.col("r_actors")),
        "affinity": F.coalesce(F.when(meet, c.interval_affinity(*times)), F.lit(0.0)), "proximity": F.coalesce(c.interval_proximity(*times, half_life), F.lit(0.0)), "percentile": F.coalesce("percentile", F.lit(0.0)),
    }).withColumn("representative", F.round(F.coalesce("representative", c.clamp(F.col("semantic"))), 9))
    s, r = F.col("semantic"), F.col("representative")
    continued = (F.col("continuity") > 0) | (F.col("overlap") > 0)
    continuation = 0.40 * F.col("continuity") + 0.40 * s + 0.10 * F.col("lexical") + 0.05 * (0.5 * F.col("actor") + 0.5 * F.col("affinity")) + 0.05 * F.col("overlap")
    extension = F.least(F.lit(1.0), 0.55 * s + 0.30 * r + 0.13 * F.col("lexical") + 0.02 * F.col("percentile") + 0.05 * F.col("proximity")) - F.when(F.col("known"), 0.05 * (1 - F.col("actor"))).otherwise(0.0)
    enough = (s >= SEMANTIC_FLOOR) | (r >= REPRESENTATIVE_FLOOR) | ((s >= RERANK_FLOOR) & (r >= RERANK_FLOOR) & (F.col("percentile") >= RERANK_SURE))
    extension = F.when(enough, extension).otherwise(F.least(extension, F.lit(max(0.0, threshold - 1e-6))))
    out = df.withColumn("lane", F.when(continued, "source_continuity").otherwise("semantic_extension")).withColumn("score", F.round(F.when(continued, continuation).otherwise(extension), 9))
    return out.select("space", "uid", "topic_uid", "lane", "score", "semantic", "representative", F.round("lexical", 9).alias("lexical"))


def decide(scored: DataFrame, components: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, review: float = REVIEW) -> DataFrame:
    """(space, uid, decision, reason, topic_uid, score, runner_up) of every component: update, create or review.

    Below the threshold a topic is created. Two candidates within the margin leave the choice open, unless the first extends with clearly more meaning;
    then strong ones ask for review and others make a new topic. topic_uid is given for updates; score and runner_up are the two best."""
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "topic_uid")
    ranked = scored.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= 2)
    pick = lambda n: F.max(F.when(F.col("__n") == n, F.struct("topic_uid", "score", "lane", "semantic", "representative", "lexical"))).alias(f"c{n}")
    df = components.select("space", "uid").join(ranked.groupBy("uid").agg(pick(1), pick(2)), "uid", "left")
    first, second = F.coalesce(F.col("c1.score"), F.lit(-1.0)), F.coalesce(F.col("c2.score"), F.lit(-1.0))
    bar = max(threshold, review)
    close = (second >= threshold) & (F.round(first - second, 9) < margin)
    extends = (F.col("c1.lane") == "semantic_extension") & (F.col("c2.lane") == "semantic_extension")
    more = (F.col("c1.semantic") >= F.round(F.col("c2.semantic") + 0.02, 9)) & (F.col("c1.representative") >= F.round(F.col("c2.representative") + 0.015, 9)) & (F.col("c1.lexical") >= F.col("c2.lexical"))
    dominant = (first >= bar) & extends & more
    low = first < threshold
    decision = F.when(low, "create").when(~close | dominant, "update").when(second >= bar, "review").otherwise("create")
    reason = F.when(low, "below_match_threshold").when(~close, F.col("c1.lane")).when(dominant, "dominant_semantic_extension").otherwise("close_candidates")
    return df.select("space", "uid", decision.alias("decision"), reason.alias("reason"), F.when(decision == "update", F.col("c1.topic_uid")).alias("topic_uid"), F.col("c1.score").alias("score"), F.col("c2.score").alias("runner_up"))


def sibling_rescue(decisions: DataFrame, scored: DataFrame, events: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, anchor_margin: float = ANCHOR_MARGIN, anchors: int = ANCHORS, bonus: float = BONUS, band: float = BAND) -> DataFrame:
    """The decisions after siblings have voted. events: uid, event (a timeline and its cluster), distinct.

    Components that update with a lead vote for their topic in each of their events. A topic with at least `anchors` votes and more than any other
    is the event's. A component whose own decision is not already that takes the topic with the most votes over its events, if it is a
    candidate with some meaning, not further than `band` below the threshold, and with the bonus comes first by a lead."""
    decisions, scored = checkpointed(decisions), checkpointed(scored)
    sure = decisions.where((F.col("decision") == "update") & (F.col("score") >= threshold) & (F.round(F.col("score") - F.coalesce("runner_up", F.lit(0.0)), 9) >= anchor_margin))
    votes = sure.select("uid", "topic_uid", "score").join(events, "uid").groupBy("event", "topic_uid").agg(F.count("*").alias("n"), F.sum("score").alias("sum"))
    most = Window.partitionBy("event").orderBy(F.col("n").desc())
    ruled = votes.withColumn("__r", F.rank().over(most)).withColumn("__k", F.count("*").over(Window.partitionBy("event", "n"))).where((F.col("__r") == 1) & (F.col("__k") == 1) & (F.col("n") >= anchors))
    targets = events.join(ruled.select("event", "topic_uid", "n", "sum"), "event").groupBy("uid", "topic_uid").agg(F.sum("n").alias("n"), F.round(F.sum("sum"), 9).alias("sum"))
    order = Window.partitionBy("uid").orderBy(F.col("n").desc(), F.col("sum").desc(), "topic_uid")
    target = targets.withColumn("__o", F.row_number().over(order)).where(F.col("__o") == 1).select("uid", F.col("topic_uid").alias("target"), F.col("n").alias("votes"))
    own = scored.join(target, "uid")
    hit = F.col("topic_uid") == F.col("target")
    rivals = own.groupBy("uid", "target", "votes").agg(
        F.max(F.when(hit, F.struct("score", "semantic", "representative"))).alias("__t"),
        F.max(F.when(~hit, F.struct(F.col("score"), (F.col("topic_uid") < F.col("target")).alias("before")))).alias("__rival"),
    )
    raised = F.round(F.least(F.lit(1.0), F.col("__t.score") + bonus), 9)
    rival = F.coalesce(F.col("__rival.score"), F.lit(0.0))
    ahead = (raised > rival) | ((raised == rival) & ~F.coalesce("__rival.before", F.lit(False)))
    lead = F.round(raised - rival, 9) >= min(margin, anchor_margin)
    fit = F.col("__t").isNotNull() & ((F.col("__t.semantic") >= 0.50) | (F.col("__t.representative") >= 0.50)) & (F.col("__t.score") >= round(threshold - band, 9)) & (raised >= threshold) & ahead & lead
    rescued = rivals.where(fit).select("uid", "target", "votes", raised.alias("raised"), F.col("__rival.score").alias("rival"))
    df = decisions.join(rescued, "uid", "left")
    moved = F.col("target").isNotNull() & ~F.coalesce((F.col("decision") == "update") & (F.col("topic_uid") == F.col("target")), F.lit(False))
    keep = lambda new, old: F.when(moved, new).otherwise(F.col(old)).alias(old)
    return df.select("space", "uid", keep(F.lit("update"), "decision"), keep(F.lit("dominant_same_event_siblings"), "reason"), keep(F.col("target"), "topic_uid"), keep(F.col("raised"), "score"), keep(F.col("rival"), "runner_up"), F.when(moved, F.col("votes")).alias("votes"))

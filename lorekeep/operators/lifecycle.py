"""Decay, expiry, reinforcement, importance and other aging of memories, facts and topics. `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c


def daily_decay(memories: DataFrame, rate: float, days: int, now: float, window_days: float = 30.0, max_access: float = 10.0, access_left: float = 0.5) -> DataFrame:
    """One decay run over `days` days: access protects, importance has a floor of 0.01, access counts are halved. Two runs of one day are
    not one of two, as rounding and halving happen once a run."""
    recent = F.when(F.coalesce("last_access_epoch", F.lit(0.0)) >= now - max(1.0, window_days) * 86400, 1.0).otherwise(0.5)
    access = F.least(F.lit(1.0), F.coalesce("access_count", F.lit(0)) / max(1.0, max_access))
    factor = F.pow(1 - rate * (1 - 0.5 * access * recent), F.lit(float(days)))
    return memories.withColumn("importance", F.greatest(F.lit(0.01), F.round(c.clamp(F.col("importance"), default=0.5) * factor, 4))).withColumn("access_count", F.floor(F.coalesce("access_count", F.lit(0)) * access_left).cast("long"))


def cleanup_candidates(memories: DataFrame, now: float, days: float = 30.0, floor: float = 0.3) -> DataFrame:
    """Memories both old and unimportant."""
    last = F.greatest(F.coalesce("create_epoch", F.lit(0.0)), F.coalesce("last_access_epoch", F.lit(0.0)))
    return memories.where((last < now - days * 86400) & (F.col("importance") < floor))


def atom_states(atoms: DataFrame, now: float, forget_days: float = 30.0, purge_days: float = 90.0) -> DataFrame:
    """active -> expired -> forgotten -> purged, each step on the state that the step before left. atoms: status, expires_s."""
    late = F.lit(now) - F.col("expires_s")
    expired = F.when((F.col("status") == "active") & (late >= 0), "expired").otherwise(F.col("status"))
    forgotten = F.when((expired == "expired") & (late >= forget_days * 86400), "forgotten").otherwise(expired)
    return atoms.withColumn("status", F.when((forgotten == "forgotten") & (late >= purge_days * 86400), "purged").otherwise(forgotten))


def reinforce(atoms: DataFrame, hits: DataFrame, now: float) -> DataFrame:
    """atoms: atom_id, kind, importance, confidence, reinforcement_count. hits: atom_id, new_id, confidence: folded in the order of
    new_id: count + 1, confidence 0.7 old + 0.3 new; then the time to live and the expiry anew."""
    folded = hits.groupBy("atom_id").agg(F.array_sort(F.collect_list(F.struct("new_id", "confidence"))).alias("__hits"))
    df = atoms.join(folded, "atom_id")
    df = df.withColumn("confidence", F.aggregate("__hits", F.col("confidence").cast("double"), lambda acc, x: acc * 0.7 + x["confidence"] * 0.3)).withColumn("reinforcement_count", F.col("reinforcement_count") + F.size("__hits"))
    ttl = c.ttl_days(F.col("kind"), F.col("importance"), F.col("reinforcement_count"), F.lit(None).cast("double"))
    return df.withColumn("ttl_days", ttl).withColumn("expires_s", F.lit(now) + F.col("ttl_days") * 86400).drop("__hits")


def fragment_importance(facts: DataFrame) -> DataFrame:
    """facts: fragment_id, importance. 0.7 of the highest and 0.3 of the mean of the three highest."""
    w = Window.partitionBy("fragment_id").orderBy(F.col("importance").desc())
    top = facts.withColumn("importance", c.clamp(F.col("importance"), default=0.5)).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= 3)
    return top.groupBy("fragment_id").agg((0.7 * F.max("importance") + 0.3 * F.avg("importance")).alias("importance"))


def topic_importance(fragments: DataFrame) -> DataFrame:
    """fragments: topic_id, importance, confidence. 0.6 of the highest and 0.4 of the confidence-weighted mean."""
    w = F.greatest(F.lit(0.01), c.clamp(F.col("confidence"), default=0.7))
    return fragments.groupBy("topic_id").agg((0.6 * F.max("importance") + 0.4 * F.sum(F.col("importance") * w) / F.sum(w)).alias("importance"))


def evidence_strength(clusters: Column, timelines: Column) -> Column:
    a = F.least(F.lit(1.0), 0.45 + 0.18 * (F.greatest(F.lit(1), clusters) - 1))
    b = F.least(F.lit(1.0), 0.55 + 0.1 * (F.greatest(F.lit(1), timelines) - 1))
    return 0.7 * a + 0.3 * b


def calibrated_confidence(confidence: Column, n: Column, prior: float = 0.6, strength: float = 2.0) -> Column:
    """Shrunk to the prior, less with more evidence."""
    return (confidence * n + prior * strength) / (n + strength)


def source_importance(sources: DataFrame) -> DataFrame:
    """sources: topic_id, cluster, base, effective, weight. Weighted means per time cluster, clusters weighted by their largest weight;
    topics whose weights are all zero count their sources alike."""
    zero = F.max("weight").over(Window.partitionBy("topic_id")) <= 0
    n = F.count("*").over(Window.partitionBy("topic_id"))
    df = sources.withColumn("weight", F.when(zero, 1 / n).otherwise(F.col("weight"))).where(F.col("weight") > 0)
    w = F.col("weight")
    per = df.groupBy("topic_id", "cluster").agg((F.sum(F.col("base") * w) / F.sum(w)).alias("b"), (F.sum(F.col("effective") * w) / F.sum(w)).alias("e"), F.max(w).alias("cw"))
    out = per.groupBy("topic_id").agg((F.sum(F.col("b") * F.col("cw")) / F.sum("cw")).alias("source_base"), (F.sum(F.col("e") / F.greatest(F.lit(0.01), F.col("b")) * F.col("cw")) / F.sum("cw")).alias("dynamic_factor"))
    return out.withColumn("dynamic_factor", F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("dynamic_factor"))))


def effective_importance(base: Column, dynamic: Column, influence: float = 0.15) -> Column:
    return c.clamp(c.clamp(base) * ((1 - influence) + influence * c.clamp(dynamic)))


def contribution_weights(facts: DataFrame) -> DataFrame:
    """facts: topic_id, fact_id, mass, sources (array of timelines). A fact's mass is shared by its sources; weights sum to 1 a topic."""
    shared = facts.dropDuplicates(["topic_id", "fact_id"]).withColumn("__each", F.col("mass") / F.size("sources")).select("topic_id", F.explode("sources").alias("timeline"), "__each")
    summed = shared.groupBy("topic_id", "timeline").agg(F.sum("__each").alias("w"))
    return summed.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("topic_id"))).drop("w")


def score_distribution(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.min(score).alias("lo"), F.percentile(score, F.lit(0.1)).alias("p10"), F.percentile(score, F.lit(0.5)).alias("median"), F.percentile(score, F.lit(0.9)).alias("p90"), F.max(score).alias("hi"))


def profile_lifecycle(facts: DataFrame, now: float, stale_days: float = 90.0) -> DataFrame:
    """Active facts past review become stale, pending ones archived, long-stale ones archived; pinned facts stay."""
    due = F.coalesce(F.col("review_after") <= now, F.lit(False)) & ~F.coalesce(F.col("pinned"), F.lit(False))
    old = F.coalesce(F.col("review_after") <= now - stale_days * 86400, F.lit(False))
    s = F.col("status")
    return facts.withColumn("status", F.when(due & (s == "active"), "stale").when(due & (s == "pending"), "archived").when(due & old & (s == "stale"), "archived").otherwise(s))


def fact_is_current(status: Column, pinned: Column, review_after: Column, now: float) -> Column:
    return (status == "active") & (F.coalesce(pinned, F.lit(False)) | review_after.isNull() | (review_after > now))

"""User profiles and affect: fact sources, projection, admission, behaviour, identity, emotion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from .retrieval import top_k
from .tables import checkpointed


def serving_facts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Current facts with their representative source. facts: fact_uid, source_uid, pinned, importance, updated_s; sources: source_uid, ..."""
    return facts.join(sources, "source_uid").orderBy(F.col("pinned").desc(), F.col("importance").desc(), F.col("updated_s").desc_nulls_last(), "fact_uid")


def replace_contributions(sources: DataFrame, changed: DataFrame, incoming: DataFrame) -> DataFrame:
    """Deactivates the sources of changed timelines and adds the incoming ones. sources: source_uid, fact_uid, timeline, at_s, confidence,
    active."""
    hit = changed.select("timeline", F.lit(True).alias("__c")).distinct()
    kept = sources.join(hit, "timeline", "left").withColumn("active", F.col("active") & F.col("__c").isNull()).drop("__c")
    return kept.select(*sources.columns).unionByName(incoming.select(*sources.columns))


def judge_facts(facts: DataFrame, sources: DataFrame, min_timelines: int = 2, min_days: float = 1.0) -> DataFrame:
    """A fact without active sources is archived; a behaviour with too few timelines or too short a span is stale; a representative that is
    not active is replaced by the best one left. facts: fact_uid, kind, status, source_uid."""
    live = sources.where("active").groupBy("fact_uid").agg(F.countDistinct("timeline").alias("n"), ((F.max("at_s") - F.min("at_s")) / 86400).alias("days"), F.max_by("source_uid", F.struct("confidence", "at_s", "source_uid")).alias("best"))
    still = sources.where("active").select("source_uid", F.lit(True).alias("__alive"))
    df = facts.join(live, "fact_uid", "left").join(still, "source_uid", "left")
    weak = (F.col("kind") == "behaviour") & ((F.col("n") < min_timelines) | (F.col("days") < min_days))
    status = F.when(F.col("n").isNull(), "archived").when(weak, "stale").otherwise(F.col("status"))
    return df.withColumn("status", status).withColumn("source_uid", F.when(F.col("__alive"), F.col("source_uid")).otherwise(F.col("best"))).select("fact_uid", "kind", "status", "source_uid", F.coalesce("n", F.lit(0)).alias("n_timelines"))


#: Length classes of claims, each twice as long as the one before; code points that one step indexes; grams of the shortest claims up to which they are sent to every task.
CLASSES, INDEX_CHARS, SENT_GRAMS = 4, 1 << 20, 4_000_000


def _grams(texts: list[str], salts: np.ndarray, contained: int, classes: Iterable[int], wanted: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, text number, gram) of texts, each gram once a text. Class 0 has all grams of `contained` characters. Class c holds, of each stretch of contained * 2 ** c characters, the least of
    its grams of half that length: whatever contains such a stretch holds the same gram. Of class 0, only wanted grams if those are given."""
    sizes = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n, factor = len(x), 0x9E3779B97F4A7C15
    power = lambda f: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), f, np.uint64))])[:n]
    sums, back = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power(factor))]), power(pow(factor, -1, 1 << 64))
    owner, ends, salt = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes), np.repeat(salts, sizes)
    for k in classes:
        span = contained << k
        size, width = (span, 1) if k == 0 else (span // 2, span - span // 2 + 1)
        if n < span:
            continue
        places = n - size + 1
        h = (sums[size:] - sums[:places]) * back[:places] + salt[:places]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        step = 1
        while 2 * step <= width:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if width > step:
            h = np.minimum(h[: step - width], h[width - step :])
        at = np.flatnonzero(np.arange(len(h)) + span <= ends[: len(h)])
        if k == 0 and wanted is not None:
            at = at[np.isin(h[at], wanted)]
        at = at[np.lexsort((h[at], owner[at]))]
        o, g = owner[at], h[at]
        once = np.ones(len(at), bool)
        once[1:] = (o[1:] != o[:-1]) | (g[1:] != g[:-1])
        yield k, o[once], g[once]


def _claim_grams(claims: DataFrame, contained: int, classes: tuple[int, ...], wanted: np.ndarray | None = None) -> DataFrame:
    """claims: cid, salt, k. (cid, class, gram, own): own are those of the claim's longest class, which its containers hold too."""
    sent = None if wanted is None else claims.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cids, salts = batch.column("k").to_pylist(), batch.column("cid").to_numpy(), batch.column("salt").to_numpy().view(np.uint64)
            sizes = np.array([len(t) for t in texts], np.int64)
            last = np.clip(np.log2(np.maximum(sizes, contained) / contained + 1e-12).astype(np.int64), 0, CLASSES - 1)
            part = np.cumsum(sizes) // INDEX_CHARS
            for bounds in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
                if len(bounds):
                    first = bounds[0]
                    for k, o, g in _grams([texts[i] for i in bounds], salts[bounds], contained, classes, None if sent is None else sent.value):
                        yield pa.RecordBatch.from_arrays([pa.array(cids[o + first]), pa.array(np.full(len(o), k, np.int32)), pa.array(g.view(np.int64)), pa.array(last[o + first] == k)], ["cid", "class", "gram", "own"])

    return claims.mapInArrow(run, "cid long, class int, gram long, own boolean")


def collapse_claims(claims: DataFrame, contained: int = 12) -> DataFrame:
    """claims: profile, claim_id, text, at_s. Equal claims fall together first, by grouping; then, inside a profile, a claim of `contained`
    characters or more that is contained in a longer one joins it. The longest, then newest, stands for a group. Returns profile,
    claim_id, representative.

    Containers are found by a join on the rarest of the claim's grams, which every container holds, and verified. The longer the claim, the longer and the fewer are
    its grams (`_grams`), so a text is indexed by a part of its places; all its places count only for claims of less than twice `contained` characters, whose grams are sent to the
    tasks if they are few."""
    keyed = claims.withColumn("k", c.canonical_text(F.col("text")))
    equal = checkpointed(keyed.groupBy("profile", "k").agg(F.max_by("claim_id", F.struct("at_s", "claim_id")).alias("rep")).withColumn("cid", F.xxhash64("profile", "k")))
    long = equal.where((F.length("k") >= contained) & F.col("profile").isNotNull()).select("cid", F.xxhash64("profile").alias("salt"), "k")
    short = _claim_grams(long.where(F.length("k") < 2 * contained), contained, (0,)).select("gram").distinct()
    few = short.limit(SENT_GRAMS + 1).toPandas()["gram"].to_numpy() if long.where(F.length("k") < 2 * contained).limit(SENT_GRAMS // contained + 1).count() <= SENT_GRAMS // contained else None
    grams = checkpointed(_claim_grams(long, contained, tuple(range(CLASSES)), None if few is None else np.sort(few.view(np.uint64))))
    often = grams.groupBy("class", "gram").agg(F.count("*").alias("n"), F.bool_or("own").alias("asked")).where("n > 1 and asked").drop("asked")
    # a claim with a gram that no other has needs no partner
    rarest = grams.where("own").join(often, ["class", "gram"], "left").groupBy(F.col("cid").alias("__cid")).agg(F.count("*").alias("all"), F.count("n").alias("met"), F.min(F.struct("n", "class", "gram")).alias("m")).where("all = met").select("__cid", "m.class", "m.gram")
    met = grams.select("cid", "class", "gram").join(rarest, ["class", "gram"]).where("cid <> __cid").select("cid", "__cid").distinct()
    own = equal.select(F.col("profile").alias("__of"), F.col("rep").alias("__rep"), F.col("k").alias("__k"), F.col("cid").alias("__cid"))
    near = met.join(own, "__cid").join(equal, "cid").where("profile = __of")
    near = near.where((F.length("k") > F.length("__k")) & F.contains("k", "__k"))
    # the longest container is contained in no other claim, or that would be longer
    head = near.groupBy("profile", "__rep").agg(F.min(F.struct((-F.length("k")).alias("l"), "rep"))["rep"].alias("__head"))
    merged = equal.join(head.withColumnRenamed("__rep", "rep"), ["profile", "rep"], "left").select(F.col("profile").alias("__p"), F.col("k").alias("__k"), F.coalesce("__head", "rep").alias("representative"))
    return keyed.join(merged, F.col("profile").eqNullSafe(F.col("__p")) & F.col("k").eqNullSafe(F.col("__k"))).select("profile", "claim_id", "representative")


def admission(evidence: DataFrame, min_timelines: int = 2, min_days: float = 1.0, min_confidence: float = 0.6, allowed: tuple[str, ...] = ("explicit", "observed")) -> DataFrame:
    """evidence: fact_uid, timeline, at_s, confidence, claim_type. Reasons against each fact, none if admitted."""
    g = evidence.groupBy("fact_uid").agg(F.countDistinct("timeline").alias("n"), ((F.max("at_s") - F.min("at_s")) / 86400).alias("days"), F.max("confidence").alias("confidence"), F.bool_or(F.col("claim_type").isin(*allowed)).alias("ok"))
    reasons = F.array_compact(F.array(F.when(F.col("n") < min_timelines, "too_few_timelines"), F.when(F.col("days") < min_days, "too_short"), F.when(F.col("confidence") < min_confidence, "low_confidence"), F.when(~F.col("ok"), "claim_type")))
    return g.select("fact_uid", "n", "confidence", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("admitted"))


def behaviour_evidence(evidence: DataFrame, assigned: DataFrame, now: float, days: float) -> DataFrame:
    """Distinct behavioural evidence of the retention window that no fact holds yet."""
    recent = evidence.where((F.col("claim_type") == "observed") & (F.col("at_s") >= now - days * 86400))
    return recent.join(assigned.select("evidence_id"), "evidence_id", "left_anti").dropDuplicates(["profile", "timeline", "text"])


def repeated_contexts(evidence: DataFrame, minutes: int = 120, min_timelines: int = 3, min_days: float = 2.0, most: int = 4) -> DataFrame:
    """evidence: profile, timeline, term, minute, at_s. For each term, the timelines whose time of day is within `minutes` of one piece of
    evidence: enough of them over enough days make a candidate; the `most` best of a profile. Evidence of one minute sees the same timelines, so
    minutes meet, not pieces of evidence: timelines with one minute as counts of it, others one by one. The clock bounds what a minute meets."""
    width = minutes
    cells = 1440 // width
    cell = F.floor(F.col("minute") / width)
    points = checkpointed(evidence.where(F.col("minute").isNotNull()).groupBy("profile", "term", "timeline", "minute").agg(F.min("at_s").alias("lo"), F.max("at_s").alias("hi")))
    seeds = points.groupBy("profile", "term", "minute").agg(F.min(F.struct("timeline"))["timeline"].alias("seed"))
    around = sorted({d % cells for d in (-1, 0, 1)})
    seeds = seeds.select("profile", "term", "seed", F.col("minute").alias("m"), F.explode(F.array(*[F.pmod(cell + d, F.lit(cells)) for d in around])).alias("cell"))
    marked = points.withColumn("alone", F.count("*").over(Window.partitionBy("profile", "term", "timeline")) == 1).withColumn("cell", F.pmod(cell, F.lit(cells)))
    near = lambda rows: seeds.join(rows, ["profile", "term", "cell"]).where(c.minute_distance(F.col("m"), F.col("minute")) <= minutes).groupBy("profile", "term", "seed", "m")
    alone = marked.where("alone").groupBy("profile", "term", "cell", "minute").agg(F.count("timeline").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    span = F.min("lo").alias("lo"), F.max("hi").alias("hi")
    both = near(alone).agg(F.sum("k").alias("k"), *span).unionByName(near(marked.where("not alone")).agg(F.countDistinct("timeline").alias("k"), *span))
    g = both.groupBy("profile", "term", "seed", "m").agg(F.sum("k").alias("n"), ((F.max("hi") - F.min("lo")) / 86400).alias("days")).where((F.col("n") >= min_timelines) & (F.col("days") >= min_days))
    best = top_k(g.withColumn("score", F.col("n").cast("double")), 1, by=["profile", "term"], ids=("m", "seed"), rank="__r")
    return top_k(best.select("profile", "term", "seed", "m", "n", "days", "score"), most, by=["profile"], ids=("term",)).drop("score")


def context_candidates(evidence: DataFrame, clusters: DataFrame, minutes: int = 120, min_timelines: int = 3, min_days: float = 2.0, most_common: float = 0.9, most: int = 4) -> DataFrame:
    """(profile, term, refs, n, days): per profile the `most` best sets of evidence that share a term and a time of day. evidence: profile, ref, timeline, term (distinct for a
    ref), minute (null: unknown), at_s; clusters: profile, cluster, ref.

    Every piece of evidence with a known minute is a seed, with the nearest piece of each timeline within `minutes` (then the least ref). A set needs enough timelines and days,
    its term at least `min_timelines` pieces of evidence and less than `most_common` of the profile's (three always pass). Equal sets count once, under the rarest, then least, term; a set inside
    a given cluster is none: what clusters all its refs share is an intersection of the refs' own.

    Seeds of one minute see the same set, so minutes are seeds. Timelines with one piece of evidence for a term meet them as sums by minute, others one by one. Equal sets have equal n and days,
    so the best sets are among the first `most` values of these, and refs are gathered for those only. The clock bounds a term's seeds and their sums; a set holds one ref a timeline."""
    cells = max(1, 1440 // minutes)
    width = 1440 / cells
    whole = evidence.groupBy("profile").agg(F.countDistinct("ref").alias("all"))
    often = evidence.groupBy("profile", "term").agg(F.countDistinct("ref").alias("df")).join(whole, "profile")
    anchors = often.where((F.col("df") >= min_timelines) & (F.col("df") < F.greatest(F.lit(3.0), F.col("all") * most_common))).select("profile", "term", "df")
    holders = clusters.groupBy("profile", "ref").agg(F.collect_set("cluster").alias("held"))
    kept = evidence.where(F.col("minute").isNotNull()).join(anchors, ["profile", "term"]).join(holders, ["profile", "ref"], "left").withColumn("held", F.coalesce("held", F.array().cast(holders.schema["held"].dataType)))
    kept = checkpointed(kept.withColumn("cell", F.floor(F.col("minute") / width).cast("int")).withColumn("alone", F.count("*").over(Window.partitionBy("profile", "term", "timeline")) == 1))
    around = sorted({d % cells for d in (-1, 0, 1)})
    seen = F.explode(F.array(*[F.pmod(F.col("cell") + d, F.lit(cells)) for d in around]))
    gap = c.minute_distance(F.col("m"), F.col("minute"))
    lists = F.collect_list("held")
    common = F.aggregate(lists, F.element_at(lists, 1), lambda x, y: F.array_intersect(x, y)).alias("held")

    def sets(seeds: DataFrame, refs: bool) -> DataFrame:
        """(profile, term, df, m, n, lo, hi, held, and refs if asked for) of the set of each seed (profile, term, df, m, cell)."""
        more = lambda x: [x.alias("refs")] if refs else []
        near = lambda rows: seeds.join(rows.withColumn("cell", seen), ["profile", "term", "cell"]).where(gap <= minutes)
        sums = kept.where("alone").groupBy("profile", "term", "cell", "minute").agg(F.count("*").alias("n"), F.min("at_s").alias("lo"), F.max("at_s").alias("hi"), common, *more(F.collect_list("ref")))
        single = near(sums).select("profile", "term", "df", "m", "n", "lo", "hi", "held", *(["refs"] if refs else []))
        rows = near(kept.where("not alone").select("profile", "term", "cell", "minute", "timeline", "ref", "at_s", "held"))
        nearest = rows.groupBy("profile", "term", "df", "m", "timeline").agg(F.min(F.struct(gap.alias("gap"), "ref", "at_s", "held")).alias("x"))
        each = nearest.select("profile", "term", "df", "m", F.lit(1).cast("long").alias("n"), F.col("x.at_s").alias("lo"), F.col("x.at_s").alias("hi"), "x.held", *more(F.array("x.ref")))
        return single.unionByName(each).groupBy("profile", "term", "df", "m").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), common, *more(F.array_sort(F.flatten(F.collect_list("refs")))))

    days = (F.col("hi") - F.col("lo")) / 86400
    fair = sets(kept.select("profile", "term", "df", F.col("minute").alias("m"), "cell").distinct(), False).where((F.col("n") >= min_timelines) & (days + 1e-9 >= min_days) & (F.size("held") == 0))
    value = Window.partitionBy("profile").orderBy(F.col("n").desc(), days.desc())
    first = checkpointed(fair.withColumn("r", F.dense_rank().over(value)).where(F.col("r") <= most).select("profile", "term", "df", "m", F.floor(F.col("m") / width).cast("int").alias("cell")))
    best = sets(first, True).groupBy("profile", "refs").agg(F.min(F.struct("df", "term")).alias("x"), F.first("n").alias("n"), F.first(days).alias("days"))
    order = Window.partitionBy("profile").orderBy(F.col("n").desc(), F.col("days").desc(), "x.df", "x.term", "refs")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("profile", F.col("x.term").alias("term"), "refs", "n", "days", "rank")


def expand_clusters(clusters: DataFrame, evidence: DataFrame, room: int = 24) -> DataFrame:
    """clusters: cluster, profile, term (its anchors), timeline. Adds evidence of the profile that shares an anchor, from timelines that the
    cluster did not cover, up to `room` a cluster."""
    anchors = clusters.select("cluster", "profile", "term").distinct()
    more = evidence.join(anchors, ["profile", "term"]).join(clusters.select("cluster", "timeline").distinct(), ["cluster", "timeline"], "left_anti")
    shared = more.groupBy("cluster", "profile", "timeline").agg(F.countDistinct("term").cast("double").alias("score"))
    return top_k(shared, room, by=["cluster"], ids=("timeline",))


def resolve_identity(sessions: DataFrame) -> DataFrame:
    """sessions: session_id, target, native, message_actor, human (one piece of evidence a row, nulls allowed). Resolved only where every
    kind of evidence names one account, the target if there is one."""
    g = sessions.groupBy("session_id").agg(F.max("target").alias("target"), *[F.collect_set(x).alias(x) for x in ("native", "message_actor", "human")])
    every = F.array_distinct(F.concat("native", "message_actor", "human"))
    codes = F.array_compact(F.array(*[F.when(F.size(x) > 1, f"several_{x}") for x in ("native", "message_actor", "human")], F.when((F.size(every) == 1) & F.col("target").isNotNull() & (F.get(every, 0) != F.col("target")), "target_differs"), F.when(F.size(every) == 0, "no_evidence")))
    return g.select("session_id", F.array_join(codes, ",").alias("conflicts"), F.when((F.size(codes) == 0) & (F.size(every) == 1), F.get(every, 0)).alias("account"))


def profile_counts(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Facts per status of every profile, and their timelines."""
    g = facts.groupBy("profile").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("active", "stale", "pending", "archived")], F.countDistinct("timeline").alias("n_timelines"))
    return profiles.join(g, "profile", "left").fillna(0)


def build_candidates(activity: DataFrame, profiles: DataFrame, least: int) -> DataFrame:
    """Users with enough messages and no profile."""
    return activity.groupBy("profile").agg(F.count("*").alias("n_messages")).where(F.col("n_messages") >= least).join(profiles.select("profile"), "profile", "left_anti")


def profile_fingerprint(facts: DataFrame) -> DataFrame:
    """Changes whenever a visible fact of the profile does. A profile's facts bound the array."""
    rows = F.array_sort(F.collect_list(F.struct("fact_uid", "status", "content")))
    return facts.where(F.col("status") == "active").groupBy("profile").agg(F.sha2(F.to_json(rows), 256).alias("fingerprint"), F.count("*").alias("n_facts"))


def budget_facts(facts: DataFrame, budget: int) -> DataFrame:
    """facts: profile, fact_uid, content, pinned, importance. Greedy choice in order of pinned, importance, id: a fact too long for what is left
    is skipped. Returns profile and the chosen ids in order."""
    ordered = F.array_sort(F.collect_list(F.struct((~F.col("pinned")).alias("p"), (-F.col("importance")).alias("i"), "fact_uid", F.length("content").cast("long").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))

    def step(acc, x):
        fits = acc["used"] + x["n"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["ids"], x["fact_uid"])).otherwise(acc["ids"]).alias("ids"))

    return facts.groupBy("profile").agg(F.aggregate(ordered, start, step).alias("s")).select("profile", F.col("s.used").alias("used"), F.col("s.ids").alias("fact_uids"))


def meaningful_timelines(facts: DataFrame, least: int = 2) -> DataFrame:
    """facts: timeline, actors (array), confidence. Timelines where the user and another actor meet in enough confident facts."""
    hit = facts.where((F.col("confidence") >= 0.6) & (F.size(F.array_distinct("actors")) >= 2))
    return hit.groupBy("timeline").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")).where(F.col("n") >= least)


#: Emotions with their cue words and their valence, arousal and dominance.
AFFECTS = {
    "joy": (["开心", "高兴", "快乐", "兴奋", "愉快", "happy", "joy"], (0.88, 0.67, 0.72)),
    "sadness": (["难过", "伤心", "悲伤", "低落", "想哭", "sad", "upset"], (0.16, 0.36, 0.28)),
    "anger": (["生气", "愤怒", "恼火", "火大", "angry", "mad"], (0.12, 0.82, 0.76)),
    "fear": (["害怕", "恐惧", "紧张", "不安", "fear", "afraid", "scared"], (0.10, 0.84, 0.18)),
    "surprise": (["惊讶", "意外", "震惊", "surprised", "shocked"], (0.60, 0.82, 0.48)),
    "disgust": (["恶心", "厌恶", "反感", "disgust"], (0.10, 0.62, 0.62)),
    "trust": (["信任", "放心", "可靠", "trust"], (0.76, 0.34, 0.67)),
    "anticipation": (["期待", "盼望", "憧憬", "anticipat", "look forward"], (0.66, 0.61, 0.58)),
    "affection": (["喜欢", "爱", "在乎", "亲近", "依恋", "affection", "love"], (0.86, 0.46, 0.62)),
    "relief": (["松了口气", "安心", "释然", "如释重负", "relief"], (0.78, 0.24, 0.62)),
    "frustration": (["烦", "烦躁", "挫败", "无奈", "崩溃", "frustrat"], (0.18, 0.74, 0.38)),
    "concern": (["担心", "忧虑", "操心", "关心", "concern", "worry"], (0.30, 0.62, 0.32)),
    "loneliness": (["孤独", "孤单", "寂寞", "lonely"], (0.18, 0.30, 0.22)),
    "gratitude": (["感谢", "感激", "谢谢", "gratitude", "grateful"], (0.88, 0.45, 0.66)),
    "shame": (["羞耻", "丢脸", "羞愧", "shame"], (0.13, 0.54, 0.15)),
    "guilt": (["内疚", "愧疚", "自责", "guilt", "guilty"], (0.18, 0.49, 0.20)),
}
#: Fixed value: words that ask about feelings without naming one.
AFFECT_INTENT = r"情绪|感受|心情|态度|感情|关系|当时.{0,4}(?:怎么|怎样|如何)|feel(?:ing)?|emotion|mood|relationship"


def query_affect(text: Column) -> Column:
    """Struct (needs_affect, explicit, confidence, categories, valence, arousal, dominance) from cue words. An emotion with n cues has the score
    least(1, 0.72 + 0.12 n); the dimensions are means weighted by the scores, 0.5 without a cue; categories maps the four best to their scores."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    hits = {k: sum((t.contains(w).cast("int") for w in words), F.lit(0)) for k, (words, _) in AFFECTS.items()}
    score = {k: F.when(n > 0, F.least(F.lit(1.0), 0.72 + 0.12 * n)).otherwise(F.lit(0.0)) for k, n in hits.items()}
    total = sum(score.values(), F.lit(0.0))
    explicit = total > 0
    mean = lambda i: F.when(explicit, sum((s * AFFECTS[k][1][i] for k, s in score.items()), F.lit(0.0)) / total).otherwise(F.lit(0.5))
    # best first, of equal ones the first in the table
    ranked = F.sort_array(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("label")) for i, (k, s) in enumerate(score.items())]), asc=False)
    best = F.filter(F.slice(ranked, 1, 4), lambda x: x["score"] > 0)
    categories = F.map_from_entries(F.transform(best, lambda x: F.struct(x["label"], x["score"])))
    return F.struct((explicit | t.rlike(f"(?i){AFFECT_INTENT}")).alias("needs_affect"), explicit.alias("explicit"), F.greatest(*score.values()).alias("confidence"), categories.alias("categories"), mean(0).alias("valence"), mean(1).alias("arousal"), mean(2).alias("dominance"))


def affect_similarity(query: Column, event: Column) -> Column:
    """0.65 cosine of the categories + 0.35 closeness of valence, arousal and dominance, times the event's confidence; 0 without a cue."""
    part = lambda x, k: F.coalesce(F.element_at(x["categories"], F.lit(k)), F.lit(0.0))
    dot = sum((part(query, k) * part(event, k) for k in AFFECTS), F.lit(0.0))
    norm = F.sqrt(sum((part(query, k) * part(query, k) for k in AFFECTS), F.lit(0.0))) * F.sqrt(sum((part(event, k) * part(event, k) for k in AFFECTS), F.lit(0.0)))
    far = F.sqrt(sum(((query[x] - event[x]) * (query[x] - event[x]) for x in ("valence", "arousal", "dominance")), F.lit(0.0)))
    near = 0.65 * F.when(norm > 0, dot / norm).otherwise(F.lit(0.0)) + 0.35 * F.greatest(F.lit(0.0), 1 - far / 3**0.5)
    return F.when(query["explicit"], F.least(F.lit(1.0), near * event["confidence"])).otherwise(F.lit(0.0))


def affect_profile(events: DataFrame, most: int = 3) -> DataFrame:
    """events: topic_id, actor, category, confidence, intensity, weight. Support is their product; the best event of each actor and category
    counts; the `most` strongest categories of a topic are its prototypes."""
    support = F.col("confidence") * F.col("intensity") * F.col("weight")
    best = events.groupBy("topic_id", "actor", "category").agg(F.max(support).alias("support"))
    per = best.groupBy("topic_id", "category").agg(F.round(F.sum("support"), 9).alias("score"))
    return top_k(per, most, by=["topic_id"], ids=("category",)).withColumn("salience", F.col("score") / F.sum("score").over(Window.partitionBy("topic_id")))

"""Sources of profile facts out of memories: facts joined by position with their attribution, profile and time; rejects keep their reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

#: Claims that count as one's own, states of an attribution that do not, and patterns of what must not be kept.
OWN_CLAIMS = ("speaker_self", "direct_observation", "speaker_requests_other")
OPEN_ATTRIBUTIONS = ("unresolved", "uncertain", "ambiguous")
SECRETS = (
    r"(?iuU)\b(?:api[_ -]?key|access[_ -]?token|refresh[_ -]?token|password|passwd|private[_ -]?key|验证码|密码|私钥)\b",
    r"\b(?:sk|rk|pk)-[A-Za-z0-9_-]{16,}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?iuU)\b\d{6}\b.*(?:验证码|verification code|otp)",
)
#: What a fact's profile says of it, the first that holds. Each row: signal, types it needs (none: any), and one of: durabilities, reasons (neither: no
#: further condition).
SIGNALS = (
    ("relationship_only", ("relationship_interaction", "affect"), (), ()),
    ("relationship_only", (), (), ("relationship_significance", "affective_significance")),
    ("profile_direct", (), (), ("stable_personal_fact",)),
    ("behavior_evidence", ("preference",), (), ()),
    ("profile_direct", ("plan", "commitment"), ("high",), ("future_utility", "commitment_or_decision")),
    ("profile_direct", ("state",), ("high",), ("future_utility",)),
    ("behavior_pattern", (), (), ("repeated_completed_action",)),
    ("behavior_evidence", ("event", "observation", "state"), (), ()),
    ("behavior_evidence", (), (), ("completed_action", "specific_grounded_observation")),
)
REVIEW = "model_review"
SUMMARY_ONLY = "timeline_summary_only"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def profile_signal(fact_type: Column, durability: Column, reason: Column) -> Column:
    kind, lasting, why = _stripped(fact_type), _stripped(durability), _stripped(reason)
    out = F.lit(REVIEW)
    for signal, types, durabilities, reasons in reversed(SIGNALS):
        further = [x for x in (lasting.isin(*durabilities) if durabilities else None, why.isin(*reasons) if reasons else None) if x is not None]
        holds = [kind.isin(*types)] if types else []
        holds += [reduce(lambda a, b: a | b, further)] if further else []
        out = F.when(reduce(lambda a, b: a & b, holds), signal).otherwise(out)
    return out


def is_secret(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).rlike(p) for p in SECRETS])


def _numbered(rows: str, i: Column) -> Column:
    """The last row of an array of structs that is meant for fact i: by its fact_index, or by its place where it has none. Null for none."""
    known = F.filter(F.transform(F.coalesce(F.col(rows), F.array()), lambda r, n: F.struct(F.coalesce(r["fact_index"].cast("long"), n.cast("long")).alias("i"), r.alias("r"))), lambda x: x["r"].isNotNull())
    back = F.reverse(known)
    return F.get(back, F.array_position(F.transform(back, lambda x: x["i"]), i).cast("int") - 1)["r"]


def fact_sources(memories: DataFrame, summary_confidence: float = 0.45) -> DataFrame:
    """One row per fact with `reason` null for a candidate, else the first rule against it: empty_fact, other_subject, claim_type, open_attribution, relationship_only,
    secret.

    memories: timeline_uid, revision, actor_id, create_s, updated_s, importance, evidence_basis, facts (texts), and the arrays of structs attributions (fact_index,
    subjects, claim_type, status, confidence), profiles (fact_index, fact_type, durability, reason) and times (fact_index, start_s, end_s). Arrays may be null, shorter
    than the facts, in another order, or hold nulls; of several rows for a fact the last counts. A memory that rests on its summary only and has no attributions gives
    unverified candidates at the stated confidence, 0.69 at most.

    Nothing is shuffled: the arrays meet inside a memory's row before its facts become rows."""
    at = F.explode(F.sequence(F.lit(0), F.size("facts") - 1)).alias("fact_index")
    attributed = F.exists(F.coalesce("attributions", F.array()), lambda x: x.isNotNull())
    whole = memories.where(F.size("facts") > 0).withColumn("__summary", (F.coalesce("evidence_basis", F.lit("")) == SUMMARY_ONLY) & ~attributed)
    one = whole.select("*", at)
    i = F.col("fact_index").cast("long")
    one = one.select(
        "timeline_uid", F.greatest(F.lit(1).cast("long"), F.coalesce(F.col("revision").cast("long"), F.lit(1).cast("long"))).alias("revision"), "actor_id", i.alias("fact_index"), "create_s", "updated_s", "importance", "evidence_basis", "__summary",
        _stripped(F.get("facts", F.col("fact_index"))).alias("raw_fact"), _numbered("attributions", i).alias("a"), _numbered("profiles", i).alias("p"), _numbered("times", i).alias("t"),
    )
    subjects = F.array_distinct(F.transform(F.coalesce(F.col("a.subjects"), F.array()), _stripped))
    claim, status = _stripped(F.col("a.claim_type")), _stripped(F.coalesce(F.nullif(F.col("a.status"), F.lit("")), F.lit("verified")))
    signal = profile_signal(F.col("p.fact_type"), F.col("p.durability"), F.col("p.reason"))
    given = ~F.col("__summary")
    reason = (
        F.when(F.col("raw_fact") == "", "empty_fact")
        .when(given & ~F.coalesce((F.size(subjects) == 1) & (F.get(subjects, F.lit(0)) == F.col("actor_id")), F.lit(False)), "other_subject")
        .when(given & ~claim.isin(*OWN_CLAIMS), "claim_type").when(given & status.isin(*OPEN_ATTRIBUTIONS), "open_attribution")
        .when(given & (signal == "relationship_only"), "relationship_only").when(is_secret(F.col("raw_fact")), "secret")
    )
    told = lambda x: F.nullif(F.col(x), F.lit(0.0))
    return one.select(
        c.name_uuid(F.concat_ws("\x1f", F.coalesce("timeline_uid", F.lit("")), "revision", "fact_index", F.coalesce("actor_id", F.lit("")))).alias("source_uid"), "timeline_uid", "revision", "fact_index", "raw_fact", "actor_id",
        F.when(given, claim).otherwise("legacy_summary_candidate").alias("claim_type"),
        F.when(given, c.clamp(F.col("a.confidence"))).otherwise(max(0.0, min(0.69, summary_confidence))).alias("confidence"),
        F.when(given, signal).otherwise(REVIEW).alias("signal"),
        F.when(given, F.coalesce(told("t.start_s"), "create_s")).otherwise(F.col("create_s")).alias("started_s"),
        F.when(given, F.coalesce(told("t.end_s"), told("updated_s"), "create_s")).otherwise(F.coalesce(told("updated_s"), "create_s")).alias("ended_s"),
        c.clamp(F.col("importance"), default=0.5).alias("importance"), F.coalesce(F.nullif("evidence_basis", F.lit("")), F.lit("message_grounded")).alias("evidence_basis"), reason.alias("reason"),
    )

"""How well a memory rests on its messages: each fact's evidence, subjects and the use made of each message, checked against one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of claims, and what may become of a message.
CLAIMS = ("speaker_self", "speaker_reports_other", "speaker_requests_other", "direct_observation", "uncertain")
DISPOSITIONS = ("fact", "context", "omitted")
DURABLE = ("durable_fact", "durable_interaction")


def _rows(name: str) -> Column:
    return F.filter(F.coalesce(F.col(name), F.array()), lambda x: x.isNotNull())


def _count(rows: Column, holds: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(rows, lambda x: F.coalesce(holds(x), F.lit(False))))


def _clean(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def _refs(x: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), _clean), lambda r: r != ""))


def _within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _first(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Rows with a key, the first of each."""
    known = F.filter(rows, lambda x: key(x).isNotNull())
    keys = F.transform(known, key)
    return F.filter(known, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def grounding_issues(records: DataFrame) -> DataFrame:
    """(doc_id, code, field, severity, n): the broken rules of a record, with how often. Errors, but for uncertain attributions.

    records: doc_id, key_facts (texts), message_refs (of the sources), actor_refs (known actors), speakers (map of message to actor), and the arrays of structs evidence (fact_index text,
    message_refs), attributions (fact_index text, claim_type, confidence, subjects: array of actor_ref, name) and coverage (message_ref, disposition, reason_code, reason,
    fact_indexes). Arrays may be null or hold nulls. Of several rows for one fact or message the first is looked at, the others are duplicates. Everything is decided inside a record's row."""
    index = lambda x: F.trim(x["fact_index"]).try_cast("long")
    df = records.select(
        "doc_id", F.size(F.coalesce("key_facts", F.array())).alias("n"), _refs(F.col("message_refs")).alias("known"), _refs(F.col("actor_refs")).alias("actors"), "speakers",
        *[_rows(x).alias(x) for x in ("evidence", "attributions", "coverage")],
    )
    facts = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    df = df.withColumns({"facts": facts, "e": _first(F.col("evidence"), index), "a": _first(F.col("attributions"), index), "c": _first(F.col("coverage"), lambda x: _clean(x["message_ref"]))})
    known, facts = F.col("known"), F.col("facts")

    def numbered(rows: str, kept: str, name: str, whole: str) -> list[tuple]:
        seen = F.transform(F.col(kept), index)
        broken = _count(F.col(rows), lambda x: index(x).isNull())
        return [(f"invalid_{name}_index", broken), (f"duplicate_{name}", F.size(rows) - broken - F.size(kept)), (f"incomplete_{whole}", (~(_within(seen, facts) & _within(facts, seen))).cast("int"))]

    evidence = [*numbered("evidence", "e", "fact_evidence", "fact_evidence"), ("missing_fact_evidence", _count(F.col("e"), lambda x: F.size(_refs(x["message_refs"])) == 0)), ("unknown_fact_evidence", _count(F.col("e"), lambda x: ~_within(_refs(x["message_refs"]), known)))]

    def sides(x: Column) -> tuple[Column, Column, Column]:
        """Subjects of an attribution, those that are actors, and the speakers of the messages that its fact rests on."""
        named = F.array_distinct(F.transform(x["subjects"], lambda s: _clean(s["actor_ref"])))
        cited = F.flatten(F.transform(F.filter("e", lambda r: index(r) == index(x)), lambda r: _refs(r["message_refs"])))
        spoke = F.filter(F.transform(cited, lambda m: F.element_at("speakers", m)), lambda s: F.coalesce(s, F.lit("")) != "")
        return named, F.array_except(named, F.array(F.lit("unresolved"), F.lit("none"), F.lit(""))), spoke

    def own(x: Column) -> Column:
        _, stable, spoke = sides(x)
        return (F.size(stable) > 0) & _within(stable, spoke)

    claim = lambda x: _clean(x["claim_type"])
    has = lambda x, *refs: F.arrays_overlap(sides(x)[0], F.array(*map(F.lit, refs)))
    subjects = F.flatten(F.transform("a", lambda x: F.coalesce(x["subjects"], F.array())))
    told = lambda x: F.coalesce(F.size(x["subjects"]), F.lit(0)) > 0
    ref, name = (lambda s: _clean(s["actor_ref"])), (lambda s: _clean(s["name"]))
    attributions = [
        *numbered("attributions", "a", "fact_attribution", "fact_attributions"), ("invalid_fact_claim_type", _count(F.col("a"), lambda x: ~claim(x).isin(*CLAIMS))),
        ("invalid_fact_attribution_confidence", _count(F.col("a"), lambda x: ~F.coalesce(x["confidence"].between(0, 1), F.lit(False)))), ("missing_fact_subject", _count(F.col("a"), lambda x: ~told(x))),
        ("unresolved_fact_subject_without_name", _count(subjects, lambda s: (ref(s) == "unresolved") & (name(s) == ""))), ("non_actor_subject_has_name", _count(subjects, lambda s: (ref(s) == "none") & (name(s) != ""))),
        ("unknown_fact_subject", _count(subjects, lambda s: ~ref(s).isin("unresolved", "none") & ~F.array_contains("actors", ref(s)))),
        ("speaker_self_subject_mismatch", _count(F.col("a"), lambda x: told(x) & (claim(x) == "speaker_self") & (~own(x) | has(x, "unresolved")))),
        ("other_claim_subject_is_speaker", _count(F.col("a"), lambda x: told(x) & (claim(x) == "speaker_reports_other") & own(x))),
        ("speaker_request_subject_mismatch", _count(F.col("a"), lambda x: told(x) & (claim(x) == "speaker_requests_other") & (~own(x) | has(x, "unresolved", "none")))),
        ("uncertain_fact_attribution", _count(F.col("a"), lambda x: told(x) & (claim(x) == "uncertain"))),
    ]
    used = lambda x: F.coalesce(x["fact_indexes"], F.array().cast("array<long>"))
    as_fact = lambda x: F.coalesce(x["disposition"] == "fact", F.lit(False))
    lasting = lambda x: _clean(x["reason_code"]).isin(*DURABLE)
    covered = F.transform("c", lambda x: _clean(x["message_ref"]))
    coverage = [
        ("duplicate_message_coverage", F.size("coverage") - F.size("c")), ("invalid_message_disposition", _count(F.col("c"), lambda x: ~F.coalesce(x["disposition"].isin(*DISPOSITIONS), F.lit(False)))),
        ("unknown_coverage_fact", _count(F.col("c"), lambda x: ~_within(used(x), facts))), ("ungrounded_fact_disposition", _count(F.col("c"), lambda x: as_fact(x) & (F.size(used(x)) == 0))),
        ("fact_without_durable_reason", _count(F.col("c"), lambda x: as_fact(x) & ~lasting(x))), ("durable_reason_without_fact", _count(F.col("c"), lambda x: ~as_fact(x) & lasting(x))),
        ("missing_omission_reason", _count(F.col("c"), lambda x: (x["disposition"] == "omitted") & (F.length(_clean(x["reason"])) < 2))),
        ("incomplete_message_coverage", (~(_within(covered, known) & _within(known, covered))).cast("int")),
    ]
    rules = [(code, field, n) for field, codes in (("key_fact_evidence", evidence), ("key_fact_attributions", attributions), ("message_coverage", coverage)) for code, n in codes]
    found = F.filter(F.array(*[F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit("warning" if code == "uncertain_fact_attribution" else "error").alias("severity"), n.cast("long").alias("n")) for code, field, n in rules]), lambda x: x["n"] > 0)
    return df.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def grounding_report(records: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, status, n_messages, n_grounded, n_covered): normal without an issue, warning without an error, else repairable; facts whose first evidence is known, messages that are covered."""
    index = lambda x: F.trim(x["fact_index"]).try_cast("long")
    worst = issues.groupBy("doc_id").agg(F.bool_or(F.col("severity") == "error").alias("bad"))
    known = _refs(F.col("message_refs"))
    grounded = _count(_first(_rows("evidence"), index), lambda x: (F.size(_refs(x["message_refs"])) > 0) & _within(_refs(x["message_refs"]), known))
    covered = F.size(F.array_intersect(known, F.transform(_rows("coverage"), lambda x: _clean(x["message_ref"]))))
    df = records.select("doc_id", F.size(known).alias("n_messages"), grounded.alias("n_grounded"), covered.alias("n_covered")).join(worst, "doc_id", "left")
    return df.select("doc_id", F.when(F.col("bad"), "repairable").when(F.col("bad").isNotNull(), "warning").otherwise("normal").alias("status"), "n_messages", "n_grounded", "n_covered")

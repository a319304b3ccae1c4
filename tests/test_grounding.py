"""Grounding rules one by one, and random evidence against a plain version."""

import random

from lorekeep.operators import grounding

SCHEMA = """doc_id long, key_facts array<string>, message_refs array<string>, actor_refs array<string>, speakers map<string,string>, evidence array<struct<fact_index string, message_refs array<string>>>,
attributions array<struct<fact_index string, claim_type string, confidence double, subjects array<struct<actor_ref string, name string>>>>,
coverage array<struct<message_ref string, disposition string, reason_code string, reason string, fact_indexes array<long>>>"""
GOOD = dict(
    key_facts=["f0", "f1"], message_refs=["m1", "m2"], actor_refs=["A", "B"], speakers={"m1": "A", "m2": "B"}, evidence=[("0", ["m1"]), (" 1 ", [" m2", "m1"])],
    attributions=[("0", "speaker_self", 0.5, [("A", None)]), ("1", "direct_observation", 1.0, [("none", None)])], coverage=[("m1", "fact", "durable_fact", None, [0, 1]), ("m2", "omitted", "small_talk", "chat", [])],
)


def said(*rows):
    return {"attributions": [*rows, GOOD["attributions"][1]]}


def use(*rows):
    return {"coverage": [*rows, GOOD["coverage"][1]]}


CASES = [
    ({}, {}),
    ({"evidence": None}, {"incomplete_fact_evidence", "speaker_self_subject_mismatch"}),
    ({"evidence": [("0", ["m1"]), ("x", ["m1"]), ("1", ["m9"]), ("1", ["m1"])]}, {"invalid_fact_evidence_index", "duplicate_fact_evidence", "unknown_fact_evidence"}),
    ({"evidence": [("0", ["m1"]), ("1", [" ", None]), ("2", ["m1"]), None]}, {"missing_fact_evidence", "incomplete_fact_evidence"}),
    (said(("0", "speaker_self", 0.5, [("B", None)])), {"speaker_self_subject_mismatch"}),
    (said(("0", "speaker_self", 0.5, [("A", None), ("unresolved", "who")])), {"speaker_self_subject_mismatch"}),
    (said(("0", "speaker_reports_other", 0.5, [("A", None)])), {"other_claim_subject_is_speaker"}),
    (said(("0", "speaker_reports_other", 0.5, [("B", None)])), {}),
    (said(("0", "speaker_requests_other", 0.5, [("A", None), ("none", None)])), {"speaker_request_subject_mismatch"}),
    (said(("0", "uncertain", 0.5, [("unresolved", " ")])), {"uncertain_fact_attribution", "unresolved_fact_subject_without_name"}),
    (said(("0", "rumour", -0.1, [("none", "x"), ("C", None)])), {"invalid_fact_claim_type", "invalid_fact_attribution_confidence", "non_actor_subject_has_name", "unknown_fact_subject"}),
    (said(("0", "speaker_self", None, [])), {"invalid_fact_attribution_confidence", "missing_fact_subject"}),
    (said((None, "speaker_self", 0.5, [("A", None)]), ("1", "speaker_self", 0.5, [("B", "b")])), {"invalid_fact_attribution_index", "duplicate_fact_attribution", "incomplete_fact_attributions"}),
    (use(("m1", "fact", "small_talk", None, [])), {"ungrounded_fact_disposition", "fact_without_durable_reason"}),
    (use(("m1", "kept", "durable_interaction", None, [5])), {"invalid_message_disposition", "unknown_coverage_fact", "durable_reason_without_fact"}),
    (use(("m1", "omitted", "small_talk", " x ", None), ("m1", "fact", "durable_fact", None, [0])), {"missing_omission_reason", "duplicate_message_coverage"}),
    ({"coverage": [("m1", "fact", "durable_fact", None, [0])]}, {"incomplete_message_coverage"}),
    ({"key_facts": None, "message_refs": None, "evidence": None, "attributions": None, "coverage": None}, {}),
]


def frame(spark, records):
    return spark.createDataFrame([(i, *[{**GOOD, **r}[k] for k in ("key_facts", "message_refs", "actor_refs", "speakers", "evidence", "attributions", "coverage")]) for i, r in enumerate(records)], SCHEMA)


def test_rules(spark):
    records = frame(spark, [r for r, _ in CASES])
    issues = grounding.grounding_issues(records)
    got = {}
    for x in issues.collect():
        got.setdefault(x.doc_id, set()).add(x.code)
    assert {i: got.get(i, set()) for i in range(len(CASES))} == {i: set(want) for i, (_, want) in enumerate(CASES)}
    status = {x.doc_id: (x.status, x.n_messages, x.n_grounded, x.n_covered) for x in grounding.grounding_report(records, issues).collect()}
    assert status[0] == ("normal", 2, 2, 2) and status[2] == ("repairable", 2, 1, 2) and status[len(CASES) - 1] == ("normal", 0, 0, 0)


def test_random_evidence(spark):
    r = random.Random(3)
    records = [{"key_facts": ["f"] * r.randrange(4), "evidence": [None if r.random() < 0.1 else (r.choice(["0", "1", "2", "x", None]), [r.choice(["m1", "m2", "m3", " ", None]) for _ in range(r.randrange(3))]) for _ in range(r.randrange(5))]} for _ in range(300)]
    got = {(x.doc_id, x.code): x.n for x in grounding.grounding_issues(frame(spark, records)).where("field = 'key_fact_evidence'").collect()}
    want = {}
    for i, rec in enumerate(records):
        seen = {}
        for row in rec["evidence"]:
            if row is None:
                continue
            refs = {x.strip() for x in row[1] if x and x.strip()}
            k = row[0]
            code = "invalid_fact_evidence_index" if k in ("x", None) else "duplicate_fact_evidence" if k in seen else "missing_fact_evidence" if not refs else "unknown_fact_evidence" if not refs <= {"m1", "m2"} else None
            if k not in ("x", None):
                seen[k] = 1
            if code:
                want[i, code] = want.get((i, code), 0) + 1
        if set(seen) != {str(k) for k in range(len(rec["key_facts"]))}:
            want[i, "incomplete_fact_evidence"] = 1
    assert got == want

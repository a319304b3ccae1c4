"""Facts as sources: UUIDs, the signal table, and random memories against a plain version."""

import random
import re
import uuid

from pyspark.sql import functions as F

from lorekeep.functions import columns as c
from lorekeep.operators import fact_sources as sources

SCHEMA = """timeline_uid string, revision long, actor_id string, create_s double, updated_s double, importance double, evidence_basis string, facts array<string>,
attributions array<struct<fact_index long, subjects array<string>, claim_type string, status string, confidence double>>,
profiles array<struct<fact_index long, fact_type string, durability string, reason string>>, times array<struct<fact_index long, start_s double, end_s double>>"""


def test_name_uuid(spark):
    names = ["", "a", "t1\x1f1\x1f0\x1fu7", "日本\x1fé"] + [str(i) for i in range(50)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", c.name_uuid(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in got)


def test_signals(spark):
    cases = [("affect", "", "", "relationship_only"), ("plan", "", "relationship_significance", "relationship_only"), ("preference", "", "stable_personal_fact", "profile_direct"), ("preference", "high", "repeated_completed_action", "behavior_evidence"),
             (" plan ", "high", "", "profile_direct"), ("plan", "low", "", "model_review"), ("plan", "low", "future_utility", "profile_direct"), ("state", "low", "commitment_or_decision", "behavior_evidence"),
             ("state", "high", "repeated_completed_action", "profile_direct"), ("event", "", "repeated_completed_action", "behavior_pattern"), (None, None, "completed_action", "behavior_evidence"), (None, None, None, "model_review")]
    got = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(cases)], "i long, t string, d string, r string").select("i", sources.profile_signal(F.col("t"), F.col("d"), F.col("r")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: x[3] for i, x in enumerate(cases)}


def test_secrets(spark):
    yes = ["my Password is x", "我的 密码 是", "密码", "123456 is the OTP", "sk-" + "a" * 16, "-----BEGIN PRIVATE KEY-----", "api_key"]
    no = ["passwords", "密码学", "12345 otp", "sk-short", "1234567 otp", ""]
    got = spark.createDataFrame([(x,) for x in yes + no], "t string").select("t", sources.is_secret(F.col("t")).alias("s")).collect()
    assert {r.t for r in got if r.s} == set(yes)


def plainly(m):
    """{fact_index: (reason, claim_type, started, ended)} of a memory, fact by fact."""
    last = lambda rows: {(r[0] if r[0] is not None else n): r for n, r in enumerate(rows or []) if r is not None}
    said, held, when = last(m[8]), last(m[9]), last(m[10])
    out = {}
    for i, fact in enumerate(m[7] or []):
        text = (fact or "").strip()
        secret = re.search(r"\bpassword\b", text)
        if m[6] == "timeline_summary_only" and not said:
            out[i] = ("empty_fact" if not text else "secret" if secret else None, "legacy_summary_candidate", m[3], m[4] or m[3])
            continue
        _, subjects, claim, status, _ = said.get(i, (None, [], None, None, None))
        kind = held[i][1] if i in held else None
        t = when.get(i, (None, None, None))
        rules = [("empty_fact", not text), ("other_subject", {(x or "").strip() for x in subjects or []} != {m[2]}), ("claim_type", claim != "speaker_self"), ("open_attribution", status == "uncertain"), ("relationship_only", kind == "affect"), ("secret", secret)]
        out[i] = (next((name for name, broken in rules if broken), None), claim or "", t[1] or m[3], t[2] or m[4] or m[3])
    return out


def test_random_memories(spark):
    r = random.Random(5)
    some = lambda make: None if r.random() < 0.15 else [None if r.random() < 0.15 else make() for _ in range(r.randrange(5))]
    index = lambda: r.choice([None, None, 0, 1, 2, 9])
    rows = []
    for k in range(200):
        facts = None if k % 20 == 19 else [r.choice(["", "  ", None, " likes tea ", "password: x", "walks"]) for _ in range(r.randrange(5))]
        rows.append((f"t{k}", r.choice([None, 0, 1, 4]), "u1", 100.0, r.choice([None, 0.0, 300.0]), None, r.choice([None, "timeline_summary_only"]), facts,
                     some(lambda: (index(), r.choice([[], ["u1"], ["u1 ", "u1"], ["u1", "u2"], ["u2"], None]), r.choice(["speaker_self", "speaker_self", "hearsay", None]), r.choice([None, "", "verified", "uncertain"]), r.choice([None, -1.0, 0.5, 7.0]))),
                     some(lambda: (index(), r.choice([None, "affect", "event"]), None, None)), some(lambda: (index(), r.choice([None, 0.0, 50.0]), r.choice([None, 80.0])))))
    got = sources.fact_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {(m[0], i): v for m in rows for i, v in plainly(m).items()}
    assert {(x.timeline_uid, x.fact_index): (x.reason, x.claim_type, x.started_s, x.ended_s) for x in got} == want and len(got) == len(want)
    assert {x.reason for x in got} == {None, "empty_fact", "other_subject", "claim_type", "open_attribution", "relationship_only", "secret"}
    assert all(0 <= x.confidence <= 1 and x.revision >= 1 for x in got)


def test_nothing_in_nothing_out(spark):
    assert sources.fact_sources(spark.createDataFrame([], SCHEMA)).count() == 0

"""Repeated contexts against plain loops, and texts that a spreadsheet would take for formulas."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import columns as c
from lorekeep.operators import profiles

EVIDENCE = "profile string, ref long, timeline long, term string, minute int, at_s double"


def plainly(evidence, clusters, minutes, min_timelines, min_days, most):
    out = []
    for profile in sorted({e[0] for e in evidence}):
        own = [e for e in evidence if e[0] == profile]
        held = {}
        for p, k, ref in clusters:
            if p == profile:
                held.setdefault(k, set()).add(ref)
        df = {t: len({e[1] for e in own if e[3] == t}) for t in {e[3] for e in own}}
        found = {}
        for term, n in df.items():
            if not min_timelines <= n < max(3.0, 0.9 * len({e[1] for e in own})):
                continue
            timed = [e for e in own if e[3] == term and e[4] is not None]
            for seed in timed:
                nearest = {}
                for e in timed:
                    gap = abs(e[4] - seed[4])
                    gap = min(gap, 1440 - gap)
                    if gap <= minutes:
                        nearest[e[2]] = min(nearest.get(e[2], (9999, 0, 0)), (gap, e[1], e[5]))
                refs = tuple(sorted(x[1] for x in nearest.values()))
                at = [x[2] for x in nearest.values()]
                days = (max(at) - min(at)) / 86400
                if len(refs) < min_timelines or days + 1e-9 < min_days or any(set(refs) <= h for h in held.values()):
                    continue
                found[refs] = min(found.get(refs, (9999, "")), (n, term))
                found[refs, "days"] = days
        sets = sorted((-len(r), -found[r, "days"], *found[r], r) for r in found if r[-1] != "days")
        out += [(profile, s[3], s[4], i + 1) for i, s in enumerate(sets[:most])]
    return out


@pytest.mark.parametrize("seed,minutes", [(1, 120), (2, 45), (3, 700), (4, 1440), (5, 7)])
def test_context_candidates(spark, seed, minutes):
    r = random.Random(seed)
    evidence = [(p, ref, r.randrange(25), t, minute, float(r.randrange(12)) * 86400 / 2) for p in ("a", "b") for ref in range(40) for minute in [r.choice([None, 0, 5, 1435, 719, 720, r.randrange(1440)])] for t in r.sample(["x", "y", "z", "all"], 2)]
    at = {}
    evidence = [(*e[:2], *at.setdefault(e[:2], (e[2], e[4], e[5]))[:1], e[3], *at[e[:2]][1:]) for e in evidence]
    clusters = [("a", "c", ref) for ref in range(0, 40) if r.random() < 0.8] + [("b", "d", 1), ("b", "d", 1)]
    got = profiles.context_candidates(spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(clusters, "profile string, cluster string, ref long"), minutes, 3, 1.0).orderBy("profile", "rank").collect()
    want = plainly(evidence, clusters, minutes, 3, 1.0, 4)
    assert want and [(x.profile, x.term, tuple(x.refs), x["rank"]) for x in got] == want


def test_formulas(spark):
    texts = {"=1": "'=1", "+1": "'+1", "-1": "'-1", "@a": "'@a", "\tx": "'\tx", "\rx": "'\rx", " =1": " =1", "a=1": "a=1", "": ""}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.csv_safe(F.col("t")).alias("s")).collect()
    assert {x.t: x.s for x in got} == texts


def test_context_candidates_of_one_minute(spark):
    """20,000 timelines in one minute are 400 million pairs of evidence and as many refs, but one set."""
    evidence = spark.range(20000).selectExpr("'p' as profile", "id as ref", "id as timeline", "'x' as term", "600 as minute", "id * 100.0D as at_s").unionByName(spark.range(20000, 40000).selectExpr("'p' as profile", "id as ref", "id as timeline", "'y' as term", "cast(null as int) as minute", "0.0D as at_s"))
    held = spark.createDataFrame([("p", "c", 1)], "profile string, cluster string, ref long")
    df = profiles.context_candidates(evidence, held)
    got = df.collect()
    assert [(r["term"], len(r["refs"]), r["refs"][:3], r["n"], r["rank"]) for r in got] == [("x", 20000, [0, 1, 2], 20000, 1)]

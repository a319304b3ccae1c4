"""The composed recall: each reason, the order of the steps, and the choice against a plain computation; scopes and sizes of the routes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import retrieval, timeline_recall

REQUEST = "query_id long, session_id string, visible_lo long, visible_hi long, time_lo double, time_hi double, time_order string"
MEMORY = "doc_id long, session_id string, source_lo long, source_hi long, event_lo double, event_hi double, features array<string>"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def plain(candidates, request, memories, k, minimum=0.38, relative=0.65, share=0.72):
    """The ledger of one query, step by step."""
    out, left = {}, []
    for doc, fused, relevance in sorted(candidates, key=lambda x: (-x[1], x[0])):
        m = memories.get(doc, (None,) * 6)
        lo, hi = (m[3] if m[3] is not None else m[4]), (m[4] if m[4] is not None else m[3])
        if request[5] and lo is None:
            out[doc] = "temporal_anchor_unavailable"
        elif request[5] and not (min(lo, hi) <= (math.inf if request[4] is None else request[4]) and max(lo, hi) >= (-math.inf if request[3] is None else request[3])):
            out[doc] = "outside_temporal_range"
        elif None not in (request[0], request[1], request[2], m[0], m[1], m[2]) and m[0] == request[0] and m[1] < request[2] and m[2] > request[1] and request[2] > request[1]:
            out[doc] = "current_context_overlap"
        else:
            left.append((doc, fused, relevance, lo, hi))
    best, timed = max((x[2] for x in left), default=0), request[5] in ("earliest", "latest")
    fit = []
    for x in left:
        if x[2] < minimum:
            out[x[0]] = "below_min_relevance"
        elif not timed and x[2] < round(best * relative, 9):
            out[x[0]] = "below_relative_floor"
        else:
            fit.append(x)
    chosen = []
    if timed:
        chosen = [x[0] for x in sorted(fit, key=lambda x: (-x[4] if request[5] == "latest" else x[3], -x[2], x[0]))[:k]]
    else:
        rest = list(fit)
        while rest and len(chosen) < k:
            value = lambda x: round(share * x[1] - (1 - share) * max((jaccard(memories[x[0]][5], memories[d][5]) for d in chosen), default=0), 9)
            top = max(rest, key=lambda x: (value(x), x[1], -x[0]))
            chosen.append(top[0])
            rest.remove(top)
    for x in fit:
        out[x[0]] = None if x[0] in chosen else "diversity_or_result_limit"
    return {d: (chosen.index(d) + 1 if d in chosen else None, r) for d, r in out.items()}


def test_ledger_equals_a_plain_computation(spark):
    rng = random.Random(5)
    maybe = lambda x: None if rng.random() < 0.2 else x
    memories = {d: (maybe(rng.choice("st")), maybe(a := rng.randrange(50)), maybe(a + rng.randrange(9)), maybe(b := float(rng.randrange(100))), maybe(b + rng.randrange(-5, 20)), set(rng.sample("abcdefg", rng.randrange(0, 5)))) for d in range(60)}
    requests, candidates = {}, {}
    for q in range(24):
        order = (None, "relevance", "earliest", "latest")[q % 4]
        lo = maybe(float(rng.randrange(80))) if order else None
        requests[q] = (maybe("s"), maybe(v := rng.randrange(40)), maybe(v + rng.randrange(-2, 20)), lo, maybe((lo or 0) + 30.0) if order else None, order)
        candidates[q] = [(d, round(rng.random(), 2), round(rng.random(), 2)) for d in rng.sample(range(60), 40 if q else 0)]
    df = timeline_recall.ledger(
        spark.createDataFrame([(q, *c) for q, cs in candidates.items() for c in cs], "query_id long, doc_id long, fused double, relevance double"),
        spark.createDataFrame([(q, *r) for q, r in requests.items()], REQUEST),
        spark.createDataFrame([(d, *m[:5], sorted(m[5])) for d, m in memories.items()], MEMORY),
        5,
    )
    rows = df.collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["doc_id"]] = (r["place"], r["filter_reason"])
        assert r["selected"] == (r["place"] is not None) == (r["filter_reason"] is None)
    assert len(rows) == sum(map(len, candidates.values()))
    for q, cs in candidates.items():
        assert got.get(q, {}) == plain(cs, requests[q], memories, 5), q
    assert {r["filter_reason"] for r in rows} == {None, "temporal_anchor_unavailable", "outside_temporal_range", "current_context_overlap", "below_min_relevance", "below_relative_floor", "diversity_or_result_limit"}


def test_candidates_without_a_memory_row_stay(spark):
    c = spark.createDataFrame([(1, 7, 0.9, 0.9), (2, 7, 0.9, 0.9)], "query_id long, doc_id long, fused double, relevance double")
    r = spark.createDataFrame([(1, None, None, None, None, None, None), (2, None, None, None, None, None, "latest")], REQUEST)
    got = {x["query_id"]: x["filter_reason"] for x in timeline_recall.ledger(c, r, spark.createDataFrame([], MEMORY), 3).collect()}
    assert got == {1: None, 2: "temporal_anchor_unavailable"}


def test_fusion_and_relevance(spark):
    hits = spark.createDataFrame([(1, "current", 1.0, 5, 0.5, 0.4), (1, "recent_user", 0.45, 5, 0.6, 0.2), (1, "current", 1.0, 6, 1.4, 0.1)], "query_id long, branch string, weight double, doc_id long, score double, relevance double")
    got = {r["doc_id"]: (r["fused"], r["relevance"], r["n_branches"]) for r in timeline_recall.fuse(hits).collect()}
    assert got[5] == (pytest.approx(1 - 0.5 * (1 - 0.27) + 0.03), pytest.approx(1 - 0.6 * 0.91), 2) and got[6] == (1.0, 0.1, 1)
    df = spark.createDataFrame([(0.7, 0.3, 0.9), (0.7, None, None), (0.7, float("nan"), 0.2)], "s double, v double, k double")
    got = [r[0] for r in df.select(timeline_recall.hit_relevance(F.col("s"), [F.col("v")], [F.col("k")])).collect()]
    assert got == [pytest.approx(0.495), 0.7, pytest.approx(0.11)]


@pytest.mark.parametrize("sent", [0, 10**6])
def test_routes_hold_scope_before_the_cut(spark, sent):
    rng = random.Random(2)
    docs = [(d, "pq"[d % 2], [rng.choice("abcde") * 2 for _ in range(rng.randrange(1, 9))], [rng.random() - 0.5 for _ in range(4)]) for d in range(60)]
    queries = [(1, None, ["aa", "bb", "zz"], [1.0, 0.2, 0.0, -0.4]), (2, "p", ["aa", "bb"], [0.1, 0.9, 0.3, 0.0]), (3, "q", ["cc", "cc"], [0.0, 0.0, 0.0, 0.0])]
    d = spark.createDataFrame(docs, "doc_id long, scope string, tokens array<string>, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, scope string, tokens array<string>, embedding array<double>")
    words = retrieval.bm25(d, q, 5, scope=("scope",), normalise=False, sent_terms=sent)
    near = retrieval.vector_top_k(d, q, 5, scope=("scope",), sent_numbers=sent)
    got = {n: {(r["query_id"], r["doc_id"]): r["score"] for r in x.collect()} for n, x in (("w", words), ("v", near))}
    average = sum(len(t) for *_, t, _ in docs) / len(docs)
    for query, scope, tokens, vector in queries:
        w, v = {}, {}
        for doc, own, text, x in docs:
            if scope and own != scope:
                continue
            v[doc] = round(sum(a * b for a, b in zip(vector, x)) / max(1e-30, math.dist(x, [0] * 4) * math.dist(vector, [0] * 4)), 9)
            for t in set(tokens) & set(text):
                df = sum(t in y for *_, y, _ in docs)
                tf = text.count(t)
                w[doc] = w.get(doc, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(text) / average))
        for name, scores in (("w", w), ("v", v)):
            want = sorted(scores, key=lambda k: (-round(scores[k], 9), k))[:5]
            assert [k for (n, k) in sorted(got[name], key=lambda x: (x[0], -got[name][x], x[1])) if n == query] == want, (name, query)

"""Keyword scores of many queries, summed where a document's hits lie."""

import math
import re

from lorekeep.operators import retrieval


def test_scores_are_summed_by_document_without_a_shuffle_of_pairs(spark):
    docs = [(i, [f"w{(i * k) % 11}" for k in range(1, 8)]) for i in range(60)] + [(None, ["w1"]), (90, [])]
    queries = [(f"q{q}", [f"w{q % 11}", f"w{(q + 3) % 11}", "absent"]) for q in range(30)]
    out = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), spark.createDataFrame(queries, "query_id string, tokens array<string>"), 5, normalise=False)
    average, n = sum(len(t) for _, t in docs) / len(docs), len(docs)
    often = {w: sum(w in t for _, t in docs) for w in {w for _, t in docs for w in t}}
    for q, terms in queries:
        scores = {}
        for d, t in docs:
            for w in set(terms) & set(t):
                tf = t.count(w)
                scores[d] = scores.get(d, 0) + math.log(1 + (n - often[w] + 0.5) / (often[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), -1 if x[0] is None else x[0]))[:5]
        assert [(r["doc_id"], round(r["score"], 6)) for r in out.where(out["query_id"] == q).orderBy("rank").collect()] == [(d, round(s, 6)) for d, s in best]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan) and re.search(r"hashpartitioning\(doc_id", plan)

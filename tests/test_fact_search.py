"""Containment by rarest substrings against a plain scan, and the two ways of finding facts."""

import random

from lorekeep.operators import fact_search


def test_containing_equals_a_scan(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abAB%_é漢 \n") for _ in range(n))
    facts = [(i, word(rng.randrange(0, 40)) if i % 11 else None, "pq"[i % 2]) for i in range(120)] + [(500, "long " * 30_000 + "needle", "p")]
    queries = [(q, [word(rng.randrange(0, 5)) for _ in range(rng.randrange(0, 4))], [None, "p", "z"][q % 3]) for q in range(40)] + [(90, ["NEEDLE"], None)]
    f = spark.createDataFrame(facts, "doc_id long, content string, scope string")
    q = spark.createDataFrame(queries, "query_id long, parts array<string>, scope string")
    got = sorted(map(tuple, fact_search.containing(f, q, ("scope",)).collect()))
    assert got == sorted((n, d) for n, parts, own in queries for d, text, scope in facts if (own is None or own == scope) and any(p and p.lower() in (text or "").lower() for p in parts))


def test_containment_only_where_keywords_find_none(spark):
    facts = spark.createDataFrame([(1, "green tea", ["green", "tea"], 0.5), (2, "greenish", ["greenish"], 0.9), (3, "steam", ["steam"], 0.2), (4, "team", ["team"], 0.4)], "doc_id long, content string, tokens array<string>, temporal double")
    queries = spark.createDataFrame([(1, ["green"], ["green"]), (2, ["eam"], ["eam"]), (3, ["zz"], ["zz"])], "query_id long, tokens array<string>, parts array<string>")
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"], r["found_by"]) for r in fact_search.fact_search(facts, queries, 2).collect())
    assert got == [(1, 1, 1, 0.5, "keywords"), (2, 1, 4, 0.4, "containment"), (2, 2, 3, 0.2, "containment")]
    assert fact_search.fact_search(facts.limit(0), queries, 2).count() == 0


def test_containment_keeps_the_newest_of_each_query_and_looks_a_part_up_once(spark):
    texts = [("anna met bea", "x"), ("bea left", "y"), ("BEA again", "x"), ("nothing", "x"), (None, "y"), ("a bea and more", None)]
    facts = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts * 4)], "doc_id long, content string, scope string")
    queries = spark.createDataFrame([(1, ["bea"], None), (2, ["bea", "noth"], "x"), (3, ["EA", "zz"], "y"), (4, [""], None)], "query_id long, parts array<string>, scope string")
    want = {(q, i) for q, parts, s in map(tuple, queries.collect()) for i, (t, own) in enumerate(texts * 4) if t and (s is None or s == own) and any(p and p.lower() in t.lower() for p in parts)}
    assert {tuple(r) for r in fact_search.containing(facts, queries, ("scope",)).collect()} == want
    for k in (1, 3):
        got = {tuple(r) for r in fact_search.containing(facts, queries, ("scope",), k).collect()}
        assert got <= want and all(sorted(d for x, d in got if x == q)[-k:] == sorted(d for x, d in want if x == q)[-k:] for q in (1, 2, 3))
    assert fact_search.containing(facts, spark.createDataFrame([(q, ["bea"], None) for q in range(9)], queries.schema), ("scope",), 1).count() <= 9 * 3

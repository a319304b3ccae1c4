"""Operators that SQL cannot express, against plain restatements and invariants on small inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import columns as c
from lorekeep.operators import graph, lifecycle, profiles, retrieval, sessions, tables, topics
from lorekeep.sources import transfer


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).collect()[0]["x"]


def test_tokenize(spark):
    text = "See https://a.b/c @you #tag Hello, hello a 我们 OK!"
    assert one(spark, c.tokenize(F.col("t")), t=text) == ["See", "Hello", "hello", "我", "们", "OK"]
    assert one(spark, c.tokenize(F.col("t"), ["hello"]), t="hello there") == ["there"]


def test_features_and_similarity(spark):
    assert sorted(one(spark, c.retrieval_features(F.col("t")), t="Ab ab 图书馆 x")) == ["ab", "书馆", "图书"]
    assert one(spark, c.retrieval_features(F.col("t")), t="!") == ["<empty>"]
    assert one(spark, c.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, c.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_spans(spark):
    f = lambda s, e: one(spark, c.overlaps(F.lit(s).cast("double"), F.lit(e).cast("double"), F.lit(5.0), F.lit(9.0)))
    assert [f(1, 4), f(1, 5), f(10, 7), f(None, 6), f(None, None)] == [False, True, True, True, False]


def test_platforms(spark):
    assert one(spark, c.canonical_platform(F.col("t")), t="AioCQHTTP-2") == "qq"
    assert one(spark, c.canonical_platform(F.col("t")), t="WeChat") == "wechat"
    assert [one(spark, c.canonical_platform(F.col("t")), t=x) for x in ("Lark", "ding_talk", "my-wechat work", "other", "")] == ["feishu", "dingtalk", "wecom", "other", ""]
    assert one(spark, c.csv_safe(F.col("t")), t="=1+1") == "'=1+1"


def test_mmr(spark):
    data = [(1, i, s, f) for i, s, f in [(1, 1.0, ["a", "b"]), (2, 0.95, ["a", "b"]), (3, 0.7, ["c"]), (4, 0.1, ["d"])]]
    df = spark.createDataFrame(data, "query_id long, doc_id long, score double, features array<string>")
    assert [x[1] for x in rows(retrieval.mmr(df, 2, 0.5), "position", "doc_id")] == [1, 3]
    assert [x[1] for x in rows(retrieval.mmr(df.where("doc_id < 3"), 2, 0.5), "position", "doc_id")] == [1, 2]


def test_graph_fold(spark):
    hit = lambda s: spark.createDataFrame([(1, 7, s)], "query_id long, doc_id long, score double")
    out = graph.keyword_route(hit(0.5), hit(0.9), hit(0.2), hit(1.0), 5).collect()[0]["score"]
    # 0.5, then 0.63 replaces it, then 0.35 * 0.14 and 0.35 * 0.4 are added
    assert out == pytest.approx(0.63 + 0.35 * 0.14 + 0.35 * 0.4)


def test_aliases(spark):
    chain = [(i, i - 1) for i in range(1, 16)] + [(101, 102), (102, 101)] + [(200 + i, 199 + i) for i in range(1, 20)]
    out = dict(rows(sessions.resolve_aliases(spark.createDataFrame(chain, "alias_id long, canonical_id long")), "alias_id", "canonical_id"))
    assert all(out[i] == 0 for i in range(1, 16))
    assert out[101] == 101 and out[102] == 102 and out[218] == 218 and out[210] == 200


def test_continuation(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    units = spark.createDataFrame([("s", i, a if i < 4 else b) for i in range(7)], "session_id string, unit long, embedding array<double>")
    out = rows(sessions.continuation_cuts(units, 2, 5, 0.5), "first_unit", "last_unit", "reason")
    assert out == [(0, 3, "topic_changed"), (4, 6, "open")]
    assert rows(sessions.provisional_topics(units), "n_topics") == [(2,)]


def test_range_join_small_buckets(spark):
    rng = random.Random(1)
    items = [(i, float(s := rng.randint(0, 500)), float(s + rng.randint(0, 80))) for i in range(60)]
    ranges = [(i, float(s := rng.randint(0, 500)), float(s + rng.randint(0, 80))) for i in range(20)]
    out = sessions.range_overlap_join(spark.createDataFrame(items, "item_id long, s double, e double"), spark.createDataFrame(ranges, "range_id long, lo double, hi double"), 25)
    assert rows(out, "item_id", "range_id") == sorted((i, r) for i, s, e in items for r, lo, hi in ranges if s <= hi and e >= lo)


def test_bounded_edges_equal_the_greedy(spark):
    rng = random.Random(5)
    edges = [(a, b, round(rng.random(), 3)) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.5]
    degree: dict[int, int] = {}
    left, want = list(edges), set()
    while True:
        live = [(s + 0.1 * ((degree.get(a, 0) == 0) + (degree.get(b, 0) == 0)), a, b) for a, b, s in left if degree.get(a, 0) < 3 and degree.get(b, 0) < 3 and (a, b) not in want]
        if not live:
            break
        _, a, b = min((round(-v, 9), a, b) for v, a, b in live)
        want.add((a, b))
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    out = topics.bounded_edges(spark.createDataFrame(edges, "a long, b long, score double"), 3)
    assert set(rows(out, "a", "b")) == want


def test_agglomeration_needs_coherence(spark):
    scores = spark.createDataFrame([("s", 1, 2, 0.9), ("s", 2, 3, 0.8), ("s", 1, 3, 0.1), ("s", 4, 5, 0.9)], "space string, a long, b long, score double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "uid long")
    out, large = topics.agglomerate(scores, topics.seed_edges(scores), nodes)
    assert rows(out, "uid", "cluster") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)]
    assert large.isEmpty()


def test_lsh_finds_close_pairs(spark):
    rng = random.Random(2)
    vectors = [("s", i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(60)]
    vectors += [("s", 100 + i, [x + rng.gauss(0, 0.02) for x in v]) for _, i, v in vectors[:30]]
    items = spark.createDataFrame(vectors, "space string, uid long, embedding array<double>")
    exact = {x[:2] for x in rows(topics.vector_pairs(items, 0.9), "a", "b")}
    near = {x[:2] for x in rows(topics.lsh_pairs(items, 0.9), "a", "b")}
    assert near <= exact and len(near) >= 0.95 * len(exact)


def test_claims(spark):
    data = [("p", 1, "Likes green tea a lot", 1.0), ("p", 2, "likes green tea a lot!", 2.0), ("p", 3, "green tea a lot", 3.0), ("p", 4, "tea", 4.0)]
    out = rows(profiles.collapse_claims(spark.createDataFrame(data, "profile string, claim_id long, text string, at_s double")), "claim_id", "representative")
    assert out == [(1, 2), (2, 2), (3, 2), (4, 4)]


def test_reinforcement_folds_in_order(spark):
    atoms = spark.createDataFrame([(1, "factual", 0.5, 0.5, 0)], "atom_id long, kind string, importance double, confidence double, reinforcement_count int")
    hits = spark.createDataFrame([(1, 2, 0.0), (1, 1, 1.0)], "atom_id long, new_id long, confidence double")
    r = lifecycle.reinforce(atoms, hits, 0.0).collect()[0]
    assert r["confidence"] == pytest.approx((0.5 * 0.7 + 0.3) * 0.7) and r["reinforcement_count"] == 2
    assert r["ttl_days"] == pytest.approx(180 * 1.0 * 1.2)


def test_budget(spark):
    data = [("p", i, "x" * n, i == 3, 1.0 / i) for i, n in ((1, 50), (2, 80), (3, 30), (4, 10))]
    r = profiles.budget_facts(spark.createDataFrame(data, "profile string, fact_uid long, content string, pinned boolean, importance double"), 100).collect()[0]
    assert r["fact_uids"] == [3, 1, 4] and r["used"] == 90


def test_import_and_export(spark, tmp_path):
    (tmp_path / "in.json").write_text('[{"id": "1", "memory": "a", "score": "7"}, {"id": "2"}, {"id": "3", "history": [{"role": "ai", "content": "x"}, {"role": "me", "content": "y"}]}]')
    good, bad = transfer.normalise(transfer.read_import(spark, str(tmp_path / "in.json")))
    assert rows(good, "original_id", "importance") == [("1", 0.7), ("3", 0.5)] and rows(bad, "original_id") == [("2",)]
    assert [m["role"] for m in good.where("original_id = '3'").collect()[0]["source_messages"]] == ["assistant", "user"]
    transfer.write_export(good.select("original_id", "text"), str(tmp_path / "out"), "csv")
    assert transfer.read_import(spark, str(tmp_path / "out"), "csv").count() == 2


def test_upsert_and_folds(spark):
    schema = "k long, v string, version long, created long"
    out = tables.upsert(spark.createDataFrame([(1, "a", 1, 10)], schema), spark.createDataFrame([(1, "b", 2, 20), (2, "c", 1, 5)], schema), ["k"], "version", "created")
    assert rows(out, "k", "v", "created") == [(1, "b", 10), (2, "c", 5)]


def test_no_all_pairs_plans(spark):
    items = spark.createDataFrame([("s", 1, "x"), ("s", 2, "x")], "space string, uid long, item string")
    plan = topics.shared_items(items, ["space"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _swapped(chosen, eligible, degree=3):
    """orphan_swaps over all edges at once, one by one."""
    on = {(a, b): s for a, b, s in chosen}
    deg = Counter(u for e in on for u in e)
    for a, b, s in sorted(eligible, key=lambda e: (-e[2], e[0], e[1])):
        if (a, b) in on or (deg[a] and deg[b]):
            continue
        other = b if not deg[a] else a
        if deg[other] >= degree:
            loose = sorted((x, e) for e, x in on.items() if other in e and deg[e[0] if e[1] == other else e[1]] > 1)
            if not loose:
                continue
            del on[loose[0][1]]
            deg.subtract(loose[0][1])
        on[a, b] = s
        deg.update((a, b))
    return {(a, b, s) for (a, b), s in on.items()}


def test_orphan_swaps_keep_large_components(spark):
    rng = random.Random(8)
    schema = "a long, b long, score double"
    # a chain of more than 5,000 nodes keeps all its edges, and a hub's weakest edge makes way for a node without one
    chain = [(i, i + 1, 0.5) for i in range(10, 5020)]
    pairs = sorted({tuple(sorted(rng.sample(range(10000, 10040), 2))) for _ in range(150)})
    dense = [(a, b, round(rng.random(), 6)) for a, b in pairs]
    deg, chosen = Counter(), []
    for a, b, s in dense[::3]:
        if deg[a] < 3 and deg[b] < 3:
            chosen.append((a, b, s))
            deg.update((a, b))
    nodes = sorted({u for a, b, _ in chain + dense for u in (a, b)})
    got = topics.orphan_swaps(spark.createDataFrame(chain + chosen, schema), spark.createDataFrame(chain + dense + [(5, 6000, 0.9)], schema), spark.createDataFrame([(u,) for u in [5, 6000, *nodes]], "uid long"), 3)
    got = [tuple(r) for r in got.select("a", "b", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == _swapped(chain + chosen, chain + dense + [(5, 6000, 0.9)]) and set(chain) <= set(got)


def test_clusters_hold_every_node(spark):
    scores = spark.createDataFrame([("s", i, i + 1, 0.9) for i in range(8)] + [("s", 20, 21, 0.9)], "space string, a long, b long, score double")
    nodes = spark.createDataFrame([(i,) for i in [*range(9), 20, 21, 30]], "uid long")
    got = {r["uid"]: (r["cluster"], r["unmerged"]) for r in topics.clusters_of_all(scores, scores, nodes, most=5).collect()}
    assert got == {**{i: (i, True) for i in range(9)}, 20: (20, False), 21: (20, False), 30: (30, False)}


def test_range_join_of_one_day(spark):
    """200,000 short spans of one day on each side: 40,000,000,000 pairs in its one bucket, of which two or three a span meet."""
    times = spark.range(200_000).selectExpr("id", "id * 0.4D as s", "id * 0.4D + 0.5D as e")
    out = sessions.range_overlap_join(times.withColumnRenamed("id", "item_id"), times.selectExpr("id as range_id", "s as lo", "e as hi"))
    assert out.selectExpr("count(*) as n", "min(range_id - item_id) as a", "max(range_id - item_id) as b").first() == (599_998, -1, 1)

"""Blocks of vectors against plain loops: several blocks of a space, odd rows, labels, nearest ones."""

import numpy as np

from lorekeep.operators import retrieval, topics, vector_blocks


def _items(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], rng.normal(size=5).tolist(), i % 3 if i % 5 else None) for i in range(60)]
    rows += [(70, "a", rows[0][2], 0), (71, "a", [0.0] * 5, 1), (72, "a", None, 1), (73, None, rows[0][2], 1), (74, "b", [1.0, 2.0], 1), (75, "b", [2.0, 4.0], 1)]
    return rows, spark.createDataFrame(rows, "uid long, space string, embedding array<double>, label int").repartition(3)


def _pairs(rows, floor):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    good = [r for r in rows if r[1] and r[2]]
    return {(x[1], x[0], y[0]): (round(float(unit(x[2]) @ unit(y[2])), 9), x[3] is not None and x[3] == y[3]) for x in good for y in good if x[0] < y[0] and x[1] == y[1] and len(x[2]) == len(y[2]) and round(float(unit(x[2]) @ unit(y[2])), 9) >= floor}


def test_pairs_and_scores_of_several_blocks(spark):
    rows, items = _items(spark)
    want = _pairs(rows, 0.1)
    got = topics.vector_pairs(items, 0.1, block_rows=7)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r)[:3]: round(r["cosine"], 9) for r in got.collect()} == {k: v[0] for k, v in want.items()}
    assert topics.vector_pairs(items, 0.1, block_rows=7).count() == len(want)
    scored = {tuple(r)[:3]: r["score"] for r in topics.vector_pairs(items, 0.1, block_rows=7, label="label", minimum=0.3, bonus=0.25).collect()}
    plain = {k: round(c + 0.25 * same, 9) for k, (c, same) in want.items()}
    assert scored == {k: v for k, v in plain.items() if v >= 0.3}


def test_neighbours_leave_their_blocks_already_cut(spark):
    rows, items = _items(spark)
    key = ["space", "uid", "other", "cosine", "rank"]
    for k in (1, 4, 100):
        want = topics.neighbour_rankings(topics.vector_pairs(items, 0.1), k).select(*key).collect()
        assert sorted(map(tuple, topics.vector_neighbours(items, 0.1, k, block_rows=7).select(*key).collect())) == sorted(map(tuple, want))


def test_top_k_by_slices_and_by_blocks(spark, monkeypatch):
    rows, items = _items(spark)
    items = items.where("size(embedding) = 5").selectExpr("uid as doc_id", "space as scope", "embedding")
    queries = items.selectExpr("doc_id as query_id", "embedding", "case when doc_id % 2 = 0 then scope end as scope").where("embedding is not null")
    plain = sorted(map(tuple, retrieval.vector_top_k(items, queries, 4, scope=("scope",)).collect()))
    unit = {r[0]: np.array(r[2]) / (np.linalg.norm(r[2]) or 1.0) for r in rows if r[2] and len(r[2]) == 5}
    space = {r[0]: r[1] for r in rows}
    for q in (0, 1, 70, 71):
        near = sorted(((-round(float(unit[q] @ v), 9), d) for d, v in unit.items() if q % 2 or space[d] == space[q] or space[q] is None))[:4]
        assert [x[1] for x in plain if x[0] == q] == sorted(d for _, d in near)
    wide = queries.selectExpr("query_id", "scope as __q_scope", "embedding as __q")
    for k, size in ((4, 3), (1, 1000)):
        met = vector_blocks.met(items.withColumnRenamed("embedding", "__v"), wide, scope=("scope",), k=k, size=size)
        assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    got = retrieval.vector_top_k(items, queries, 4, scope=("scope",), sent_numbers=0)
    assert sorted(map(tuple, got.collect())) == plain

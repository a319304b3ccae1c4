"""The vector index against a full scan: exact with its bounds, close without, scopes and odd rows."""

import numpy as np
import pytest

from lorekeep.operators import retrieval, topics, vector_index

SF = "/root/testdata/sf0.1"


def test_exact_search_and_pairs_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, "abc"[i % 3] if i % 7 else None, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(150)]
    rows += [(200, "a", [0.0] * 8), (201, "a", rows[0][2]), (202, "a", rows[0][2]), (203, "b", None)]
    items = spark.createDataFrame(rows, "doc_id long, scope string, embedding array<double>")
    queries = spark.createDataFrame([(1, None, rows[0][2]), (2, "a", rows[5][2]), (3, "z", rows[5][2]), (4, "b", [0.0] * 8), (5, "a", (-centres[0]).tolist())], "query_id long, scope string, embedding array<double>")
    index = vector_index.build(items, 8, ("scope",))
    assert index.rows.count() == 153
    got = sorted(map(tuple, vector_index.search(index, queries, 7, 1, 1, exact=True).select("query_id", "doc_id", "score", "rank").collect()))
    assert got == sorted(map(tuple, retrieval.vector_top_k(items, queries, 7, scope=("scope",)).select("query_id", "doc_id", "score", "rank").collect()))
    space = items.selectExpr("doc_id as uid", "coalesce(scope, 'none') as space", "embedding").where("embedding is not null")
    for floor in (0.9, 0.2):
        assert sorted(map(tuple, vector_index.pairs_at(space, floor, 8).collect())) == sorted(map(tuple, topics.vector_pairs(space, floor).collect()))


def test_recall_of_the_nearest_lists(spark):
    items = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id as doc_id", "embedding", "concat('p', vec_id % 4) as scope")
    queries = items.where("doc_id % 50 = 0").selectExpr("doc_id as query_id", "embedding", "case when doc_id % 100 = 0 then 'p1' end as scope")
    exact = retrieval.vector_top_k(items, queries, 10, scope=("scope",))
    out = vector_index.recall(vector_index.search(vector_index.build(items, 24, ("scope",)), queries, 10, 20), exact).collect()
    assert sum(r["hit"] for r in out) / sum(r["expected"] for r in out) >= 0.95  # the given vectors have hardly any clusters


def test_few_lists_suffice_where_there_are_clusters(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16))
    items = spark.createDataFrame([(i, (centres[i % 20] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)], "doc_id long, embedding array<double>")
    queries = items.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    out = vector_index.recall(vector_index.search(vector_index.build(items, 20), queries, 10, 3), retrieval.vector_top_k(items, queries, 10)).collect()
    assert sum(r["hit"] for r in out) / sum(r["expected"] for r in out) >= 0.95


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    items = spark.createDataFrame([(1, [1.0, 2.0])][:n], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert vector_index.search(vector_index.build(items, 4), queries, 3, exact=True).count() == n

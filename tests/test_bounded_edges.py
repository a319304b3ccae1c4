"""The greedy choice of edges where it takes many rounds, against one edge at a time."""

import numpy as np
import pytest

from lorekeep.operators import topics


def greedy(edges, degree=3, bonus=0.10):
    have, left, out = {}, set(edges), set()
    while left := {e for e in left if have.get(e[0], 0) < degree and have.get(e[1], 0) < degree}:
        best = min(left, key=lambda e: (-round(e[2] + bonus * sum(not have.get(x) for x in e[:2]), 9), e[0], e[1]))
        left.discard(best)
        out.add(best)
        for x in best[:2]:
            have[x] = have.get(x, 0) + 1
    return out


def test_a_chain_takes_as_many_rounds_as_it_has_edges(spark):
    edges = [(i, i + 1, 0.9 - i * 0.005) for i in range(60)]
    out = topics.bounded_edges(spark.createDataFrame(edges, "a long, b long, score double"))
    assert {tuple(r) for r in out.collect()} == set(edges)


@pytest.mark.parametrize("local", [None, 25])
def test_many_edges_a_node(spark, local):
    rng = np.random.default_rng(4)
    edges = {(a, b): round(float(rng.integers(1, 40)) / 40, 9) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.7}
    rows = [(a, b, s) for (a, b), s in edges.items()]
    out = topics.bounded_edges(spark.createDataFrame(rows + rows[:9], "a long, b long, score double"), local=local)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)

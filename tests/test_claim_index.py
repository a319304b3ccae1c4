"""Claims of every length class against plain loops, and the index that holds fewer places the longer the claims."""

import random

import numpy as np
import pytest

from lorekeep.operators import profiles


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_containers_against_all_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(profiles, "SENT_GRAMS", sent)
    r, rows = random.Random(5), []
    base = ["".join(r.choice("abcé") for _ in range(r.randint(60, 260))) for _ in range(25)]
    for t in base:
        rows.append((r.choice([None, "p", "q"]), len(rows), t, float(len(rows))))
        for n in (11, 12, 13, 23, 24, 25, 40, 47, 48, 49, 95, 96, 97, 150):
            i = r.randrange(max(1, len(t) - n))
            rows.append((r.choice(["p", "q"]), len(rows), t[i : i + n], float(len(rows))))
    got = {x.claim_id: x.representative for x in profiles.collapse_claims(spark.createDataFrame(rows, "profile string, claim_id long, text string, at_s double")).collect()}
    rep = {}
    for p, i, t, _ in rows:
        rep[p, t] = max(rep.get((p, t), -1), i)
    heads = {(p, t): min(((-len(u), j) for (q, u), j in rep.items() if q == p and len(u) > len(t) >= 12 and t in u), default=(0, i))[1] for (p, t), i in rep.items() if p is not None}
    # null profiles fall together where equal and join nothing else
    assert got == {i: heads[p, t] if p is not None else rep[p, t] for p, i, t, _ in rows}
    assert len(set(got.values())) < len(rep)


def test_long_claims_are_indexed_by_a_part_of_their_places():
    text = ["".join(random.Random(3).choice("abcdefgh") for _ in range(5000))]
    made = {k: len(g) for k, _, g in profiles._grams(text, np.zeros(1, np.uint64), 12, range(4), np.empty(0, np.uint64))}
    assert made[0] == 0 and sum(made.values()) < 0.35 * 5000

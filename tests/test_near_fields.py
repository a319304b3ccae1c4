"""Near fields against all pairs, short and long, and without a broadcast of what is made of them."""

import random

import pytest

from lorekeep.operators import audit

FIELDS = "scope int, id long, field string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("size", [(0, 12), (6, 20), (20, 34)])
def test_near_fields_against_all_pairs(spark, size):
    r, rows = random.Random(size[1]), []
    for i in range(60):
        text = "".join(r.choice("abcd") for _ in range(r.randint(*size)))
        for _ in range(3):
            if r.random() < 0.7 and text:
                k = r.randrange(len(text))
                text = text[:k] + r.choice(["", "x", text[k] + "y"]) + text[k + 1 :]
            rows.append((r.randrange(2), len(rows), r.choice([text, text.upper(), text + "!"])))
    canon = lambda x: "".join(y for y in x.lower() if y.isalnum())
    want = {}
    for s, i, x in rows[::2]:
        for t, j, y in rows:
            p, q = canon(x), canon(y)
            if s == t and p == q:
                want[i, j] = "equal" if x == y else "canonical"
            elif s == t and 1 - distance(p, q) / max(len(p), len(q)) >= 0.86:
                want[i, j] = "near"
    df = spark.createDataFrame(rows, FIELDS)
    out = audit.near_fields(df.where("id % 2 = 0"), df)
    got = [((x.a, x.b), x.tier) for x in out.collect()]
    assert len(got) == len(set(got)) and dict(got) == want and "near" in want.values()


def test_rests_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, i, f"some name {i}") for i in range(50)], FIELDS).write.parquet(f"{tmp_path}/f")
    df = spark.read.parquet(f"{tmp_path}/f")
    plan = audit.near_fields(df, df)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1

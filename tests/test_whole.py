"""Queries over whole documents and tables, against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import columns as c
from lorekeep.operators import profiles
from lorekeep.plans import registry

TEXTS = ["one line of some length here\nsecond line of the text\n\nfourth\nfifth\nsixth line\nsixth line", "a longer second line of the text there\nalone\nfirst", "five\nplain\nlines\nof\ntext\n\nseventh", None]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_shared_features_of_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join([f"own{i}x{j}" for j in range(40)] + rng.choices([f"late{j}" for j in range(30)], k=12) + ["everywhere"]) for i in range(25)]
    spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [set(x.split()) for x in texts]
    want = {(i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6) for i in range(25) for j in range(i + 1, 25)}
    assert {(r["a"], r["b"]): r["jaccard"] for r in registry.QUERIES["shared_features"](spark, str(tmp_path)).collect()} == want


def test_claims_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 60))) for _ in range(25)]
    texts = base + [x[rng.randint(0, 5) : rng.randint(10, 40)] for x in base for _ in range(4)]
    df = spark.createDataFrame([("pq"[i % 2], i, x, float(rng.randint(0, 3))) for i, x in enumerate(texts)], "profile string, claim_id long, text string, at_s double")
    claims = df.withColumn("k", c.canonical_text(F.col("text"))).collect()
    reps = {}
    for r in sorted(claims, key=lambda r: (r["at_s"], r["claim_id"])):
        reps[r["profile"], r["k"]] = r["claim_id"]
    want = {}
    for r in claims:
        p, k = r["profile"], r["k"]
        over = [(-len(h), i) for (q, h), i in reps.items() if q == p and len(h) > len(k) >= 12 and k in h]
        want[p, r["claim_id"]] = min(over)[1] if over else reps[p, k]
    assert {(r["profile"], r["claim_id"]): r["representative"] for r in profiles.collapse_claims(df).collect()} == want


def test_claims_hold_every_line(spark, sf):
    got = {tuple(r["claim_id"]): tuple(r["representative"]) for r in registry.QUERIES["claim_groups"](spark, sf).collect()}
    assert len(got) == sum(len((x or "").split("\n")) for x in TEXTS) and got[0, 1] == (1, 0) and got[0, 5] == got[0, 6]


def test_claims_of_a_large_profile(spark):
    df = spark.range(6000).select(F.lit("p").alias("profile"), F.col("id").alias("claim_id"), F.concat(F.lit("claim "), F.sha1(F.col("id").cast("string"))).alias("text"), F.lit(0.0).alias("at_s"))
    assert profiles.collapse_claims(df).where("claim_id = representative").count() == 6000


def test_bound_facts_hold_every_line(spark, sf):
    got = {r["memory_id"]: r["bound"] for r in registry.QUERIES["bound_facts"](spark, sf).collect()}
    assert all(f"{x} [2024-07-01]" in got[1] for x in TEXTS[1].split("\n"))


def test_record_quality_sees_every_line(spark, sf):
    got = {(r["doc_id"], r["code"]) for r in registry.QUERIES["record_quality"](spark, sf).collect()}
    assert {(2, "empty_fact"), (0, "duplicate_fact")} <= got and (1, "empty_fact") not in got


def test_topic_recall_has_fragments(spark):
    sf = "/root/testdata/sf0.001"
    out = registry.QUERIES["topic_recall"](spark, sf).collect()
    texts = {r["doc_id"]: (r["text"] or "").split("\n") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    topics = {(r["query_id"], r["id"]) for r in out if r["kind"] == "topic"}
    fragments = [r for r in out if r["kind"] == "fragment"]
    assert fragments and all((r["query_id"], r["id"] // 1000000) in topics and texts[r["id"] // 1000000][r["id"] % 1000000].strip() for r in fragments)
    assert not {r["query_id"] for r in fragments} & {r["query_id"] for r in out if r["kind"] == "timeline"}


def test_every_row_is_a_range(spark):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    got = sorted((r["item_id"], r["range_id"]) for r in registry.QUERIES["range_overlap"](spark, sf).collect())
    assert got == sorted(con.execute(registry.SQL["range_overlap"]).fetchall()) and {r for _, r in got} == set(range(min(r for _, r in got), max(r for _, r in got) + 1))

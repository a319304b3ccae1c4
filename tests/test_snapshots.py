"""Snapshots after splits and merges equal those built from nothing; untouched topics are not read again."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import snapshots

FRAGMENT = "fragment_id long, space string, topic_id long, importance double, confidence double, start_s double, end_s double, keywords array<string>, embedding array<double>"
SOURCE = "fragment_id long, timeline long, cluster long, base double, effective double"
AFFECT = "fragment_id long, actor long, category string, confidence double, intensity double"


def made(spark, seed=1, n=80):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.2 else x
    f = [(i, "st"[i % 2], i % 12, maybe(rng.random()), maybe(rng.random()), maybe(float(rng.randrange(90))), maybe(float(rng.randrange(90, 150))), rng.sample("abcdef", rng.randrange(0, 4)), [rng.random(), rng.random()]) for i in range(n)]
    s = [(i, t, t % 3, t % 5 / 5, t % 4 / 4) for i in range(n) if i % 9 for t in rng.sample(range(20), rng.randrange(1, 4))]
    a = [(i, rng.randrange(4), rng.choice(["joy", "fear", "calm", "rage"]), rng.random(), rng.random()) for i in range(n) if i % 4]
    return snapshots.Parts(spark.createDataFrame(f, FRAGMENT), spark.createDataFrame(s, SOURCE), spark.createDataFrame(a, AFFECT))


def plain(df):
    def value(x):
        return round(x, 9) if isinstance(x, float) else tuple(map(value, x)) if isinstance(x, list) else x

    return sorted(((tuple(value(r[k]) for k in sorted(df.columns))) for r in df.collect()), key=str)


@pytest.mark.parametrize("moves", [lambda i: i % 12 + 100 if i % 12 < 2 and i > 40 else None, lambda i: 5 if i % 12 == 6 else None, lambda i: i % 12, lambda i: None])
def test_regroup_equals_a_rebuild(spark, moves):
    parts = made(spark)
    old = snapshots.build(parts)
    mapping = spark.createDataFrame([(i, moves(i)) for i in range(80) if moves(i) is not None], "fragment_id long, topic_id long")
    marked = snapshots.Build(old.parts, old.snapshots.withColumn("n_fragments", F.col("n_fragments") + 1000), old.links)
    new, touched = snapshots.regroup(marked, mapping)
    whole = snapshots.build(new.parts)
    gone = {r["topic_id"] for r in touched.collect()}
    # a row of an untouched topic still bears the mark, so it was not made again
    got = new.snapshots.withColumn("n_fragments", F.when(F.col("topic_id").isin(*gone) if gone else F.lit(False), F.col("n_fragments")).otherwise(F.col("n_fragments") - 1000))
    assert plain(got) == plain(whole.snapshots) and plain(new.links) == plain(whole.links)
    changed = {i % 12 for i in range(80) if moves(i) not in (None, i % 12)} | {moves(i) for i in range(80) if moves(i) not in (None, i % 12)}
    assert gone == changed


def test_relations_follow_in_touched_spaces_only(spark):
    parts = made(spark)
    old = snapshots.build(parts)
    new, touched = snapshots.regroup(old, spark.createDataFrame([(0, 2)], "fragment_id long, topic_id long"))  # both of space s
    before = spark.createDataFrame([("s", 1), ("t", 1)], "space string, version int")
    out = snapshots.relations_after(before, new, old, touched, lambda s: s.select("space", F.lit(2).alias("version")).distinct())
    assert sorted(map(tuple, out.collect())) == [("s", 2), ("t", 1)]


def test_nothing(spark):
    parts = made(spark)
    none = snapshots.Parts(parts.fragments.limit(0), parts.sources.limit(0), parts.affects.limit(0))
    assert snapshots.build(none).snapshots.count() == 0
    bare = snapshots.Parts(parts.fragments, parts.sources.limit(0), parts.affects.limit(0))
    out = snapshots.build(bare)
    assert out.links.count() == 0 and out.snapshots.where("n_timelines = 0 and size(affects) = 0").count() == 12

"""Repeated contexts against a plain loop, and at a size where pairs of evidence would not end."""

import random

from pyspark.sql import functions as F

from lorekeep.operators import profiles


def test_contexts_equal_a_plain_loop_and_end_on_crowded_minutes(spark):
    rng = random.Random(5)
    rows = [(p, rng.randrange(25), t, rng.choice([None, *range(0, 1440, 37)]), float(rng.randrange(9) * 86400)) for p in range(3) for t in "xy" for _ in range(40)]
    want = set()
    for p in range(3):
        for t in "xy":
            own = [r for r in rows if r[0] == p and r[2] == t and r[3] is not None]
            found = []
            for r in own:
                near = [o for o in own if min(abs(o[3] - r[3]), 1440 - abs(o[3] - r[3])) <= 120]
                n, days = len({o[1] for o in near}), (max(o[4] for o in near) - min(o[4] for o in near)) / 86400
                if n >= 3 and days >= 2:
                    found.append((-n, r[3], r[1], days))
            if found:
                n, m, seed, days = min(found)
                want.add((p, t, seed, m, -n, days))
    crowd = spark.range(100_000).select(F.lit(9).cast("long").alias("profile"), F.col("id").alias("timeline"), F.lit("x").alias("term"), (F.col("id") % 3).cast("int").alias("minute"), (F.col("id") % 4 * 86400).cast("double").alias("at_s"))
    ev = spark.createDataFrame(rows, "profile long, timeline long, term string, minute int, at_s double").unionByName(crowd)
    got = {tuple(r) for r in profiles.repeated_contexts(ev).select("profile", "term", "seed", "m", "n", "days").collect()}
    assert got == want | {(9, "x", 0, 0, 100_000, 3.0)}

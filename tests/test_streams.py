"""Streams over small files: late rows, replays, and the state of cuts."""

import datetime as dt

from pyspark.sql import functions as F

from lorekeep.streaming import streams


def stream(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_dedup_across_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "id long, session_id string, sender_id string, content string, ts timestamp"
    df = stream(spark, tmp_path, [[(1, "s", "u", "a", t)], [(1, "s", "u", "a", t), (2, "s", "u", "b", t)]], schema)
    q = streams.deduplicated(df).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.sql("select id from dedup").collect()) == [1, 2]


def test_projection_survives_a_restart(spark, tmp_path):
    schema = "sequence long, scope long, timeline_uid string, operation string, value double"
    df = stream(spark, tmp_path, [[(1, 1, "a", "upsert", 1.0)], [(2, 1, "a", "upsert", 2.0), (3, 1, "b", "upsert", 1.0)], [(4, 1, "b", "delete", 0.0)]], schema)
    for _ in range(2):
        q = streams.fold_projection(df, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = streams.projected(spark, str(tmp_path / "log"), 2).collect()
    assert [(r["timeline_uid"], r["value"]) for r in got] == [("a", 2.0)]


def test_round_cuts_keep_state(spark, tmp_path):
    a, b = [1.0, 0.0], [0.0, 1.0]
    schema = "session_id string, unit long, embedding array<double>, ts timestamp"
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i) for i in range(4)]
    df = stream(spark, tmp_path, [[("s", 0, a, t[0]), ("s", 1, a, t[1])], [("s", 2, b, t[2]), ("s", 3, b, t[3])]], schema)
    q = streams.round_cuts(df, 2, 5, 0.5).writeStream.outputMode("append").format("memory").queryName("cuts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select first_unit, last_unit, reason from cuts where reason = 'topic_changed'").collect()] == [(0, 1, "topic_changed")]


def test_session_state(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", "u", t), ("s", "v", t)], "session_id string, sender_id string, ts timestamp")
    r = streams.session_state(df).collect()[0]
    assert r["message_count"] == 2 and r["n_participants"] == 2
    assert df.select(F.lit(1)).count() == 2

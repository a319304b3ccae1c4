"""Event times against their meaning, anchors, and the unified answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import facts, recall


TIMES = [
    ("2024-03-05 下午3点20分开会", "2024-03-05 15:20:00"), ("2024年3月5日", "2024-03-05 00:00:00"), ("十二天前", "2024-05-10 10:30:00"), ("2个月后", "2024-07-21 10:30:00"),
    ("大后天晚上八点", "2024-05-25 20:00:00"), ("昨天", "2024-05-21 10:30:00"), ("下周一", "2024-05-20 10:30:00"), ("下周周一", "2024-05-27 10:30:00"), ("上周周日下午两点", "2024-05-19 14:00:00"), ("下下周周三", "2024-06-05 10:30:00"), ("示例甲两小时前确认了会议", "2024-05-22 08:30:00"),
    ("2024年7月28日下午三点十五分开会", "2024-07-28 15:15:00"), ("昨天晚上八点见面", "2024-05-21 20:00:00"), ("前天凌晨12点", "2024-05-20 00:00:00"), ("明天中午1点", "2024-05-23 13:00:00"), ("后天25点", "2024-05-24 10:30:00"), ("二十分钟前", "2024-05-22 10:10:00"),
    ("九十九天后", "2024-08-29 10:30:00"), ("3年前", "2021-05-23 10:30:00"), ("12月31号早上9点", "2024-12-31 09:00:00"), ("13月1日", None), ("昨天和大后天", "2024-05-25 10:30:00"), ("2024/3/5 和昨天 8点", "2024-03-05 08:00:00"), ("十周后 3点", "2024-07-31 10:30:00"), ("今天", "2024-05-22 10:30:00"),
    ("周五", "2024-05-24 10:30:00"), ("6月1日", "2024-06-01 00:00:00"),
    ("nothing", None), ("2024-13-40", None),
]


def test_event_time(spark):
    df = spark.createDataFrame([(text, dt.datetime(2024, 5, 22, 10, 30)) for text, _ in TIMES], "t string, r timestamp")
    rows = df.select("t", F.date_format(facts.event_time(F.col("t"), F.col("r"), "UTC"), "yyyy-MM-dd HH:mm:ss").alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == dict(TIMES)


def test_weeks_as_people_mean_them_and_zones(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 5, 22, 20, 30),)], "r timestamp")
    said = lambda text, zone, **k: df.select(F.date_format(facts.event_time(F.lit(text), F.col("r"), zone, **k), "yyyy-MM-dd HH:mm")).first()[0]
    assert said("下周一", "UTC", natural_weeks=True) == said("下周周一", "UTC", natural_weeks=True) == "2024-05-27 20:30"
    assert said("明天早上9点", "Asia/Shanghai") == "2024-05-24 01:00"  # there it is the 23rd already


def test_anchors(spark):
    m = spark.createDataFrame([(1, "likes tea. likes tea."), (2, None)], "memory_id long, text string")
    f = spark.createDataFrame([(1, 0, "likes tea", 0.0), (1, 1, "has a dog", None)], "memory_id long, pos int, fact string, start_s double")
    got = {r["memory_id"]: r["bound"] for r in facts.bind_anchors(m, f).collect()}
    assert got == {1: "likes tea [1970-01-01]. likes tea.\n- has a dog", 2: ""}


def test_unified(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "query_id long, id long, score double") if x else spark.createDataFrame([], "query_id long, id long, score double")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    out = recall.unified(rows((1, 10, 0.9), (2, 11, 0.5)), rows((1, 20, 0.8)), rows((1, 30, 1.0), (2, 31, 0.7), (3, 32, 0.4)), q, 2)
    assert sorted((r["query_id"], r["place"], r["kind"], r["id"]) for r in out.collect()) == [(1, 1, "topic", 10), (1, 2, "fragment", 20), (2, 1, "topic", 11), (2, 2, "timeline", 31), (3, 1, "timeline", 32)]


def test_context_support_needs_the_primary_branch(spark):
    b = spark.createDataFrame([(1, 1, "current", 1.0, 0.5), (1, 1, "recent_user", 0.5, 0.8), (1, 2, "recent_user", 0.5, 0.9)], "query_id long, topic_id long, branch string, weight double, score double")
    got = recall.context_support(b).collect()
    assert [(r["topic_id"], r["relevance"]) for r in got] == [(1, 0.5)] and got[0]["support"] == pytest.approx(0.08 * 0.4)

"""Topics of requests that share their actors."""

import re

from lorekeep.operators import overviews


def test_requests_share_lists_of_topics(spark):
    actors = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, None), (4, "c")], "topic_id long, actor_id string")
    wanted = spark.createDataFrame([(7, '["a","b"]'), (8, '["b","a","a"]'), (9, '["c"]'), (9, '["b"]'), (9, '["b"]'), (10, "[]"), (11, None), (12, "[null]")], "request_id long, actor_ids string")
    out = overviews.topics_with(actors, wanted)
    assert sorted((x.request_id, x.topic_id) for x in out.collect()) == [(7, 1), (7, 2), (8, 1), (8, 2), (9, 1), (9, 2), (9, 4)]
    assert not re.search(r"Aggregate \[request_id#\w+, topic_id#", out._jdf.queryExecution().optimizedPlan().toString())

"""Imports of every known shape."""

import json

import pytest

from lorekeep.sources import shapes

TALK = [{"role": "AI", "content": " a "}, {"speaker": "customer", "value": "b"}]
SAID = [("assistant", "a"), ("user", "b")]
CASES = {
    "list": ([{"id": 7, "content": " x ", "importance": 7}, "plain", 5, {"content": ""}], [("7", "x", 0.7, None, []), (None, "plain", 0.5, None, []), "neither an object nor text", "neither text nor two messages"]),
    "talk": (TALK, [(None, "", 0.5, None, SAID)]),
    "empty": ([], []),
    "collection": ({"memories": {"k2": "note", "k1": {"text": "t", "original_id": "own"}, "k3": 4}, "version": 1}, [("own", "t", 0.5, None, []), ("k2", "note", 0.5, None, [])]),
    "both": ({"conversations": {"s1": TALK, "s2": {"messages": json.dumps(TALK), "session_id": "z"}}, "long_term_memory": [{"summary": "s", "metadata": {"session_id": "m", "importance": "0.25"}}]}, [(None, "s", 0.25, "m", []), (None, "", 0.5, "s1", SAID), (None, "", 0.5, "z", SAID)]),
    "talks": ({"sessions": [TALK, {"dialog": TALK, "memory": "x"}]}, [(None, "", 0.5, None, SAID), (None, "x", 0.5, None, SAID)]),
    "one talk": ({"sessions": TALK}, [(None, "", 0.5, None, SAID)]),
    "wrapped": ({"data": {"data": [{"value": 12}]}}, [(None, "12", 0.5, None, [])]),
    "ids": ({"b": "x", "a": {"content": "y", "session": " s "}}, [("a", "y", 0.5, "s", []), ("b", "x", 0.5, None, [])]),
    "not ids": ({"b": "x", "a": 1}, ["neither text nor two messages"]),
    "pair": ({"content": None, "query": "q", "output": "o", "importance": -3}, [(None, "", 0.0, None, [("user", "q"), ("assistant", "o")])]),
    "nested text": ({"content": {"a": 1}, "messages": ["one", {"role": "tool", "text": "two"}, {"role": "user"}, 3]}, [(None, "", 0.5, None, [("user", "one"), ("tool", "two")])]),
    "scalar": (3, ["neither an object nor a list"]),
}


@pytest.fixture(scope="module")
def got(spark):
    rows = [(k, json.dumps(v[0])) for k, v in CASES.items()] + [("broken", "{no"), ("null", None)]
    out = {}
    for r in shapes.imported(shapes.payload_entries(spark.createDataFrame(rows, "file string, payload string"))).orderBy("file", "index").collect():
        out.setdefault(r.file, []).append(r.error or (r.original_id, r.content, r.importance, r.session_id, [(m["role"], m["content"]) for m in r.messages]))
    return out


@pytest.mark.parametrize("name", sorted(CASES))
def test_shape(got, name):
    assert got.get(name, []) == CASES[name][1]


def test_broken(got):
    assert got["broken"] == ["not JSON"] and got["null"] == ["not JSON"]


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text('original_id,content,importance,session_id,topics,source_messages\n1,"\'=sum, ""x""\nnext",5,s,"[""a"",""b""]",\n2,,,,,"[{""role"":""bot"",""content"":""p""},""q""]"\n3,,,,,\n')
    out = shapes.imported(shapes.csv_entries(spark, str(tmp_path / "in.csv"))).orderBy("index").collect()
    assert [(r["index"], r.original_id, r.content, r.importance, list(r.topics), len(r.messages), r.error) for r in out] == [(0, "1", '=sum, "x"\nnext', 0.5, ["a", "b"], 0, None), (1, "2", "", 0.5, [], 2, None), (2, "3", "", 0.5, [], 0, "neither text nor two messages")]

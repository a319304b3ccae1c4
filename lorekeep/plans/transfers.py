"""Imports: every document comes in a payload of one of ten shapes, by its number. The SQL states what each shape must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shapes
from .fixtures import table
from .recall import query

_TALK = "array(map('role', 'AI', 'content', t), map('speaker', 'customer', 'value', 'yes'))"
_SHAPES = [
    "concat('[', to_json(map('id', string(doc_id), 'content', t, 'importance', '7')), ',\"plain ', doc_id, '\"]')",
    f"to_json({_TALK})",
    "concat('{\"memories\":', to_json(map('k1', map('text', t))), ',\"long_term_memories\":{\"k2\":\"note\",\"k3\":4}}')",
    f"concat('{{\"sessions\":', to_json(map('s1', {_TALK})), ',\"memories\":[', to_json(map('summary', t, 'importance', '0.25')), ']}}')",
    "concat('{\"data\":{\"data\":[', to_json(map('memory', t, 'session', ' room ')), ']}}')",
    "concat('{\"a\":', to_json(map('content', t)), ',\"b\":\"x\"}')",
    "to_json(map('content', '', 'user', 'hi', 'output', t))",
    "'[{\"content\":\"\"},5,{\"dialogue\":\"[{\\\\\"role\\\\\":\\\\\"human\\\\\",\\\\\"text\\\\\":\\\\\"alone\\\\\"}]\"}]'",
    "concat('{no: ', t)",
    "to_json(map('content', t, 'metadata', concat('{\"topics\":[\"', doc_id, '\"],\"persona_id\":\"p\"}'), 'key_facts', '[\"f\",\"g\"]', 'type', 'fact'))",
]

_ROW = "doc_id::varchar as file, {index}::bigint as index, {id} as original_id, {content} as content, {importance}::double as importance, {session} as session_id, {persona} as persona_id, {kind} as memory_type, {topics} as topics, {facts} as key_facts, {messages} as messages, {error} as error"
_NONE = {"index": "0", "id": "null", "content": "''", "importance": "0.5", "session": "null", "persona": "null", "kind": "null", "topics": "''", "facts": "''", "messages": "''", "error": "null"}
_SAID = "case when t <> '' then 'assistant:' || t || chr(31) else '' end || 'user:yes'"
_NO_TEXT = "case when t = '' then 'neither text nor two messages' end"
_WANT = [
    (0, {"id": "doc_id::varchar", "content": "t", "importance": "0.7", "error": _NO_TEXT}), (0, {"index": "1", "content": "'plain ' || doc_id"}),
    (1, {"messages": _SAID, "error": _NO_TEXT}),
    (2, {"id": "'k1'", "content": "t", "error": _NO_TEXT}), (2, {"index": "1", "id": "'k2'", "content": "'note'"}),
    (3, {"content": "t", "importance": "0.25", "error": _NO_TEXT}), (3, {"index": "1", "session": "'s1'", "messages": _SAID, "error": _NO_TEXT}),
    (4, {"content": "t", "session": "'room'", "error": _NO_TEXT}),
    (5, {"id": "'a'", "content": "t", "error": _NO_TEXT}), (5, {"index": "1", "id": "'b'", "content": "'x'"}),
    (6, {"messages": "case when t <> '' then 'user:hi' || chr(31) || 'assistant:' || t else '' end", "error": _NO_TEXT}),
    (7, {"error": "'neither text nor two messages'"}), (7, {"index": "1", "error": "'neither an object nor text'"}), (7, {"index": "2", "messages": "'user:alone'", "error": "'neither text nor two messages'"}),
    (8, {"error": "'not JSON'"}),
    (9, {"content": "t", "persona": "'p'", "kind": "'FACT'", "topics": "doc_id::varchar", "facts": "'f,g'", "error": _NO_TEXT}),
]
_SQL = "with d as (select doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as t from documents), u as (" + " union all ".join(f"select {_ROW.format(**_NONE | row)} from d where doc_id % 10 = {shape}" for shape, row in _WANT) + ") select * exclude (content, messages), sha256(content) as content, sha256(messages) as messages from u"


@query(_SQL)
def transfer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of payloads of all shapes, as memories or with the error; texts and messages as digests. An entry that is neither an object nor text has defaults."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    cases = " ".join(f"when {i} then {x}" for i, x in enumerate(_SHAPES))
    payloads = d.select(F.col("doc_id").cast("string").alias("file"), F.expr(f"case doc_id % 10 {cases} end").alias("payload"))
    out = shapes.imported(shapes.payload_entries(payloads))
    said = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\x1f")
    return out.select("file", "index", "original_id", F.sha2("content", 256).alias("content"), "importance", "session_id", "persona_id", "memory_type", F.array_join("topics", ",").alias("topics"), F.array_join("key_facts", ",").alias("key_facts"), F.sha2(said, 256).alias("messages"), "error")

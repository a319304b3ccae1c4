"""Import of memories from JSON of any of the known shapes, as VARIANT values: collections, maps of ids to items, lists of messages, wrapped payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c

#: Names under which a field is found, the first that has a value; collections of entries and of conversations; names of roles.
CONTENT = ("content", "text", "summary", "memory", "value")
MESSAGES = ("source_messages", "messages", "conversation", "dialogue", "dialog")
LONG_TERM = ("memories", "long_term_memories", "longTermMemories", "long_term_memory")
SHORT_TERM = ("short_term_memories", "shortTermMemories", "conversations", "sessions")
SPEAKER, SAID = ("role", "sender", "speaker"), ("content", "text", "message", "value")
ASKED, ANSWERED = ("user", "human", "query", "input"), ("assistant", "ai", "bot", "response", "output")
ROLES = {"ai": "assistant", "bot": "assistant", "model": "assistant", "human": "user", "customer": "user"}
#: A payload may be wrapped in `data` so many times.
WRAPPED = 16

_ENTRY = "struct<id string, session string, messages variant, item variant>"


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _plain(v: Column) -> Column:
    """Whether a value is a string: what is no list, no map and not readable as JSON of another kind."""
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _any_key(m: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.map_contains_key(m, n) for n in names]), F.lit(False))


def _value(m: Column, names: tuple[str, ...]) -> Column:
    """The first of the names whose value is neither null nor empty text."""
    return F.coalesce(*[F.when(~F.is_variant_null(m[n]) & (_text(m[n]) != ""), m[n]) for n in names])


def _scalar(m: Column, names: tuple[str, ...]) -> Column:
    """That value as stripped text; none for lists and maps."""
    v = _value(m, names)
    return F.when(_list(v).isNull() & _map(v).isNull(), F.regexp_replace(_text(v), r"(?U)^\s+|\s+$", ""))


def _parsed(v: Column) -> Column:
    """Text that holds JSON is read, all else stays."""
    return F.coalesce(F.when(_plain(v), F.try_parse_json(_text(v))), v)


def _talk(a: Column) -> Column:
    """Whether a list is one of messages: not empty, each with a speaker and something said."""
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: _any_key(_map(x), SPEAKER) & _any_key(_map(x), SAID)), F.lit(False))


def _entry(item: Column | None = None, id: Column | None = None, session: Column | None = None, messages: Column | None = None) -> Column:
    part = lambda x, kind: F.lit(None).cast(kind) if x is None else x
    return F.struct(part(id, "string").alias("id"), part(session, "string").alias("session"), part(messages, "variant").alias("messages"), part(item, "variant").alias("item"))


def _of_map(v: Column) -> Column:
    """Entries of a map of ids to items; values that are neither maps nor text are none."""
    kept = F.filter(F.map_entries(_map(v)), lambda e: _map(e["value"]).isNotNull() | _plain(e["value"]))
    return F.transform(kept, lambda e: _entry(e["value"], id=e["key"]))


def _of_list(v: Column) -> Column:
    return F.transform(_list(v), lambda x: _entry(x))


def _of_talks(v: Column) -> Column:
    """Entries of a collection of conversations: a map of sessions, one list of messages, or a list of either kind of item."""
    sessions = F.filter(F.map_entries(_map(v)), lambda e: _list(e["value"]).isNotNull() | _map(e["value"]).isNotNull())
    by_session = F.transform(sessions, lambda e: F.when(_list(e["value"]).isNotNull(), _entry(session=e["key"], messages=e["value"])).otherwise(_entry(e["value"], session=e["key"])))
    each = F.transform(_list(v), lambda x: F.when(_list(x).isNotNull(), _entry(messages=x)).otherwise(_entry(x)))
    return F.when(_talk(_list(v)), F.array(_entry(messages=v))).otherwise(F.coalesce(each, by_session))


def payload_entries(payloads: DataFrame) -> DataFrame:
    """payloads: file, payload (JSON text). One row per entry: file, index (its place in the payload; entries of a map count in the order of their keys), entry; a payload that
    is no JSON, or neither an object nor a list, gives one row with an error."""
    none = F.array().cast(f"array<{_ENTRY}>")
    whole = payloads.select("file", F.try_parse_json("payload").alias("v"))
    # a wrapped payload is opened as long as it holds neither a collection nor anything but a list or an object in it
    inner = lambda v: F.try_variant_get(v, "$.data", "variant")
    opens = lambda v: ~_any_key(_map(v), LONG_TERM + SHORT_TERM) & (_list(inner(v)).isNotNull() | _map(inner(v)).isNotNull())
    whole = whole.withColumn("v", F.aggregate(F.array_repeat(F.lit(1), WRAPPED), F.col("v"), lambda v, _: F.when(F.coalesce(opens(v), F.lit(False)), inner(v)).otherwise(v)))
    v, m = F.col("v"), _map(F.col("v"))
    found = F.concat(*[F.coalesce(_of_list(m[k]), _of_map(m[k]), none) for k in LONG_TERM], *[F.coalesce(_of_talks(m[k]), none) for k in SHORT_TERM])
    ids = (F.cardinality(m) > 0) & ~_any_key(m, CONTENT + MESSAGES) & F.forall(F.map_values(m), lambda x: _map(x).isNotNull() | _plain(x))
    entries = (
        F.when(_list(v).isNotNull(), F.when(_talk(_list(v)), F.array(_entry(messages=v))).otherwise(_of_list(v)))
        .when(_any_key(m, LONG_TERM + SHORT_TERM), found).when(ids, _of_map(v)).when(m.isNotNull(), F.array(_entry(v)))
    )
    broken = F.when(v.isNull(), "not JSON").when(_list(v).isNull() & m.isNull(), "neither an object nor a list")
    df = whole.select("file", broken.alias("error"), entries.alias("entries"))
    good = df.where("error is null").select("file", F.posexplode("entries").alias("index", "entry"), F.lit(None).cast("string").alias("error"))
    bad = df.where("error is not null").select("file", F.lit(0).alias("index"), F.lit(None).cast(_ENTRY).alias("entry"), "error")
    return good.unionByName(bad)


def csv_entries(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header as entries; a quote before a formula in text fields is taken off. Rows are numbered within their file, which one task reads whole."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    bare = lambda x: F.regexp_replace(x, "^'(?=[=+\\-@\\t\\r])", "")
    fields = [(bare(F.col(f"`{k}`")) if k in ("content", "session_id", "persona_id", "memory_type") else F.col(f"`{k}`")).alias(k) for k in rows.columns]
    named = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("__at"), F.parse_json(F.to_json(F.struct(*fields))).alias("item"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("__at")) - 1
    return named.select("file", number.alias("index"), _entry(F.col("item")).alias("entry"), F.lit(None).cast("string").alias("error"))


def _messages(v: Column) -> Column:
    """Messages of a value: a list, a map that holds one, or JSON text of either. Texts are the user's; those without words are none."""
    v = _parsed(v)
    a = F.coalesce(_list(v), _list(F.try_variant_get(v, "$.messages", "variant")), _list(F.try_variant_get(v, "$.conversation", "variant")))
    name = lambda m: F.lower(F.coalesce(_text(_value(m, SPEAKER)), F.lit("user")))
    role = lambda m: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), name(m)), name(m))
    said = lambda x: F.when(_plain(x), F.struct(F.lit("user").alias("role"), F.regexp_replace(_text(x), r"(?U)^\s+|\s+$", "").alias("content"))).when(_map(x).isNotNull(), F.struct(role(_map(x)).alias("role"), _scalar(_map(x), SAID).alias("content")))
    return F.filter(F.transform(F.coalesce(a, F.array().cast("array<variant>")), said), lambda s: F.coalesce(s["content"] != "", F.lit(False)))


def _strings(m: Column, name: str) -> Column:
    return F.transform(F.coalesce(_list(_parsed(m[name])), F.array().cast("array<variant>")), _text)


def imported(entries: DataFrame) -> DataFrame:
    """Entries as memories, with `error` null for those to keep: file, index, original_id, content, importance, session_id, persona_id, memory_type, topics, key_facts,
    participants, messages (role, content), error. An entry needs a text or two messages, or a question with an answer; importance above 1 and up to 10 is divided by 10."""
    e = F.col("entry")
    item = F.when(_plain(e["item"]), F.map_from_arrays(F.array(F.lit("content")), F.array(e["item"]))).otherwise(F.coalesce(_map(e["item"]), F.when(e["messages"].isNotNull(), F.create_map().cast("map<string,variant>"))))
    df = entries.select("file", "index", "error", "entry", item.alias("m"))
    m = F.col("m")
    df = df.withColumn("meta", F.coalesce(_map(_parsed(m["metadata"])), F.create_map().cast("map<string,variant>")))
    meta = F.col("meta")
    given = lambda *choices: reduce(lambda rest, x: F.when(F.map_contains_key(x[0], x[1]), _text(x[0][x[1]])).otherwise(rest), reversed(choices), F.lit(None).cast("string"))
    clean = lambda x: F.nullif(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(""))
    session = F.when(F.map_contains_key(m, "session_id"), _text(m["session_id"])).otherwise(F.coalesce(e["session"], given((m, "session"), (meta, "session_id"))))
    talk = _messages(F.coalesce(e["messages"], _value(m, MESSAGES)))
    asked, answered = _scalar(m, ASKED), _scalar(m, ANSWERED)
    pair = F.when((asked != "") & (answered != ""), F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")), F.struct(F.lit("assistant").alias("role"), answered.alias("content"))))
    number = given((m, "importance"), (meta, "importance")).try_cast("double")
    kind = F.coalesce(_text(_value(m, ("memory_type", "type"))), _text(_value(meta, ("memory_type",))))
    df = df.select(
        "file", F.col("index").cast("long").alias("index"), F.when(F.map_contains_key(m, "original_id"), _text(m["original_id"])).otherwise(F.coalesce(e["id"], given((m, "id")))).alias("original_id"),
        F.coalesce(_scalar(m, CONTENT), F.lit("")).alias("content"), c.clamp(F.when((number > 1) & (number <= 10), number / 10).otherwise(number), default=0.5).alias("importance"),
        clean(session).alias("session_id"), clean(given((m, "persona_id"), (m, "persona"), (meta, "persona_id"))).alias("persona_id"), F.upper(kind).alias("memory_type"),
        *[F.when(F.size(_strings(m, x)) > 0, _strings(m, x)).otherwise(_strings(meta, x)).alias(x) for x in ("topics", "key_facts", "participants")],
        F.when(F.size(talk) > 0, talk).otherwise(F.coalesce(pair, talk)).alias("messages"), F.when(F.col("error").isNotNull(), F.col("error")).when(m.isNull(), "neither an object nor text").alias("error"),
    )
    short = (F.col("content") == "") & (F.size("messages") < 2)
    return df.withColumn("error", F.coalesce("error", F.when(short, "neither text nor two messages")))

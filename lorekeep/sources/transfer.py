"""Reading and writing memories: typed scans, imports of flat JSON and CSV records with field aliases (`shapes` has nested ones), portable exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as c

MESSAGES = "id long, session_id string, role string, content string, sender_id string, sender_name string, group_id string, platform string, ts timestamp, metadata map<string,string>"
MEMORIES = "doc_id long, memory_uid string, text string, session_id string, persona_id string, memory_space_id string, status string, importance double, base_importance double, create_ts timestamp, last_access_ts timestamp, access_count int, topics array<string>, participants array<string>, key_facts array<string>, embedding array<float>, metadata map<string,string>"

#: Other names of fields, and of roles, those of `shapes` and a few more.
ALIASES = {
    "text": ["text", "content", "memory", "summary", "value"], "session_id": ["session_id", "session", "conversation_id"], "persona_id": ["persona_id", "persona"],
    "importance": ["importance", "score", "weight"], "original_id": ["original_id", "id", "doc_id"], "messages": ["messages", "source_messages", "conversation", "dialogue", "dialog", "history"],
}
ROLES = {"human": "user", "customer": "user", "me": "user", "ai": "assistant", "bot": "assistant", "model": "assistant"}


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A scan with an explicit schema: nothing is inferred, and filters and columns reach the files."""
    return spark.read.schema(schema).format(kind).load(path)


def role_name(role: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(role, F.lit("user"))))
    for other, known in ROLES.items():
        r = F.when(r == other, known).otherwise(r)
    return F.when(r.isin("user", "assistant", "system"), r).otherwise("user")


def read_import(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Raw records as strings by name: JSON lines or arrays (multi-line), or CSV with a header."""
    names = sorted({x for v in ALIASES.values() for x in v})
    if kind == "csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return raw.select(*[(F.col(x) if x in raw.columns else F.lit(None).cast("string")).alias(x) for x in names])
    schema = T.StructType([T.StructField(x, T.StringType()) for x in names] + [T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def normalise(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): fields by their aliases; importance above 1 and up to 10 is divided by 10; a record needs a text or two messages."""
    names = set(raw.columns)
    pick = lambda k: F.coalesce(*[F.col(x).cast("string") for x in ALIASES[k] if x in names], F.lit(None).cast("string"))
    messages = F.from_json(pick("messages"), "array<struct<role string, content string>>")
    messages = F.transform(messages, lambda m: F.struct(role_name(m["role"]).alias("role"), m["content"].alias("content")))
    value = pick("importance").try_cast("double")
    df = raw.select(
        F.trim(pick("text")).alias("text"), pick("session_id").alias("session_id"), pick("persona_id").alias("persona_id"), pick("original_id").alias("original_id"),
        c.clamp(F.when((value > 1) & (value <= 10), value / 10).otherwise(value), default=0.5).alias("importance"), messages.alias("source_messages"),
        (F.col("_corrupt") if "_corrupt" in names else F.lit(None).cast("string")).alias("_corrupt"),
    )
    has_text, talks = F.coalesce(F.length("text") > 0, F.lit(False)), F.coalesce(F.size("source_messages") >= 2, F.lit(False))
    error = F.when(F.col("_corrupt").isNotNull(), "corrupt").when(~(has_text | talks), "neither text nor two messages")
    df = df.withColumn("error", error)
    return df.where(F.col("error").isNull()).drop("error", "_corrupt"), df.where(F.col("error").isNotNull()).select("original_id", "error")


def portable(memories: DataFrame, snapshots: DataFrame, internal: tuple[str, ...] = ("index_state", "write_op")) -> DataFrame:
    """Export rows: base importance if there is one, metadata without internal keys, kept source messages as JSON."""
    joined = memories.join(snapshots, memories["doc_id"] == snapshots["memory_id"], "left")
    meta = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*internal))
    return joined.select(F.col("doc_id").alias("original_id"), "text", "session_id", "persona_id", F.coalesce("base_importance", "importance").alias("importance"), F.to_json(meta).alias("metadata"), F.to_json("messages").alias("source_messages"))


def write_export(rows: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "csv":
        texts = {k for k, t in rows.dtypes if t == "string"}
        rows.select(*[c.csv_safe(F.col(k)).alias(k) if k in texts else F.col(k) for k in rows.columns]).write.option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.json(path)


def json_field(column: Column, field: str, kind: str, default: object) -> Column:
    """A field of a JSON text column with a default for anything missing or broken."""
    return F.coalesce(F.get_json_object(column, f"$.{field}").try_cast(kind), F.lit(default).cast(kind))

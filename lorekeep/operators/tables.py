"""Keyed tables: upsert, retention, change logs, consistency, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only where Spark is one process may it be unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "path" not in _LOCAL:
        _LOCAL["path"] = f"file://{tempfile.mkdtemp(prefix='spark-lorekeep-')}"
    return _LOCAL["path"]


_LOCAL: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows are written to the shared folder and read back. A plain scan has its files' size as its estimate; a table kept by
    DataFrame.checkpoint keeps the plan's, which joins multiply, so that in rounds it grows until the planner drowns in it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, created: str | None = None) -> DataFrame:
    """The newest row of each key over both tables (new wins a tie); the creation time is the oldest."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys)
    if created:
        rows = rows.withColumn(created, F.min(created).over(w))
    newest = F.row_number().over(w.orderBy(F.col(version).desc(), F.col("__new").desc()))
    return rows.withColumn("__n", newest).where(F.col("__n") == 1).drop("__n", "__new")


def keep_newest(traces: DataFrame, n: int, by: str = "trace_type", at: str = "created_at", key: str = "trace_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(at).desc(), F.col(key).desc())
    return traces.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def fold_changes(changes: DataFrame) -> DataFrame:
    """Current state of a change log: the last operation of each (scope, timeline_uid); deleted and archived ones are gone."""
    last = changes.groupBy("scope", "timeline_uid").agg(F.max_by(F.struct("sequence", "operation", "value"), "sequence").alias("s"))
    return last.select("scope", "timeline_uid", "s.*").where(~F.col("operation").isin("delete", "archive"))


def gap_status(events: DataFrame) -> DataFrame:
    """events: scope, sequence, status. Highest sequence, pending and failed counts, and whether a number is missing."""
    out = events.groupBy("scope").agg(F.max("sequence").alias("last"), F.min("sequence").alias("first"), F.countDistinct("sequence").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("resumable"))
    return out.withColumn("has_gap", F.col("last") - F.col("first") + 1 > F.col("n")).drop("first")


def compact_events(events: DataFrame) -> DataFrame:
    """Drops completed events that a later completed one of the same scope and timeline supersedes."""
    newest = F.max(F.when(F.col("status") == "completed", F.col("sequence"))).over(Window.partitionBy("scope", "timeline_uid"))
    return events.withColumn("__m", newest).where((F.col("status") != "completed") | (F.col("sequence") >= F.col("__m"))).drop("__m")


def import_duplicates(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to import: new by (text with spaces collapsed, session, persona) against existing rows and earlier incoming ones."""
    key = lambda df: df.withColumn("__k", F.sha2(F.concat_ws("\x1f", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.coalesce("session_id", F.lit("")), F.coalesce("persona_id", F.lit(""))), 256))
    fresh = key(incoming).join(key(existing).select("__k"), "__k", "left_anti")
    w = Window.partitionBy("__k").orderBy("doc_id")
    return fresh.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n", "__k")


def orphans(checks: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(kind, id) of rows whose partner is missing. checks: kind -> (rows, partners, key); keys are compared as text."""
    out = None
    for kind, (rows, partners, key) in checks.items():
        lost = rows.select(key).distinct().join(partners.select(key).distinct(), key, "left_anti").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
        out = lost if out is None else out.unionByName(lost)
    return out


def index_consistency(documents: DataFrame, indexes: dict[str, DataFrame]) -> DataFrame:
    """(index, n_documents, n_indexed, missing, surplus, verdict) for each index of doc_ids."""
    out = None
    for name, ids in indexes.items():
        both = documents.select("doc_id", F.lit(1).alias("d")).join(ids.select("doc_id", F.lit(1).alias("i")).distinct(), "doc_id", "full")
        row = both.agg(F.count("d").alias("n_documents"), F.count("i").alias("n_indexed"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("d").isNull()).alias("surplus")).withColumn("index", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("verdict", F.when((F.col("missing") == 0) & (F.col("surplus") == 0), "consistent").when(F.col("n_indexed") == 0, "rebuild").otherwise("repair"))


def distinct_by_canonical(values: DataFrame, key: str = "id") -> DataFrame:
    """values: id, pos, value. Each value once by its canonical form, in order of first appearance."""
    from ..functions.columns import canonical_entity

    first = values.withColumn("__c", canonical_entity(F.col("value"))).groupBy(key, "__c").agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("items"))

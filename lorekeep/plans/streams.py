"""Queries that run the streaming forms over the given tables as file streams, each until its input is used up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams
from .fixtures import table
from .recall import query


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-lorekeep-')}"
    return f"{base}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _source(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("user_id").cast("string").alias("sender_id"), F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"), F.col("event_type").alias("content"), F.col("ts").cast("timestamp").alias("ts"))


def _run(out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream to the end of its input into Parquet files, and reads them."""
    spark = out.sparkSession
    folder = _folder(spark)
    out.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("select count(*) as n, count(distinct event_id) as n_ids from events")
def stream_dedup(spark, sf_dir):
    twice = _messages(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return _run(streams.deduplicated(twice, "400 days")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


#: Append mode gives what ends before the last watermark, an hour before the newest event, in milliseconds.
_MARK = "(select floor(epoch_us(max(ts)) / 1000) * 1000 - 3600000000 from events)"
#: Stretches of activity of a user that end with six hours of rest, in microseconds.
_STRETCHES = """with e as (select user_id, event_type, epoch_us(ts) as t from events), o as (select *, case when t - lag(t) over w <= 21600000000 then 0 else 1 end as opens from e window w as (partition by user_id order by t)),
g as (select *, sum(opens) over (partition by user_id order by t rows unbounded preceding) as g from o), st as (select user_id, g, min(t) as a, max(t) + 21600000000 as b, count(*) as n, count(*) filter (event_type = 'view') as rounds from g group by all)"""


def _seconds(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({x: F.unix_micros(x) / 1e6 for x in names})


@query(_STRETCHES + f" select 's' || user_id as session_id, a / 1e6 as started, b / 1e6 as ended, rounds, n from st where rounds >= 1 and b <= {_MARK}")
def stream_idle_sessions(spark, sf_dir):
    return _seconds(_run(streams.idle_sessions(_messages(spark, sf_dir), "6 hours", 1, "1 hour")), "started", "ended")


@query(f"with w as (select 's' || user_id as session_id, epoch_us(ts) // 21600000000 * 21600000000 as a, count(*) as n from events group by all) select a / 1e6 as started, session_id, n from w where a + 21600000000 <= {_MARK}")
def stream_activity(spark, sf_dir):
    return _seconds(_run(streams.activity(_messages(spark, sf_dir), "6 hours", None, "1 hour")), "started")


@query(_STRETCHES + f" select user_id as memory_space_id, a / 1e6 as started, n from st where b <= {_MARK}")
def stream_time_clusters(spark, sf_dir):
    e = _source(spark, sf_dir, "events").select(F.col("user_id").alias("memory_space_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _seconds(_run(streams.time_clusters(e)), "started")


@query("""with c as (select event_id as sequence, user_id as scope, event_type as timeline_uid, case event_type when 'error' then 'delete' else 'upsert' end as operation, value from events)
select scope, timeline_uid, sequence, operation, value from c where operation <> 'delete' qualify row_number() over (partition by scope, timeline_uid order by sequence desc) = 1""")
def stream_projection(spark, sf_dir):
    e = _source(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), F.col("user_id").alias("scope"), F.col("event_type").alias("timeline_uid"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"), "value")
    folder = _folder(spark)
    q = streams.fold_projection(e, folder, f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return streams.projected(spark, folder, q.lastProgress["batchId"])


@query()
def continuation_cuts(spark, sf_dir):
    """The batch form: sessions are cut where a dialogue unit's vector leaves its topic."""
    from ..operators import sessions

    units = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s"), (F.col("vec_id") % 20).cast("string")).alias("session_id"), F.col("vec_id").alias("unit"), "embedding")
    return sessions.continuation_cuts(units, 4, 8, 0.2)

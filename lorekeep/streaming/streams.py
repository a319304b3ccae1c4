"""Structured Streaming forms: deduplication, session state, idle triggers, topic cuts, projection folds.

Event time is `ts`; late rows beyond the watermark are dropped, which each function states by its arguments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tables import fold_changes


def dedup_key() -> Column:
    """The message id, else a hash of session, sender, time and content."""
    return F.coalesce(F.col("id").cast("string"), F.sha1(F.concat_ws("\x1f", "session_id", "sender_id", F.col("ts").cast("string"), "content")))


def deduplicated(messages: DataFrame, ttl: str = "5 minutes") -> DataFrame:
    return messages.withColumn("dedup_key", dedup_key()).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["dedup_key"])


def session_state(messages: DataFrame) -> DataFrame:
    """Running count, last activity and number of participants; update mode."""
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max("ts").alias("last_active"), F.size(F.collect_set("sender_id")).alias("n_participants"))


def idle_sessions(messages: DataFrame, gap: str = "30 minutes", rounds: int = 3, late: str = "10 minutes") -> DataFrame:
    """Stretches of activity that ended with a gap and hold enough user messages; append mode emits each once."""
    return messages.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count_if(F.col("role") == "user").alias("rounds"), F.count("*").alias("n")).where(F.col("rounds") >= rounds).select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "rounds", "n")


def activity(messages: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    return messages.withWatermark("ts", late).groupBy(F.window("ts", window, slide or window).alias("w"), "session_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "session_id", "n")


def time_clusters(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Point events of a space, clustered by the gap."""
    return events.withWatermark("ts", late).groupBy("memory_space_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("memory_space_id", F.col("w.start").alias("started"), "n")


def round_cuts(units: DataFrame, rounds: int = 10, force: int = 20, threshold: float = 0.55, idle_ms: int = 30 * 60 * 1000, late: str = "10 minutes") -> DataFrame:
    """Cuts sessions as units arrive (session_id, unit, embedding, ts), by the rule of the batch form. The state is one open window of at
    most `force` units; a session closes its window when the watermark passes its last unit by the idle time. Times are event times, so a
    run over a finished input ends by itself."""
    import numpy as np
    import pandas as pd

    names = ["session_id", "first_unit", "last_unit", "reason"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, vectors = (list(state.get[0]), [np.array(v) for v in state.get[1]]) if state.exists else ([], [])
        rows = []

        def close(reason: str) -> None:
            rows.append((key[0], opened[0], opened[-1], reason))
            opened.clear()
            vectors.clear()

        if state.hasTimedOut:
            if opened:
                close("idle")
            state.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values("unit")  # what a trigger brings of one session, whatever its chunks
            for unit, e in pdf[["unit", "embedding"]].itertuples(index=False):
                v = np.asarray(e, float)
                v = v / (np.linalg.norm(v) or 1.0)
                if len(opened) >= rounds and max(float(v @ x) for x in vectors) < threshold:
                    close("topic_changed")
                opened.append(int(unit))
                vectors.append(v)
                if len(opened) >= force:
                    close("forced")
            state.update((opened, [v.tolist() for v in vectors]))
            last = int(pd.to_datetime(pdf["ts"]).max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return units.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(step, "session_id string, first_unit long, last_unit long, reason string", "units array<long>, vectors array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)


def fold_projection(events: DataFrame, path: str, checkpoint: str):
    """Keeps the current state of a change log under path, one version a batch. A batch that is replayed writes the same version from the
    version before it, so nothing counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("sequence", "scope", "timeline_uid", "operation", "value")
        if number > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/log={number - 1}"))
        last = rows.groupBy("scope", "timeline_uid").agg(F.max_by(F.struct("sequence", "operation", "value"), "sequence").alias("s")).select("s.sequence", "scope", "timeline_uid", "s.operation", "s.value")
        last.write.mode("overwrite").parquet(f"{path}/log={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def projected(spark, path: str, number: int) -> DataFrame:
    """The state that fold_projection left with a batch."""
    return fold_changes(spark.read.parquet(f"{path}/log={number}"))

"""Messages and sessions: statistics, audits, dialogue units, time clusters, summary windows, clean-up.

messages: id, session_id, role, content, sender_id, ts_epoch. Sessions are keys, so windows run within a session; what a function
needs of a whole session is an aggregate, never a collected list, unless it says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c


def by_time() -> Window:
    return Window.partitionBy("session_id").orderBy("ts_epoch", "id")


def sender_counts(messages: DataFrame, role: str = "user") -> DataFrame:
    return messages.where(F.col("role") == role).groupBy("session_id", "sender_id").agg(F.count("*").alias("n"))


def session_rollup(messages: DataFrame) -> DataFrame:
    """A session's state, derived and never stored as a counter."""
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("ts_epoch").alias("created"),
        F.max("ts_epoch").alias("last_active"), F.array_sort(F.collect_set("sender_id")).alias("participants"),
    )


def session_audit(messages: DataFrame, summarised: DataFrame, memory_sessions: DataFrame) -> DataFrame:
    """Counts, pending messages and whether a session may be cleaned; sessions that only memories know are added with 0 messages;
    possible aliases are the other sessions of one bot, chat type and target. summarised: session_id, n_summarised."""
    real = session_rollup(messages).select("session_id", "message_count", "first_id", "last_id")
    known = real.unionByName(memory_sessions.select("session_id").distinct().join(real, "session_id", "left_anti").select("session_id", F.lit(0).cast("long").alias("message_count"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("last_id")))
    out = known.join(summarised, "session_id", "left").withColumn("n_summarised", F.least(F.coalesce("n_summarised", F.lit(0)), F.col("message_count")))
    parts = c.session_parts(F.col("session_id"))
    out = out.withColumn("pending", F.col("message_count") - F.col("n_summarised")).withColumn("safe_to_clean", (F.col("message_count") > 0) & (F.col("pending") == 0))
    out = out.withColumn("__p", parts)
    same = Window.partitionBy("__p.bot", "__p.chat_type", "__p.target")
    return out.withColumn("n_possible_aliases", F.when(F.col("__p.target").isNull(), 0).otherwise(F.count("*").over(same) - 1).cast("long")).drop("__p")


def count_drift(stored: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions whose stored count differs from the real one."""
    real = messages.groupBy("session_id").agg(F.count("*").alias("actual"))
    return stored.join(real, "session_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where(F.col("stored") != F.col("actual"))


def summarised_span(messages: DataFrame, progress: DataFrame) -> DataFrame:
    """Ids of the oldest n_summarised messages of each session."""
    ranked = messages.withColumn("__n", F.row_number().over(by_time())).join(progress, "session_id").where(F.col("__n") <= F.col("n_summarised"))
    return ranked.groupBy("session_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


def dialogue_units(messages: DataFrame) -> DataFrame:
    """Adds unit: one opens at each user message; messages before the first form unit 0."""
    opens = F.sum((F.col("role") == "user").cast("int"))
    return messages.withColumn("unit", opens.over(by_time().rowsBetween(Window.unboundedPreceding, 0)))


def unit_table(messages: DataFrame) -> DataFrame:
    """(session_id, unit, first_id, n_messages, anchor): the anchor is the unit's user message, else all its texts joined."""
    df = dialogue_units(messages)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts_epoch", "id", "content"))), lambda x: x["content"]), "\n")
    return df.groupBy("session_id", "unit").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n_messages"), F.coalesce(F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.struct("ts_epoch", "id"))), texts).alias("anchor")
    )


def fixed_windows(messages: DataFrame, progress: DataFrame, rounds: int = 10) -> DataFrame:
    """Summary windows of a number of units after the last summarised index: (session_id, window, start_index, end_index, n_units)."""
    placed = messages.withColumn("__i", F.row_number().over(by_time()) - 1).join(progress, "session_id", "left")
    df = dialogue_units(placed.where(F.col("__i") >= F.coalesce("n_summarised", F.lit(0))))
    df = df.withColumn("window", F.floor(F.greatest(F.col("unit") - 1, F.lit(0)) / rounds))
    return df.groupBy("session_id", "window").agg(F.min("__i").alias("start_index"), (F.max("__i") + 1).alias("end_index"), F.countDistinct("unit").alias("n_units"))


def next_window(windows: DataFrame, finished: DataFrame) -> DataFrame:
    """The first window that ends after the finished end (session_id, completed_end)."""
    w = Window.partitionBy("session_id").orderBy("end_index", "start_index")
    later = windows.join(finished, "session_id", "left").where(F.col("end_index") > F.coalesce("completed_end", F.lit(0)))
    return later.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n", "completed_end")


def time_clusters(spans: DataFrame, gap_seconds: float = 6 * 3600.0) -> DataFrame:
    """spans: memory_space_id, memory_id, start_s, end_s. Adds cluster, the first member's id: a new one opens where the start is more than
    the gap after the latest end so far; a span without a start is a cluster of its own."""
    order = Window.partitionBy("memory_space_id").orderBy("start_s", "memory_id")
    end = F.coalesce("end_s", "start_s")
    dated = spans.where(F.col("start_s").isNotNull())
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    dated = dated.withColumn("__open", F.when(before.isNull() | (F.col("start_s") - before > gap_seconds), F.col("memory_id")))
    dated = dated.withColumn("cluster", F.last("__open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")
    return dated.unionByName(spans.where(F.col("start_s").isNull()).withColumn("cluster", F.col("memory_id")))


def continuation_cuts(units: DataFrame, rounds: int = 10, force: int = 20, threshold: float = 0.55) -> DataFrame:
    """Cuts a session where its topic ends: after `rounds` units a window goes on while the newest unit's best cosine to an earlier one
    reaches the threshold, is cut before it otherwise, and is forced at `force`.

    units: session_id, unit, embedding. The scan is sequential in a session; its state is one open window of at most `force` units.
    Returns session_id, window, first_unit, last_unit, reason."""
    import numpy as np

    def cut(pdf):
        import pandas as pd

        pdf = pdf.sort_values("unit")
        rows, window, open_units, vectors = [], 0, [], []

        def close(reason):
            nonlocal window, open_units, vectors
            rows.append((pdf["session_id"].iloc[0], window, open_units[0], open_units[-1], reason))
            window, open_units, vectors = window + 1, [], []

        for unit, e in zip(pdf["unit"], pdf["embedding"], strict=True):
            v = np.asarray(e, float)
            v = v / (np.linalg.norm(v) or 1.0)
            if len(open_units) >= rounds and max(float(v @ x) for x in vectors) < threshold:
                close("topic_changed")
            open_units.append(unit)
            vectors.append(v)
            if len(open_units) >= force:
                close("forced")
        if open_units:
            close("open")
        return pd.DataFrame(rows, columns=["session_id", "window", "first_unit", "last_unit", "reason"])

    return units.groupBy("session_id").applyInPandas(cut, "session_id string, window int, first_unit long, last_unit long, reason string")


def provisional_topics(units: DataFrame, floor: float = 0.72) -> DataFrame:
    """(session_id, n_topics): greedy centres, a unit below the floor to all of them is a new one. Sequential in a session; the
    state is its centres."""
    import numpy as np

    def count(pdf):
        import pandas as pd

        centres = []
        for e in pdf.sort_values("unit")["embedding"]:
            v = np.asarray(e, float)
            v = v / (np.linalg.norm(v) or 1.0)
            if not centres or max(float(v @ x) for x in centres) < floor:
                centres.append(v)
        return pd.DataFrame({"session_id": [pdf["session_id"].iloc[0]], "n_topics": [len(centres)]})

    return units.groupBy("session_id").applyInPandas(count, "session_id string, n_topics long")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The newest n of each session, with place from 1 in time order."""
    down = Window.partitionBy("session_id").orderBy(F.col("ts_epoch").desc(), F.col("id").desc())
    return messages.withColumn("__n", F.row_number().over(down)).where(F.col("__n") <= n).withColumn("place", F.row_number().over(by_time())).drop("__n")


def message_slice(messages: DataFrame, offset: int, limit: int) -> DataFrame:
    return messages.withColumn("__n", F.row_number().over(by_time())).where(F.col("__n").between(offset + 1, offset + limit)).drop("__n")


def search_messages(messages: DataFrame, keyword: str, per_session: int) -> DataFrame:
    """Newest hits of each session; only ASCII letters match regardless of case."""
    down = Window.partitionBy("session_id").orderBy(F.col("ts_epoch").desc(), F.col("id").desc())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fold = str.maketrans(upper, upper.lower())
    hits = messages.where(F.translate("content", upper, upper.lower()).contains(keyword.translate(fold)))
    return hits.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= per_session)


def idle_sessions(messages: DataFrame, cutoff: float) -> DataFrame:
    return session_rollup(messages).where((F.col("last_active") <= cutoff) & (F.col("message_count") > 0)).select("session_id", "message_count", "last_active")


def split_expired(messages: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) messages, by their session's last activity."""
    old = session_rollup(messages).where(F.col("last_active") < cutoff).select("session_id")
    return messages.join(old, "session_id", "left_anti"), messages.join(old, "session_id", "left_semi")


def clean_injected(messages: DataFrame, begin: str = "<memory>", end: str = "</memory>") -> DataFrame:
    """Removes marked blocks from content and collapses blank lines; status tells untouched, cleaned and emptied texts."""
    import re

    cut = F.regexp_replace("content", f"(?s){re.escape(begin)}.*?{re.escape(end)}", "")
    cut = F.when(cut == F.col("content"), F.col("content")).otherwise(F.trim(F.regexp_replace(cut, r"\n\s*\n+", "\n")))
    out = messages.withColumn("cleaned", cut)
    return out.withColumn("status", F.when(F.col("cleaned") == F.col("content"), "untouched").when(F.col("cleaned") == "", "emptied").otherwise("cleaned"))


def messages_of_spans(spans: DataFrame, messages: DataFrame) -> DataFrame:
    """All messages of each memory's id span (memory_id, session_id, a, b), whichever end is larger."""
    m = messages.select("session_id", "id", "role", "content", "ts_epoch")
    return spans.join(m, "session_id").where(F.col("id").between(F.least("a", "b"), F.greatest("a", "b")))


def snapshots(memories: DataFrame, messages: DataFrame, floor: float = 0.8) -> DataFrame:
    """Source messages of important memories as one nested row each; a span's length bounds the array."""
    found = messages_of_spans(memories.where(F.col("importance") >= floor).select("memory_id", "session_id", "a", "b"), messages)
    return found.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("id", "role", "content"))).alias("messages"))


def identity_audit(messages: DataFrame) -> DataFrame:
    """(code, n): anomalies in the senders of messages."""
    r, s = F.col("role"), F.coalesce(F.col("sender_id"), F.lit(""))
    codes = F.array_compact(F.array(
        F.when(s == "", "missing_sender"), F.when((r == "assistant") & ~s.startswith("bot"), "assistant_with_user_id"), F.when((r == "user") & s.startswith("bot"), "user_with_bot_id"),
        F.when(~r.isin("user", "assistant", "system"), "unknown_role"), F.when(F.coalesce(F.col("session_id"), F.lit("")) == "", "missing_session"),
    ))
    return messages.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def trim_plan(messages: DataFrame, progress: DataFrame, keep: int) -> DataFrame:
    """Messages that may go: the oldest beyond `keep`, but never unsummarised ones; if more are summarised than exist, none go."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    df = messages.withColumn("__i", F.row_number().over(by_time())).withColumn("__n", n).join(progress, "session_id", "left")
    done = F.when(F.coalesce("n_summarised", F.lit(0)) > F.col("__n"), 0).otherwise(F.coalesce("n_summarised", F.lit(0)))
    return df.where(F.col("__i") <= F.least(F.col("__n") - keep, done)).select("session_id", "id")


def resolve_aliases(aliases: DataFrame, rounds: int = 4) -> DataFrame:
    """alias_id -> canonical session by pointer jumping: each round doubles the hops, so 4 rounds cover 15; an alias that has not
    reached a root by then, for a longer chain or a cycle, maps to itself. aliases: alias_id, canonical_id, unique by alias_id."""
    at = aliases.select("alias_id", F.col("canonical_id").alias("to"))
    for _ in range(rounds):
        step = at.select(F.col("alias_id").alias("to"), F.col("to").alias("__next"))
        at = at.join(step, "to", "left").select("alias_id", F.coalesce("__next", "to").alias("to"))
    roots = at.join(aliases.select(F.col("alias_id").alias("to"), F.lit(True).alias("__more")), "to", "left")
    return roots.select("alias_id", F.when(F.col("__more"), F.col("alias_id")).otherwise(F.col("to")).alias("canonical_id"))


def range_overlap_join(items: DataFrame, ranges: DataFrame, bucket: int | None = None) -> DataFrame:
    """items (item_id, s, e) and ranges (range_id, lo, hi) that meet, in seconds: both are dealt to time buckets and meet there by
    equality; a pair is kept in the first bucket that both reach, so none appears twice. Without a bucket it is as long as the mean span
    of both sides (a second at least), so the pairs that meet in a bucket are few beside those found, and a row is in some buckets only, unless spans differ widely."""
    if bucket is None:
        spans = items.select((F.col("e") - F.col("s")).alias("x")).unionByName(ranges.select((F.col("hi") - F.col("lo")).alias("x")))
        bucket = max(1, math.ceil(spans.where("x >= 0").agg(F.avg("x")).first()[0] or 0))
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    left = items.withColumn("__b", cover("s", "e"))
    right = ranges.withColumn("__b", cover("lo", "hi"))
    met = left.join(right, "__b").where((F.col("s") <= F.col("hi")) & (F.col("e") >= F.col("lo")))
    return met.where(F.col("__b") == F.greatest(F.floor(F.col("s") / bucket), F.floor(F.col("lo") / bucket))).drop("__b")


def role_bindings(messages: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct actors and observed names of each source window (session_id, window, a, b); flags a window whose assistant and human
    share a name."""
    inside = windows.join(messages, "session_id").where(F.col("id").between(F.col("a"), F.col("b")))
    human, bot = F.collect_set(F.when(F.col("role") == "user", F.col("sender_id"))), F.collect_set(F.when(F.col("role") == "assistant", F.col("sender_id")))
    return inside.groupBy("session_id", "window").agg(F.size(human).alias("n_humans"), F.size(bot).alias("n_bots"), F.arrays_overlap(human, bot).alias("ambiguous"), F.min(F.when(F.col("role") == "assistant", F.col("sender_id"))).alias("narrator"))


def known_person(messages: DataFrame, people: DataFrame) -> DataFrame:
    """The person behind (platform, user id), case folded; a person without a platform matches any, the more exact entry wins.
    people: person_id, platform, user_id."""
    m = messages.withColumn("__u", F.lower("sender_id")).withColumn("__p", c.canonical_platform(F.col("platform")))
    p = people.select("person_id", F.lower("user_id").alias("__u"), c.canonical_platform(F.coalesce("platform", F.lit(""))).alias("__p"))
    exact = m.join(p.where(F.col("__p") != ""), ["__u", "__p"]).select("id", "person_id", F.lit(0).alias("__o"))
    wild = m.join(p.where(F.col("__p") == "").drop("__p"), "__u").select("id", "person_id", F.lit(1).alias("__o"))
    best = Window.partitionBy("id").orderBy("__o", "person_id")
    return exact.unionByName(wild).withColumn("__n", F.row_number().over(best)).where(F.col("__n") == 1).select("id", "person_id")


def list_memories(memories: DataFrame, sort: Column, limit: int, offset: int = 0, status: str = "active", keyword: str | None = None) -> DataFrame:
    found = memories.where(F.col("status") == status)
    if keyword:
        found = found.where(F.col("text").contains(keyword))
    return found.orderBy(sort, "doc_id").offset(offset).limit(limit)


def event_anchor(df: DataFrame) -> DataFrame:
    """Adds anchor_s and basis: source window, else the fact's times, else creation."""
    pairs = [("window_start", "source_window"), ("temporal_start", "temporal"), ("create_epoch", "create_time")]
    anchor = F.coalesce(*[F.when(F.col(x) > 0, F.struct(F.col(x).cast("double").alias("s"), F.lit(b).alias("b"))) for x, b in pairs])
    return df.withColumn("__a", anchor).withColumn("anchor_s", F.col("__a.s")).withColumn("basis", F.col("__a.b")).withColumn("fallback", F.col("basis") == "create_time").drop("__a")

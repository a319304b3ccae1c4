"""Times of facts: event times written in text, evidence windows, anchors bound into a memory's text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits, days by word, weekdays, weeks by prefix, seconds by unit, and the hours below which a part of the day means the afternoon.
DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
DAYS = {"大后天": 3, "前天": -2, "昨天": -1, "今天": 0, "明天": 1, "后天": 2}
WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
WEEKS = {"上周": -7, "本周": 0, "下周": 7, "下下周": 14}
UNITS = {"分钟": 60, "小时": 3600, "天": 86400, "周": 604800, "个月": 30 * 86400, "年": 365 * 86400}
SIDES = {"前": -1, "后": 1}
AFTERNOON_BELOW = {"下午": 12, "晚上": 12, "中午": 11}
#: The forms of dates, spans, weekdays and clock times that count.
DATE = r"(20[0-9]{2})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})"
SPAN = r"([一二两三四五六七八九十0-9]+)\s*(分钟|小时|天|周|个月|年)(前|后)"
WEEKDAY = r"(上周|本周|下周|下下周)?周([一二三四五六日天])"
MONTH_DAY = r"([0-9]{1,2})月([0-9]{1,2})[日号]"
CLOCK = r"(?:(上午|早上|中午|下午|晚上|凌晨)\s*)?([一二两三四五六七八九十0-9]+)\s*[:：点时]\s*([一二两三四五六七八九十0-9]+)?"
#: Weekdays as people mean them: one 周 is enough behind a prefix.
PLAIN_WEEKDAY = r"(上|本|下下|下)?周?周([一二三四五六日天])"


def number(text: Column) -> Column:
    """Digits or a Chinese number up to 99; null for anything else."""
    digits = F.translate(text, "".join(DIGITS), "".join(str(v) for v in DIGITS.values()))
    # 十 stands for a one in front, a zero behind, and for nothing between two digits
    for pattern, to in ((r"^十", "1十"), (r"十$", "十0"), (r"^([0-9])十([0-9])$", "$1$2")):
        digits = F.regexp_replace(digits, pattern, to)
    return digits.try_cast("int")


def _of(values: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


@dataclass(frozen=True)
class Phrase:
    """A way to name a day: its pattern, the seconds since 1970 on the local clock that its groups mean, and the text in which a time of day may stand."""

    pattern: str
    seconds: Callable[[Callable[[int], Column], Column], Column]
    clock: Callable[[Column], Column]
    final: bool = False  # a match that means no time ends the search


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d")))


def phrases(natural_weeks: bool = False) -> list[Phrase]:
    """The ways to name a day, in the order in which they are tried."""
    behind = lambda pattern: lambda text: F.regexp_replace(text, f"^.*?{pattern}", "")
    whole, nothing = (lambda text: text), (lambda text: F.lit(""))
    weeks = {k[:-1]: v for k, v in WEEKS.items()} if natural_weeks else WEEKS
    today = lambda ref: F.unix_timestamp(ref)
    listed = lambda g: F.get(F.filter(F.array(*map(F.lit, DAYS)), lambda w: F.contains(g(0), w)), F.lit(0))  # noqa: E731  the first of the list, wherever it stands
    return [
        Phrase(DATE, lambda g, ref: _day(g(1), g(2), g(3)), behind(DATE), final=True),
        Phrase(SPAN, lambda g, ref: today(ref) + number(g(1)) * _of(UNITS, g(2)) * _of(SIDES, g(3)), nothing),
        Phrase("|".join(DAYS), lambda g, ref: today(ref) + _of(DAYS, listed(g)) * 86400, whole),
        Phrase(PLAIN_WEEKDAY if natural_weeks else WEEKDAY, lambda g, ref: today(ref) + (_of(WEEKDAYS, g(2)) - F.weekday(ref) + F.coalesce(_of(weeks, g(1)), F.lit(0))) * 86400, whole),
        Phrase(MONTH_DAY, lambda g, ref: _day(F.year(ref).cast("string"), g(1), g(2)), behind(MONTH_DAY), final=True),
    ]


def _groups(text: Column, pattern: str) -> Callable[[int], Column]:
    return lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) if k else text


def clock_seconds(text: Column) -> Column:
    """Seconds of the day of the first clock time in a text; null if there is none or it is none of a day."""
    g = _groups(text, CLOCK)
    hour, minute = number(g(2)), F.coalesce(number(g(3)), F.lit(0))
    hour = hour + F.when(hour < _of(AFTERNOON_BELOW, g(1)), 12).when((g(1) == "凌晨") & (hour == 12), -12).otherwise(0)
    return F.when(hour.between(0, 23) & minute.between(0, 59), hour * 3600 + minute * 60)


def event_time(text: Column, reference: Column, zone: str, natural_weeks: bool = False) -> Column:
    """Timestamp of the event that a text names, anchored at the reference timestamp; null if it names none.

    The phrases are tried in their order; a month is 30 days, a year 365. The zone is that of the people talking. A prefix of a week counts as
    it is written in WEEKDAY, so 下周周一 is next week and 下周一 this one; with natural_weeks both are next week."""
    t = F.coalesce(text, F.lit(""))
    there = F.from_utc_timestamp(reference, zone)
    readings = []
    for phrase in phrases(natural_weeks):
        day = phrase.seconds(_groups(t, phrase.pattern), there)
        fits = t.rlike(phrase.pattern) if phrase.final else t.rlike(phrase.pattern) & day.isNotNull()
        readings.append(F.when(fits, F.struct(day.cast("long").alias("day"), phrase.clock(t).alias("clock"))))
    found = F.coalesce(*readings)
    day, at = found["day"], clock_seconds(found["clock"])
    local = F.when(at.isNotNull(), F.floor(day / 86400).cast("long") * 86400 + at).otherwise(day)
    return F.to_utc_timestamp(F.timestamp_seconds(local), zone)


def fact_windows(facts: DataFrame, refs: DataFrame, messages: DataFrame) -> DataFrame:
    """facts: memory_id, fact, window_start_s, window_end_s; refs: memory_id, fact, message_id; messages: id, ts_epoch. Evidence from the
    first to the last message that a fact names; the source window where it names none. Times of 0 or less are missing, and reversed
    windows are turned round."""
    seen = refs.join(messages.select(F.col("id").alias("message_id"), "ts_epoch"), "message_id").where("ts_epoch > 0").groupBy("memory_id", "fact").agg(F.min("ts_epoch").alias("lo"), F.max("ts_epoch").alias("hi"), F.count("*").alias("n_refs"))
    dated = lambda x: F.when(F.col(x) > 0, F.col(x))
    a, b = dated("window_start_s"), dated("window_end_s")
    df = facts.join(seen, ["memory_id", "fact"], "left")
    basis = F.when(F.col("lo").isNotNull(), "messages").when(F.coalesce(a, b).isNotNull(), "source_window").otherwise("none")
    return df.select("memory_id", "fact", F.coalesce("lo", F.least(a, b)).alias("start_s"), F.coalesce("hi", F.greatest(a, b)).alias("end_s"), basis.alias("basis"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def temporal_rollup(facts: DataFrame, by: list[str]) -> DataFrame:
    """Span of the facts' evidence, with their one basis or "mixed_sources"."""
    out = facts.groupBy(*by).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_sort(F.collect_set("basis")).alias("__b"))
    return out.withColumn("basis", F.when(F.size("__b") == 1, F.get("__b", 0)).otherwise("mixed_sources")).drop("__b")


def bind_anchors(memories: DataFrame, facts: DataFrame, zone: str = "UTC") -> DataFrame:
    """memories: memory_id, text; facts: memory_id, pos, fact, start_s. A fact that the text contains gets its date behind its first
    occurrence; the others follow the text, one a line. A memory's facts bound the arrays."""
    date = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("start_s"), zone), "yyyy-MM-dd")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact", "__d"))), lambda x: F.struct(x["fact"], x["__d"]))
    listed = facts.withColumn("__d", F.coalesce(F.concat(F.lit(" ["), date, F.lit("]")), F.lit(""))).groupBy("memory_id").agg(rows.alias("__f"))
    df = memories.join(listed, "memory_id", "left").withColumn("__f", F.coalesce("__f", F.array().cast("array<struct<fact:string,__d:string>>")))

    def put(text: Column, f: Column) -> Column:
        at = F.instr(text, f["fact"])
        end = at + F.length(f["fact"])
        return F.when((at > 0) & (F.length(f["fact"]) > 0), F.concat(F.substr(text, F.lit(1), end - 1), f["__d"], F.substr(text, end))).otherwise(text)

    inside = F.aggregate("__f", F.coalesce("text", F.lit("")), put)
    apart = F.transform(F.filter("__f", lambda f: ~F.contains(F.coalesce("text", F.lit("")), f["fact"])), lambda f: F.concat(F.lit("- "), f["fact"], f["__d"]))
    return df.select("memory_id", F.array_join(F.concat(F.array(inside), apart), "\n").alias("bound"))

"""Column functions: text, scores, decay, time spans, names. All are built-in expressions; none runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters removed before tokenising, besides ASCII punctuation.
WIDE_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～、〃《》「」『』【】–—‘’“”„‟…‧﹏·・•"
ASCII_PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
EMPTY_FEATURE = "<empty>"


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0, default: float = 0.0) -> Column:
    """Null or NaN gives the default; then the bounds hold."""
    value = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(default)).otherwise(x.cast("double"))
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def tokenize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Tokens in order, repeats kept: URLs, @names, #tags and punctuation go; Chinese characters stand alone; other text splits at
    spaces; single ASCII characters and stop words go. Case is kept."""
    t = F.coalesce(text, F.lit(""))
    for pattern in (r"https?://[^\s]+", r"www\.[^\s]+", r"@[A-Za-z0-9_À-ɏ一-鿿]+", r"#[A-Za-z0-9_À-ɏ一-鿿]+", ASCII_PUNCTUATION, f"[{WIDE_PUNCTUATION}]"):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, "([一-鿿])", " $1 ")
    kept = F.filter(F.split(t, r"\s+"), lambda x: (F.length(x) > 1) | x.rlike("[^\\x00-\\x7f]"))
    if stop_words:
        return F.filter(kept, lambda x: ~x.isin(stop_words))
    return kept


def retrieval_features(text: Column) -> Column:
    """Distinct latin words of two characters or more and Chinese bigrams (a lone character stands for itself)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(t, F.lit("[a-z0-9_]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit("[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2))))))
    both = F.array_distinct(F.concat(words, pairs))
    return F.when(F.size(both) == 0, F.array(F.lit(EMPTY_FEATURE))).otherwise(both)


def lexical_tokens(text: Column) -> Column:
    """Distinct latin words of two characters or more and Chinese bigrams (a lone character stands for itself), from U+3400 on; none for no words."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[㐀-鿿]+|[a-z0-9_]+"), F.lit(0)))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))
    # a run is of one script, and all latin ones sort before the Chinese
    each = lambda r: F.when((r >= "㐀") & (F.length(r) > 1), pairs(r)).when((r >= "㐀") | (F.length(r) > 1), F.array(r)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(runs, each)))


def canonical_text(text: Column) -> Column:
    """Lower case, letters and digits only (input is taken as NFKC already)."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def canonical_entity(text: Column) -> Column:
    """Edge punctuation cut, spaces collapsed, lower case if all ASCII."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s!-/:-@\[-`{-~，。！？、；：]+|[\s!-/:-@\[-`{-~，。！？、；：]+$", "")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(t)


def fingerprint(text: Column) -> Column:
    return F.sha2(canonical_text(text), 256)


def stable_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def name_uuid(name: Column) -> Column:
    """The UUID of version 5 of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), part(18, 3)), part(21, 12))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) < 1) | (F.size(b) < 1), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def overlap_share(a: Column, b: Column) -> Column:
    """Shared terms over the size of the smaller set."""
    return F.when((F.size(a) < 1) | (F.size(b) < 1), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different sizes or a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def unit(v: Column) -> Column:
    """The vector divided by its norm, in doubles; a zero vector stays."""
    # bound as a lambda's argument, the norm is computed once a vector, not once an element
    divided = F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))
    return divided[0]


def fit_content(text: Column, budget: int, mark: str = "\n…\n") -> Column:
    """Head and tail of a text over the budget, in code points, with a mark between."""
    room = budget - len(mark)
    head, tail = (room + 1) // 2, room // 2
    cut = F.concat(F.substr(text, F.lit(1), F.lit(head)), F.lit(mark), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= budget, text).otherwise(cut)


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Whether [start, end] meets [lo, hi]: one null end copies the other, two give false, reversed ends are swapped."""
    s, e = F.coalesce(start, end), F.coalesce(end, start)
    return F.coalesce((F.least(s, e) <= hi) & (F.greatest(s, e) >= lo), F.lit(False))


def interval_affinity(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over union of two closed intervals of seconds, one second added to each length."""
    shared = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    return shared / (F.greatest(e1, e2) - F.least(s1, s2) + 1)


def interval_proximity(s1: Column, e1: Column, s2: Column, e2: Column, half_life: float) -> Column:
    return F.exp(-F.greatest(F.lit(0.0), F.greatest(s1, s2) - F.least(e1, e2)) / F.lit(half_life))


def minute_distance(a: Column, b: Column) -> Column:
    """Between two minutes of the day, around midnight."""
    d = F.abs(a - b)
    return F.least(d, 1440 - d)


def minute_of_day(ts: Column, zone: str) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local)


def decay_score(kind: Column, ttl_days: Column, days: Column) -> Column:
    """Linear to zero at the TTL; step to 0.05 beyond it; else exponential with half the TTL as half-life."""
    ttl, age = F.greatest(F.lit(1.0), ttl_days.cast("double")), F.greatest(F.lit(0.0), days.cast("double"))
    exponential = F.exp(-F.log(F.lit(2.0)) * age / F.greatest(F.lit(0.5), ttl / 2))
    return F.when(kind == "linear", F.greatest(F.lit(0.0), 1 - age / ttl)).when(kind == "step", F.when(age <= ttl, 1.0).otherwise(0.05)).otherwise(exponential)


#: Days to live and decay by kind of fact.
TTL = {"episodic": (7, "exponential"), "planned": (2, "step"), "factual": (180, "exponential"), "relational": (90, "linear"), "preference": (60, "exponential"), "unknown": (30, "exponential")}


def ttl_days(kind: Column, importance: Column, reinforcements: Column, days_to_event: Column) -> Column:
    base = F.lit(float(TTL["unknown"][0]))
    for k, (days, _) in TTL.items():
        base = F.when(kind == k, float(days)).otherwise(base)
    base = F.when((kind == "planned") & days_to_event.isNotNull(), F.greatest(F.lit(0.0), days_to_event) + base).otherwise(base)
    return F.greatest(F.lit(1.0), base * (0.5 + clamp(importance)) * (1 + F.least(F.lit(0.5), reinforcements * 0.1)))


def ttl_decay(kind: Column) -> Column:
    out = F.lit("exponential")
    for k, (_, decay) in TTL.items():
        out = F.when(kind == k, decay).otherwise(out)
    return out


def topic_importance_now(base: Column, anchor: Column, accessed: Column, access_count: Column, now: float, rate: float = 0.01) -> Column:
    """Exponential decay since the later of anchor and last access, slowed by the number of accesses."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.greatest(anchor, F.coalesce(accessed, F.lit(0.0)))) / 86400)
    resistance = 1 + F.log1p(F.greatest(F.lit(0), access_count)) * 0.25
    return clamp(base * F.exp(F.lit(-rate) * age / resistance))


def topic_rank(relevance: Column, importance: Column, confidence: Column) -> Column:
    return F.least(F.lit(1.0), relevance * 0.82 + importance * 0.10 + clamp(confidence) * 0.08)


def importance_sort_key(importance: Column) -> Column:
    """Listings show importance on a scale of ten; values up to one are brought to it."""
    return F.when(importance <= 1, importance * 10).otherwise(importance)


def session_parts(session_id: Column) -> Column:
    """bot, chat type and target of bot:Type:target."""
    parts = F.split(session_id, ":", 3)
    kind = F.lower(F.get(parts, 1))
    chat = F.when(kind.contains("friend") | kind.contains("private"), "private").when(kind.contains("group"), "group").otherwise("unknown")
    return F.struct(F.get(parts, 0).alias("bot"), chat.alias("chat_type"), F.get(parts, 2).alias("target"))


def memory_space(session_id: Column, persona: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(session_id, F.lit("")), F.coalesce(persona, F.lit(""))), 256)


#: Canonical platform names and their spellings.
PLATFORMS = {
    "qq": ["qq", "aiocqhttp", "onebot", "onebot11", "qq_official", "qq_official_webhook"],
    "telegram": ["telegram", "telegram_bot", "telegrambot"],
    "discord": ["discord", "discord_bot", "discordbot"],
    "wechat": ["wechat", "weixin", "wechatpadpro"],
    "wecom": ["wecom", "wechat_work", "wechatwork"],
    "feishu": ["feishu", "lark"],
    "dingtalk": ["dingtalk", "ding_talk"],
    "slack": ["slack"],
}


def canonical_platform(name: Column) -> Column:
    """Lower case, anything else than letters and digits as one underscore; then the platform of that spelling, or of the longest spelling
    that it begins or ends with, parted by an underscore. Other names stay."""
    token = F.btrim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    spelled = [(s, k) for k, v in PLATFORMS.items() for s in v]
    longest = sorted(spelled, key=lambda x: len(x[0]), reverse=True)
    out = F.when(token == "", "")
    for spelling, known in spelled:
        out = out.when(token == spelling, known)
    for spelling, known in longest:
        out = out.when(token.startswith(spelling + "_") | token.endswith("_" + spelling), known)
    return out.otherwise(token)


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


STRUCTURAL_TERM = r"^(?:[0-9]+(?:[.:/-][0-9]+)*|(?:19|20)[0-9]{2}年?|[0-9]{1,2}[月日点时分])$"


def is_structural_term(term: Column) -> Column:
    """Dates, times and numbers, which say nothing about a topic."""
    return term.rlike(STRUCTURAL_TERM)

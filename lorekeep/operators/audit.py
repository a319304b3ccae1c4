"""Audits and evaluation: secrets, record quality, embeddings, orphans, retrieval scores, build comparison, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .retrieval import vector_top_k

#: Patterns of secrets and personal paths, by rule.
SECRETS = {
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "provider token": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "GitHub token": r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
    "bearer credential": r"(?i)\bBearer\s+[A-Za-z0-9._~-]{20,}",
    "assigned credential": r"(?i)\b(?:api[_-]?(?:key|token)|auth[_-]?token|password)\b\s*[:=]\s*[\"']([^\"'\s]{12,})[\"']",
    "credential in URL": r"https?://[^\s/:@]+:[^\s/@]+@[^\s/]+",
    "Windows user path": r"[A-Za-z]:\\Users\\(?![<{$%])[^\\\s]+",
    "home directory path": r"/home/(?![<{$%])[^/\s]+",
    "mounted user path": r"/mnt/[a-z]/(?![<{$%])[^/\s]+",
}
#: Our own further rules, for personal data in a corpus.
PERSONAL = {
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+\.[A-Za-z]{2,}",
    "phone": r"\+[0-9]{1,3} \(?[0-9]{3}\)? [0-9]{3}-[0-9]{4}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}


def scan_text(docs: DataFrame, denied: list[str] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, line, rule) for every line that a rule matches; a line with any of the denied words has the rule "local denylist" once."""
    hits = [F.when(F.col("text").rlike(v), k) for k, v in (SECRETS if rules is None else rules).items()]
    for x in [F.array_max(F.array(*[F.col("text").contains(d) for d in denied]))] if denied else []:
        hits.append(F.when(x, "local denylist"))
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))
    return lines.select("doc_id", (F.col("line") + 1).alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("rule"))


def record_issues(records: DataFrame) -> DataFrame:
    """records: doc_id, text, importance, key_facts. One row per broken rule: doc_id, code, severity."""
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    facts = F.coalesce("key_facts", F.array().cast("array<string>"))
    rule = lambda cond, code, severity: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    rules = F.array_compact(F.array(
        rule(size == 0, "missing_summary", "error"), rule(size.between(1, 9), "short_summary", "warning"),
        rule(F.coalesce(~F.col("importance").between(0, 1), F.lit(True)), "importance_domain", "error"), rule(F.size(facts) == 0, "no_facts", "warning"),
        rule(F.exists(facts, lambda x: F.trim(x) == ""), "empty_fact", "error"), rule(F.size(F.array_distinct(facts)) < F.size(facts), "duplicate_fact", "warning"),
    ))
    return records.select("doc_id", F.explode(rules).alias("r")).select("doc_id", "r.code", "r.severity")


def verdicts(records: DataFrame, issues: DataFrame) -> DataFrame:
    worst = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("n"))
    df = records.select("doc_id").join(worst, "doc_id", "left")
    return df.select("doc_id", F.when(F.col("errors") > 0, "reject").when(F.col("n") > 0, "review").otherwise("accept").alias("verdict"))


def embedding_reasons(vectors: DataFrame, provider: str, model: str, dimension: int) -> DataFrame:
    """vectors: id, embedding, provider, model. Adds reason, null for usable vectors."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x))
    reason = F.when(e.isNull() | (F.size(e) == 0), "missing").when(F.col("provider") != provider, "provider_changed").when(F.col("model") != model, "model_changed").when(F.size(e) != dimension, "dimension_changed").when(bad, "format_changed")
    return vectors.withColumn("reason", reason)


def embedding_health(vectors: DataFrame, by: str) -> DataFrame:
    return vectors.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("usable"), F.count_if(F.col("reason").isNotNull()).alias("unusable"))


def evaluate(results: DataFrame, judgements: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """results: query_id, doc_id, rank; judgements: doc_id, relevant, forbidden. Recall at k, top-1, MRR, forbidden hits, empty queries."""
    hit = results.where(F.col("rank") <= k).join(judgements, "doc_id", "left")
    per = hit.groupBy("query_id").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"), F.max((F.col("forbidden") == 1).cast("int")).alias("bad"), F.count("*").alias("n"))
    df = queries.select("query_id").join(per, "query_id", "left")
    return df.agg(F.count("*").alias("n_queries"), F.avg(F.col("first").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))).alias("top1"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.sum(F.coalesce("bad", F.lit(0))).alias("forbidden"), F.count_if(F.col("n").isNull()).alias("empty"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_results"))


def compare_builds(full: DataFrame, other: DataFrame) -> DataFrame:
    """Best cosine of each item (uid, embedding) of one build in the other: least, mean, count."""
    near = vector_top_k(other.select(F.col("uid").alias("doc_id"), "embedding"), full.select(F.col("uid").alias("query_id"), "embedding"), 1)
    return near.agg(F.count("*").alias("n"), F.min("score").alias("least"), F.avg("score").alias("mean"))


def trace_summary(traces: DataFrame) -> DataFrame:
    return traces.groupBy("trace_type", "status").agg(F.count("*").alias("n"), F.avg("elapsed_ms").alias("mean_ms"), F.percentile("elapsed_ms", F.lit(0.5)).alias("p50_ms"), F.percentile("elapsed_ms", F.lit(0.95)).alias("p95_ms"))


def health(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count("*").alias("n"))


#: Edits up to which fields meet by what is left when characters are deleted; pairs of more edits meet by bigrams.
DELETED = 2


def _deletions(x: str, edits: Column) -> Column:
    """The text and all that is left of it when up to `edits` (DELETED at most) characters are deleted."""
    less = lambda y: F.transform(F.sequence(F.lit(1), F.length(y)), lambda i: F.concat(F.substr(y, F.lit(1), i - 1), F.substr(y, i + 1)))
    none = F.array().cast("array<string>")
    level, levels = F.array(F.col(x)), [F.array(F.col(x))]
    for k in range(1, DELETED + 1):
        level = F.array_distinct(F.flatten(F.transform(level, lambda y: F.when(F.length(y) > 0, less(y)).otherwise(none))))
        levels.append(F.when(edits >= k, level).otherwise(none))
    return F.concat(*levels)


def near_fields(left: DataFrame, right: DataFrame, ratio: float = 0.86) -> DataFrame:
    """Pairs (a, b) of one scope whose field is equal, canonically equal, or near by 1 - levenshtein / longest. left, right: scope, id, field.

    Two fields of d edits have an equal rest when each loses up to d characters, so fields whose partners are at most DELETED edits away meet by such rests, which hardly
    any others share. Pairs of fields so long that more edits are near share a bigram, whichever, and differ little in length."""
    grams = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: x.substr(i, F.lit(2))))
    # the most edits that a partner of the field, no longer than length / ratio and than any field, may be away
    key = lambda df, n: df.select("scope", F.col("id").alias(n), F.col("field").alias(f"f{n}"), c.canonical_text(F.col("field")).alias(f"c{n}"))
    a, b = key(left, "a"), key(right, "b")
    longest = max(df.agg(F.max(F.length(x))).first()[0] or 0 for df, x in ((a, "ca"), (b, "cb")))
    edits = lambda x: F.floor((1 - ratio) * F.least(F.lit(longest), F.floor(F.length(x) / ratio + 1e-9)) + 1e-9)
    exact = a.join(b, (a["scope"] == b["scope"]) & (a["ca"] == b["cb"])).select(a["scope"], "a", "b", F.when(F.col("fa") == F.col("fb"), "equal").otherwise("canonical").alias("tier"))
    rests = lambda df, x: df.where(edits(x) > 0).select("*", F.explode(F.array_distinct(F.transform(_deletions(x, edits(x)), lambda y: F.xxhash64(y)))).alias("g"))
    bigrams = lambda df, x: df.where(edits(x) > DELETED).withColumn("g", F.explode(grams(F.col(x))))
    close: Column = 1 - F.levenshtein("ca", "cb") / F.greatest(F.length("ca"), F.length("cb"))
    out = exact
    for side in [rests, bigrams] if (1 - ratio) * longest + 1e-9 >= DELETED + 1 else [rests]:
        # merge: a table's estimate knows nothing of its rests, and a broadcast would take them all through the driver
        met = side(a, "ca").drop("fa").hint("merge").join(side(b, "cb").drop("fb"), ["scope", "g"]).where((F.col("ca") != F.col("cb")) & (F.least(F.length("ca"), F.length("cb")) >= ratio * F.greatest(F.length("ca"), F.length("cb"))))
        near = met.where(close >= ratio).select("scope", "a", "b", F.lit("near").alias("tier"))
        out = out.unionByName(near.distinct() if side is rests else near.distinct().join(out.where("tier = 'near'"), ["scope", "a", "b"], "left_anti"))
    return out

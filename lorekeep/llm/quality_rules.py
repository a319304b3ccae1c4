"""Operator 9: rule bitmask ledger.

`ledger` evaluates every rule of RULES once per document and stores the measurements and one long of failure bits.
`apply_policy` is then a bit test against a versioned mask, and `ablation` one bitwise aggregation over the ledger: neither
reads a text again. All columns are Spark expressions; no row leaves the JVM and nothing but the ledger is shuffled.

Defined results: a null or empty text has no words, so all counts are 0 and the base rules fail it; a null doc_id stays null;
repeated rows give repeated ledger rows; other columns of the input are ignored. Memory: one document's words at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WORD, documents

#: Rules by bit: (name, condition under which a document fails). Whole numbers only, so that engines agree.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("upper_case", "100 * n_upper > 40 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version: the bits that reject a document.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["upper_case"], 3: (1 << len(RULES)) - 1}
CURRENT = 3


def _measured(docs: DataFrame) -> DataFrame:
    """One row per document with its counts. Each array is a column of its own, used more than once, so it is built once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lined = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), lined.alias("lined"))
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size("lined").cast("long").alias("n_lines"),
        (F.size("lined") - F.size(F.array_distinct("lined"))).cast("long").alias("n_dup_lines"),
        # windows of three words as hashes with their first position; sorting puts equal windows side by side
        F.when(
            F.size("words") >= 3,
            F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))),
        ).alias("windows"),
    )
    twice = F.filter("windows", lambda x, j: (F.get("windows", j - 1)["h"] == x["h"]) | (F.get("windows", j + 1)["h"] == x["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return df.withColumn("n_repeat_words", F.when(F.col("windows").isNull(), 0).otherwise(F.size(covered)).cast("long")).drop("windows")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits with bit i set where rule i fails the document."""
    bits: Column = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(0).cast("long"))
    return _measured(docs).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds base_failed and kept under the policy of that version."""
    bits = F.col("fail_bits")
    return led.withColumn("base_failed", bits.bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", bits.bitwiseAND(F.lit(BASE | POLICIES[version])) == 0)


def ablation(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that it fails, and documents that only it fails (kept again if it were dropped)."""
    mask = POLICIES[version]
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask))
    sums = []
    for i, (name, _) in enumerate(RULES):
        if mask >> i & 1:
            sums += [F.sum(F.getbit(bits, F.lit(i)).cast("long")).alias(f"failed_{name}"), F.count_if(bits == (1 << i)).alias(f"only_{name}")]
    out = led.agg(*sums)
    names = [n for i, (n, _) in enumerate(RULES) if mask >> i & 1]
    parts = ", ".join(f"'{n}', failed_{n}, only_{n}" for n in names)
    return out.selectExpr(f"stack({len(names)}, {parts}) as (rule, failed, failed_only)")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(documents(spark, sf_dir)))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


OP9_SQL = r"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as p, ws from w where len(ws) >= 3),
h as (select doc_id, p, count(*) over (partition by doc_id, ws[p], ws[p + 1], ws[p + 2]) as n from g),
c as (select doc_id, count(distinct q) as n_repeat_words from (select doc_id, p + unnest([0, 1, 2]) as q from h where n > 1) group by doc_id),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
      from (select doc_id, unnest(string_split(t, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
        coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
      from w left join c on w.doc_id = c.doc_id left join l on w.doc_id = l.doc_id),
b as (select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
        + (case when word_chars < 3 * n_words then 4 else 0 end) + (case when word_chars > 12 * n_words then 8 else 0 end)
        + (case when 10 * n_symbols > n_words then 16 else 0 end) + (case when 100 * n_dup_lines > 60 * n_lines then 32 else 0 end)
        + (case when 100 * n_upper > 40 * word_chars then 64 else 0 end) as fail_bits from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept, cast(fail_bits as bigint) as fail_bits from b
"""

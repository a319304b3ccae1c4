r"""Operator 11: fill-in-the-middle transformation by one repeated-capture match.

The regex library keeps every repetition of a group: one fullmatch of `(unit)*` over a text gives, through `match.ends(1)`, the number
of units and the offset at which each unit ends. Both cuts are then two look-ups in that list; no loop walks the text. Hashes, forms,
output and restoring are Spark expressions, and Python returns three numbers a row.

Cuts: h1 to h4 are the first four groups of eight hex digits of sha256(salt + id). The prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units, the middle after the larger. A text that is empty, holds a sentinel, or whose h3 % 100 is not under `rate` stays plain;
else h4 % 100 under `spm` makes it suffix-prefix-middle, and prefix-suffix-middle otherwise.

Memory: a match holds some 110 bytes for each unit. Texts over STRETCH units are matched by stretches of STRETCH repetitions, each going on
where the last one ended, so it is bounded whatever the length; the captures are the same, as a greedy match of whole units has one reading.

Defined results: a null text is empty; a null id counts as an empty one; rows that repeat are each transformed alike; units that do not cover
the text raise; an empty table gives no rows; other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, sha256_hex

#: The sentinels of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
STRETCH = 1_000_000


def unit_cuts(text: str, h1: int, h2: int, whole, part, stretch: int = STRETCH) -> tuple[int, int, int]:
    """(number of units, code points before the first cut, code points before the second); whole is (unit)*, part (unit){0,stretch}."""
    if len(text) <= stretch:
        ends = [0, *whole.fullmatch(text).ends(1)]
        a, b = h1 % len(ends), h2 % len(ends)
        return len(ends) - 1, ends[min(a, b)], ends[max(a, b)]
    sizes, at = [], [0]
    while at[-1] < len(text):
        found = part.match(text, at[-1])
        if found.end() == at[-1]:
            raise ValueError(f"the unit matches nothing at offset {at[-1]}")
        sizes.append(len(found.ends(1)))
        at.append(found.end())
    n = sum(sizes)

    def offset(k: int) -> int:
        for size, start in zip(sizes, at):
            if k <= size:
                return part.match(text, start).ends(1)[k - 1] if k else start
            k -= size
        return at[-1]

    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, offset(a), offset(b)


def _cut_udf(unit: str, stretch: int):
    @F.pandas_udf("n long, first long, second long")
    def cuts(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        import regex

        whole, part = regex.compile(f"({unit})*"), regex.compile(f"({unit}){{0,{stretch}}}")
        return pd.DataFrame([unit_cuts(t, a, b, whole, part, stretch) for t, a, b in zip(text, h1, h2)], columns=["n", "first", "second"])

    return cuts


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, rate: int = 90, spm: int = 20, salt: str = "1:", stretch: int = STRETCH) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): texts rearranged as the module says; lengths are null where form is plain."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    df = docs.select("doc_id", text.alias("text"), *h)
    df = df.select("*", _cut_udf(unit, stretch)("text", "h1", "h2").alias("cut"))
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first)
    suffix = F.substring("text", second + 1, F.char_length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    length = lambda c: F.when(F.col("form") != "plain", c)
    df = df.select("*", form.alias("form"))
    return df.select("doc_id", F.col("cut.n").alias("n"), "form", length(F.col("cut.first")).alias("prefix_chars"), length(F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. A sentinel has no part of its start at its end, so the first one found is the one that was put there."""
    parts = lambda left, right: (F.substring(F.substring_index(output, right, 1), F.lit(4), F.char_length(output)), F.substring_index(F.substring_index(output, right, -1), MIDDLE, 1))
    middle = F.substring_index(output, MIDDLE, -1)
    before, after = parts(PREFIX, SUFFIX)
    spm_after, spm_before = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(before, middle, after)).when(form == "spm", F.concat(spm_before, middle, spm_after)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fill_in_middle(documents(spark, sf_dir))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"), sha256_hex(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_H = ", ".join(f"cast('0x' || substr(d, {8 * k + 1}, 8) as bigint) as h{k + 1}" for k in range(4))
OP11_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
h as (select doc_id, text, length(text) as n, {_H} from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
    when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(text, 1, i) as a, substr(text, i + 1, j - i) as b, substr(text, j + 1) as z from c)
select doc_id, n, form, case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars,
  sha256(case form when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b when 'spm' then '<S>' || z || '<P>' || a || '<M>' || b else text end) as output_sha256,
  sha256(text) as restored_sha256
from p"""

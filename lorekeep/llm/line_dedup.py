r"""Operator 1: line dedup by a range-partitioned stream of line hashes.

A line's key is the line without [\x20\x09-\x0D] at its ends, A-Z in lower case. A key of at least min_chars code points found
in at least min_docs documents loses its lines everywhere but in the largest doc_id that holds it.

1. Every long line becomes a row of two 64-bit hashes, doc_id and position, written once; the text stays behind.
2. The rows are range-partitioned by (hash, slot) and sorted by document and position inside; slot is a hash of doc_id, so a
   line that a third of all documents hold lies in many partitions. One window pass streams the first occurrence in each document.
3. The slots' sums are added up by hash; keys with enough documents are written, and joined back to the rows, which leaves positions to
   drop. Both sides of that join are plain scans, so AQE can split a hot hash, which it could not below an aggregate.
4. Positions become a bitmap per document: 64 lines a word, words without a dropped line left out.

`keep_bitmaps` returns those bitmaps; `apply_bitmaps` gives the kept text to whoever wants it.

Defined results: a null or empty text is one empty line, which no rule drops; rows with a null doc_id are no documents, so they
neither count nor lose lines; rows that repeat a doc_id count once, and each loses its own lines; ties do not arise, as doc_ids
of the holders of a key are compared; an empty table gives an empty result; a very long text or line is one row like any other. Other columns
pass through `apply_bitmaps` untouched, but those named n_lines, n_dropped or kept_text are replaced. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents, sha256_hex, written

MIN_CHARS = 40
MIN_DOCS = 5
#: Parts into which the documents of one hash are dealt.
SLOTS = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """Trimmed and with A-Z folded. lower() folds ASCII fast; only text beyond ASCII needs the exact mapping."""
    trimmed = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) == F.octet_length(trimmed), F.lower(trimmed)).otherwise(F.translate(trimmed, _UPPER, _UPPER.lower()))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = lines.where(F.length(F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))) >= min_chars)
    rows = lines.select("doc_id", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    return rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep_bitmap) of the documents that lose lines; keep_bitmap: array of (word, bits), bit i
    of word w tells whether line 64 * w + i stays, and words that are left out keep all their lines."""
    rows = written(_occurrences(docs, min_chars), "lines")
    dealt = rows.repartitionByRange("h1", "h2", "slot")
    by_key = Window.partitionBy("h1", "h2", "slot").orderBy(F.col("doc_id").desc(), "text_hash", "pos")
    before = F.lag("doc_id").over(by_key)
    firsts = dealt.withColumn("first", F.when(before.isNull() | (before != F.col("doc_id")), 1).otherwise(0))
    slots = firsts.groupBy("h1", "h2", "slot").agg(F.sum("first").alias("n"), F.max("doc_id").alias("last_doc"))
    keys = slots.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("last_doc").alias("keeper")).where(F.col("n_docs") >= min_docs)
    keys = written(keys.select("h1", "h2", "keeper"), "line-keys")
    drops = rows.join(keys, ["h1", "h2"]).where(F.col("doc_id") < F.col("keeper"))
    one = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = drops.groupBy("doc_id", "text_hash", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(one).alias("gone"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep_bitmap"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; the text is untouched (and unsplit) where no bitmap exists."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    # the row as one struct: no name of its columns can clash with those below
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    right = bitmaps.select("doc_id", "text_hash", "n_dropped", F.map_from_entries("keep_bitmap").alias("keep"))
    both = left.join(right.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")
    bits = lambda i: F.coalesce(F.element_at("keep", F.shiftright(i, 6)), F.lit(-1).cast("long"))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: F.getbit(bits(i), i % 64) == 1), "\n")
    return both.select(
        *[F.col("row")[c].alias(c) for c in others],
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), text).otherwise(kept).alias("kept_text"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


OP1_SQL = r"""
with l as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
k as (select doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
d as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.doc_id, k.pos, k.line, d.key is not null and k.doc_id < d.keeper as dropped from k left join d on k.key = d.key)
select doc_id, count(*) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from j group by doc_id
"""

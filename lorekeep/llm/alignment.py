"""Operator 12: alignment of two tokenizers by merge-path partitioning.

The ends of a text's A tokens and of its B tokens are two sorted lists of byte offsets. Merging them gives everything: each distinct end closes a
segment in which one A token and one B token overlap, so segments are the links, and an end of both kinds closes a group.

Merge path: the merge is divided by diagonals. On the diagonal d a binary search finds how many of the first d merged ends are A's; no merging
before it is needed, so pieces between two diagonals are independent and hold WORK ends each, whether a batch has one long text or many
short ones. A piece emits its segments and common ends; a diagonal that would part two equal ends is moved by one, and pieces are
stitched by sums of common ends, as a group may span pieces. The searches for all diagonals of a batch run together as array operations.

A document's links are kept as distinct (A id, B id) pairs with their number, in a written table. An id pair's count is the number of documents
that hold it, by one aggregation over that table. Scores of documents look counts up in a broadcast table where that has at most
BROADCAST_PAIRS rows (measured first; 17 bytes each), and otherwise by a shuffled join on the pair, which Spark splits where a pair is hot.

Defined results: null and empty texts, and texts whose bytes either tokenizer changes, have zeros and ''; rows that repeat a doc_id are documents
of their own; null ids are kept; an empty table gives no rows; other columns are ignored. Of equal counts all are best.
Memory: the tokens of BATCH_BYTES of text, one document at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import documents, written
from .encoding import BYTE_BPE, PIECE_BPE, ByteBpe, PieceBpe, Stretches, for_worker, text_parts

WORK = 1 << 15
BATCH_BYTES = 2 << 20
BROADCAST_PAIRS = 1 << 22
#: An id pair as one number: A's id above B's.
_B_BITS = 24
LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b stand before each piece, and at the end of the last; equal ends go a first and stay together."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        other = d - 1 - middle
        ahead = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(other, 0, len(b) - 1)])
        low, high = np.where(ahead, middle + 1, low), np.where(open_ & ~ahead, middle, high)
    i, j = low, d - low
    split = (i > 0) & (j < len(b))
    split[split] = a[i[split] - 1] == b[j[split]]
    return i, j + split


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct end of a piece, in order: how many ends of a and of b are smaller, and whether both have it."""
    after_b = np.searchsorted(b, a, "left")  # b's ends before each of a
    common = after_b < len(b)
    common[common] = b[after_b[common]] == a[common]
    alone = np.ones(len(b), bool)
    alone[after_b[common]] = False
    own_b = np.flatnonzero(alone)
    after_a = np.searchsorted(a, b[own_b], "left")
    place_a = np.arange(len(a)) + after_b - (np.cumsum(common) - common)  # common ends before count once
    n = len(a) + len(own_b)
    left, right, both = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    rest = np.ones(n, bool)
    rest[place_a] = False
    left[place_a], right[place_a], both[place_a] = np.arange(len(a)), after_b, common
    left[rest], right[rest] = after_a, own_b
    return left, right, both


def align(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, group) of each link, in order of the text; a and b are the ends of all tokens."""
    i, j = diagonals(a, b, work)
    links_a, links_b, groups, done = [], [], [], 0
    for p in range(len(i) - 1):
        left, right, both = merge_piece(a[i[p] : i[p + 1]], b[j[p] : j[p + 1]])
        closed = np.cumsum(both)
        links_a.append(i[p] + left)
        links_b.append(j[p] + right)
        groups.append(done + closed - both)  # stitched: a group open at the piece's start has the number of common ends so far
        done += int(closed[-1]) if len(closed) else 0
    return np.concatenate(links_a), np.concatenate(links_b), np.concatenate(groups)


class Names:
    """Decimal ids with the sign that follows them, as one Arrow table that is taken from."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.n_a, self.n_b = n_a, n_b
        self.table = pa.array([f"{k}{s}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for s in signs for k in range(n)], pa.large_string())

    def text(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all groups in order, each with its closing sign, and where each token's bytes start, the end of all last.
        Tokens come as a's and b's of the first group, of the second, and so on."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        rows = np.empty(len(a) + len(b), np.int64)
        rows[place_a] = a + last_a * self.n_a
        rows[place_b] = 2 * self.n_a + b + last_b * self.n_b
        out = self.table.take(pa.array(rows))
        starts = np.frombuffer(out.buffers()[1], np.int64)[: len(rows) + 1]
        return memoryview(out.buffers()[2]), starts


def linked_documents(docs: DataFrame, tokenizer_a: str = BYTE_BPE, tokenizer_b: str = PIECE_BPE, work: int = WORK) -> DataFrame:
    """A row a document: numbers of tokens, groups and links, the digest of its groups, and its links as distinct pairs with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = for_worker(("aligned", tokenizer_a, tokenizer_b), lambda: Stretches([ByteBpe(tokenizer_a, plain_specials=True), PieceBpe(tokenizer_b)], lead=True, check=True))
        size_a, size_b = (np.array([len(x) for x in t.bytes_of], np.int64) for t in encoder.tokenizers)
        names = Names(len(size_a), len(size_b))
        for batch in batches:
            for some in text_parts(batch, BATCH_BYTES):
                yield aligned_batch(some, encoder, size_a, size_b, names, work)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, LINKED)


def aligned_batch(rows: pa.RecordBatch, encoder: Stretches, size_a: np.ndarray, size_b: np.ndarray, names: Names, work: int) -> pa.RecordBatch:
    texts = rows.column("text").fill_null("")
    ((a, n_a), (b, n_b)), valid = encoder.encode(texts)
    live = valid & (np.asarray(pa.compute.binary_length(texts)) > 0)
    a, b = a[np.repeat(live, n_a)], b[np.repeat(live, n_b)]
    n_a, n_b = np.where(live, n_a, 0), np.where(live, n_b, 0)
    n = len(live)
    zero = np.zeros(n, np.int64)
    n_groups, n_links, digests, bounds = zero, zero, [""] * n, np.zeros(n + 1, np.int64)
    pairs = times = np.empty(0, np.int64)
    if len(a):
        # texts follow one another as one; a text's end is an end of both kinds, so no link or group leaves it
        link_a, link_b, group = align(np.cumsum(size_a[a]), np.cumsum(size_b[b]), work)
        doc_a = np.repeat(np.arange(n), n_a)
        doc = doc_a[link_a]
        n_links = np.bincount(doc, minlength=n)
        closes = np.append(group[1:] != group[:-1], True)
        n_groups = np.bincount(doc[closes], minlength=n)
        first_a, first_b = (np.append(True, x[1:] != x[:-1]) for x in (link_a, link_b))
        text, starts = names.text(a, b, group[first_a], group[first_b])
        token = np.concatenate([[0], np.cumsum(n_a + n_b)])
        for k in np.flatnonzero(live):
            digests[k] = hashlib.sha256(text[starts[token[k]] : starts[token[k + 1]] - 1]).hexdigest()
        key = (a[link_a].astype(np.int64) << _B_BITS) | b[link_b]
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        pairs, times = key[new], np.diff(np.append(new, len(key)))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])
    offsets = pa.array(bounds, pa.int32())
    return pa.RecordBatch.from_arrays([
        rows.column("row"), rows.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_links), pa.array(digests, pa.string()),
        pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
    ], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether no pair of its A id is in more."""
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", _B_BITS)))  # at most B's vocabulary in a group
    return counts.select("pair", "n", (F.col("n") == top).alias("best"))


_SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def scored(linked: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The documents with n_best, the links whose count is their A id's highest, and count_sum over links. Both tables are written ones."""
    if counts.limit(broadcast_pairs + 1).count() > broadcast_pairs:
        return _scored_by_join(linked, counts)
    spark = linked.sparkSession
    table = counts.toArrow()
    order = np.argsort(keys := np.asarray(table["pair"]))
    shared = spark.sparkContext.broadcast((keys[order], np.asarray(table["n"])[order], np.asarray(table["best"])[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            bounds = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
            at = np.searchsorted(keys, np.asarray(lists.flatten()))
            times = np.asarray(batch.column("times").flatten(), dtype=np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (times * best[at], times * n[at])] if len(keys) else [np.zeros(batch.num_rows, np.int64)] * 2
            own = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sums[0]), pa.array(sums[1]), batch.column("groups_sha256")], [x.split()[0] for x in _SCORED.split(", ")])

    return linked.mapInArrow(run, _SCORED)


def _scored_by_join(linked: DataFrame, counts: DataFrame) -> DataFrame:
    links = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = links.join(counts.hint("merge"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return linked.drop("pairs", "times").join(sums, "row", "left").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def align_tokenizers(docs: DataFrame, tokenizer_a: str = BYTE_BPE, tokenizer_b: str = PIECE_BPE, work: int = WORK, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    linked = written(linked_documents(docs, tokenizer_a, tokenizer_b, work), "linked")
    counts = written(pair_counts(linked), "pair-counts")
    return scored(linked, counts, broadcast_pairs).drop("row")


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))

r"""Operator 7: removal of repeated byte strings by a run-compressed index over sampled suffixes.

Every byte that lies in a 50-byte string which also starts in a document with a smaller doc_id is removed.

A full suffix order of the corpus would move eight bytes and more for every byte of text. The index here orders a sample of the
suffixes instead, chosen so that no match is lost, and keeps of each run of equal contexts only its end:

1. Sampling. Each 50-byte window elects the 16-byte gram of least hash inside it (the leftmost of equal ones). Equal windows elect
   the same gram at the same place, so comparing the contexts of equal grams finds every match. Neighbouring windows share
   their gram: such a stretch of windows is one entry (gram, context, document, place), about one for eighteen bytes.
2. Run-length order. Entries are range-partitioned and sorted by (gram, context, document). Entries of one context are a run; the run's
   first document is its sampled end, the others are repeated throughout and marked at once. A gram that spreads over many
   partitions costs each of them its share; a run cut by a border has one more end.
3. Matching. Where a gram has several contexts, or touches a border, the bytes of its run ends meet by gram and are compared window by
   window: a window is repeated if a smaller document has it. This finds the part of two different contexts that still agrees, left
   and right. Grams with very many contexts are compared by a join on single windows instead.
4. Marks go back to the documents by id; a document's marks are united and its bytes cut.

Defined results: a null or empty text has no bytes; texts under 50 bytes match nothing; rows with a null doc_id are returned whole and
match nothing; rows that repeat a doc_id are one document in comparisons and are cut one by one; other columns are ignored.
Memory: a few hundred kilobytes of text at a time, one document at least.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents, written
from ._text import _P, _P_INV, U, _powers, chunks, mix, utf8
from .filters import marked, passing

LENGTH = 50
GRAM = 16
#: Open entries of one gram that a task has seen in its partition before the gram's windows are compared by a join instead.
HOT = 10_000
#: Bits of the packed columns: key = gram, context; loc = rest of the context, place, number of windows.
_CONTEXT_HIGH, _CONTEXT_LOW, _PLACE, _COUNT = 24, 18, 40, 6
_LOW = _PLACE + _COUNT
_PLACE_MASK = (1 << _PLACE) - 1


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers(_P, len(data)), out=out[1:])
    return out


def _spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * _powers(_P_INV, len(sums))[starts]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbouring values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _entries(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, doc_id, loc): one row per stretch of windows that share their gram."""
    width = length - gram + 1

    def run(batches):
        for batch in batches:
            ids, base = np.array(batch.column("doc_id")), np.array(batch.column("base"))
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if len(part) < length:
                    continue
                sums, bits = _sums(part), max(1, int(len(part)).bit_length())
                grams = mix(_spans(sums, np.arange(len(part) - gram + 1), np.arange(gram, len(part) + 1)))
                low = U((1 << bits) - 1)
                elected = (_sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), width) & low).astype(np.int64)
                row = np.repeat(np.arange(b - a), np.diff(off))[: len(elected)]
                at = np.flatnonzero(np.arange(len(elected)) + length <= off[row + 1])
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (elected[at[1:]] != elected[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
                first = np.flatnonzero(new)
                start, n = at[first], np.diff(np.append(first, len(at)))
                pick, own = elected[start], row[start]
                context = mix(_spans(sums, start, start + n + length - 1) + (pick - start).astype(U) * U(0x9FB21C651E98DF25) + n.astype(U))
                key = (grams[pick] & ~U((1 << _CONTEXT_HIGH) - 1)) | (context >> U(64 - _CONTEXT_HIGH))
                place = (base[a + own] + start - off[own]).astype(U)
                loc = ((context & U((1 << _CONTEXT_LOW) - 1)) << U(_LOW)) | (place << U(_COUNT)) | n.astype(U)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[a + own]), pa.array(loc.view(np.int64))], names=["key", "doc_id", "loc"])

    return texts.mapInArrow(run, "key long, doc_id long, loc long")


def _scan(batches):
    """Streams entries sorted by (key, rest of the context, doc_id). Emits kind 0: entries of a run after its first document, repeated
    throughout; kind 1: run ends, open as their gram has several contexts or touches the partition's border; kind 2: hot grams."""
    names = ["gram", "doc_id", "loc", "kind"]
    held = None  # the last gram's run end while it is the only one
    carry = None  # (gram, key, low, first document of the run, runs so far, whether the gram began the partition)

    def out(gram, doc, loc, kind):
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(doc), pa.array(loc & ((1 << _LOW) - 1)), pa.array(np.full(len(gram), kind, np.int8))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, d, loc = (np.array(batch.column(x)) for x in ("key", "doc_id", "loc"))
        g, low = key >> _CONTEXT_HIGH, loc.view(U) >> U(_LOW)
        new_gram, new_run = np.ones(len(g), bool), np.ones(len(g), bool)
        new_gram[1:] = g[1:] != g[:-1]
        new_run[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1])
        same_gram = carry is not None and g[0] == carry[0]
        same_run = same_gram and key[0] == carry[1] and low[0] == carry[2]
        new_gram[0], new_run[0] = not same_gram, not same_run
        first_doc = d[new_run]
        if same_run:
            first_doc = np.append(carry[3], first_doc)
        run_no = np.cumsum(new_run) - (0 if same_run else 1)
        end = d == first_doc[run_no]
        gram_no = np.cumsum(new_gram) - (0 if same_gram else 1)
        runs = np.bincount(gram_no, new_run).astype(np.int64)
        began = np.zeros(len(runs), bool)
        if same_gram:
            runs[0] += carry[4]
            began[0] = carry[5]
        elif carry is None:
            began[0] = True
        several = (runs > 1) | began
        if held is not None:
            if same_gram and several[0]:
                yield out(*held, 1)
                held = None
            elif not same_gram or len(runs) > 1:
                held = None
        repeated, is_open = ~end, end & several[gram_no]
        yield out(g[repeated], d[repeated], loc[repeated], 0)
        yield out(g[is_open], d[is_open], loc[is_open], 1)
        hot = np.unique(g[np.flatnonzero(new_gram | (np.arange(len(g)) == 0))][runs > HOT]) if (runs > HOT).any() else g[:0]
        if len(hot):
            yield out(hot, hot, hot, 2)
        undecided = end & (gram_no == gram_no[-1]) & ~several[-1]
        if undecided.any():
            rows = g[undecided], d[undecided], loc[undecided]
            held = rows if held is None else tuple(np.append(x, y) for x, y in zip(held, rows, strict=True))
        carry = (g[-1], key[-1], low[-1], first_doc[run_no[-1]], int(runs[-1]), bool(began[-1]))
    if held is not None:  # the last gram may go on in the next partition
        yield out(*held, 1)


def _contexts(texts_with_marks: DataFrame, length: int) -> DataFrame:
    """(gram, doc_id, loc, bytes): the bytes of each open entry."""

    def run(batches):
        for batch in batches:
            ids, base, marks = batch.column("doc_id").to_pylist(), batch.column("base").to_pylist(), batch.column("open_marks")
            data, offsets = utf8(batch.column("text"))
            for i, doc in enumerate(ids):
                part, own = data[offsets[i] : offsets[i + 1]], marks[i].values
                gram, loc = np.array(own.field("gram")), np.array(own.field("loc"))
                start, n = (loc >> _COUNT) - base[i], loc & ((1 << _COUNT) - 1)
                here = (start >= 0) & (start + n + length - 1 <= len(part)) & ((loc >> _COUNT >> 34) == base[i] >> 34)
                gram, loc, start, size = gram[here], loc[here], start[here], (n + length - 1)[here]
                to = np.concatenate([[0], np.cumsum(size)])
                held = part[np.repeat(start - to[:-1], size) + np.arange(to[-1])]
                values = pa.BinaryArray.from_buffers(pa.binary(), len(loc), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(held)])
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(loc), doc, np.int64)), pa.array(loc), values], names=["gram", "doc_id", "loc", "bytes"])

    return texts_with_marks.mapInArrow(run, "gram long, doc_id long, loc long, bytes binary")


def _window_hashes(column: pa.Array, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, window in the entry, hash) of all windows of the entries' bytes."""
    data, offsets = utf8(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    entry = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[entry] + j
    return entry, j, mix(_spans(_sums(data), start, start + length))


def _found(doc: np.ndarray, loc: np.ndarray, entry: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(doc_id, loc) of the stretches of windows that were found, given in order of entry and window."""
    new = np.ones(len(j), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(j)))
    place = (loc[entry[first]] >> _COUNT) + j[first]
    return pa.RecordBatch.from_arrays([pa.array(doc[entry[first]]), pa.array((place << _COUNT) | n)], names=["doc_id", "loc"])


def _matched(contexts: DataFrame, length: int) -> DataFrame:
    """Windows that an entry of the same gram with a smaller doc_id has too. Grams are dealt by hash and sorted; a gram is held in
    memory while it is compared, which HOT bounds."""

    def run(batches):
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            gram = rest.column("gram").to_numpy()
            whole = int(np.searchsorted(gram, gram[-1], side="left")) if len(gram) else 0
            if whole:
                yield from compare(rest.slice(0, whole))
                rest = rest.slice(whole)
        if rest is not None and len(rest):
            yield from compare(rest)

    def compare(table: pa.Table):
        gram, doc, loc = (table.column(x).to_numpy() for x in ("gram", "doc_id", "loc"))
        entry, j, h = _window_hashes(table.column("bytes"), loc & ((1 << _COUNT) - 1), length)
        order = np.lexsort((doc[entry], h, gram[entry]))
        e, hs = entry[order], h[order]
        new = np.ones(len(order), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (gram[e[1:]] != gram[e[:-1]])
        least = doc[e[np.flatnonzero(new)]][np.cumsum(new) - 1]
        found = np.sort(order[doc[e] > least])
        if len(found):
            yield _found(doc, loc, entry[found], j[found])

    return contexts.repartition("gram").sortWithinPartitions("gram", "doc_id").mapInArrow(run, "doc_id long, loc long")


def _joined(contexts: DataFrame, length: int) -> DataFrame:
    """The same for hot grams, window by window: least documents are pre-aggregated, and the join back is split by AQE."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                gram, doc, loc = (np.array(batch.column(x)) for x in ("gram", "doc_id", "loc"))
                entry, j, h = _window_hashes(batch.column("bytes"), loc & ((1 << _COUNT) - 1), length)
                one = (((loc[entry] >> _COUNT) + j) << _COUNT) | 1
                yield pa.RecordBatch.from_arrays([pa.array(gram[entry]), pa.array(h.view(np.int64)), pa.array(doc[entry]), pa.array(one)], names=["gram", "h", "doc_id", "loc"])

    windows = written(contexts.mapInArrow(run, "gram long, h long, doc_id long, loc long"), "windows")
    least = windows.groupBy("gram", "h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where(F.col("least") < F.col("most"))
    return windows.join(least, ["gram", "h"]).where(F.col("least") < F.col("doc_id")).select("doc_id", "loc")


def _cut(texts_with_marks: DataFrame, length: int) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            base = np.array(batch.column("base"))
            removed, spans, kept = [], [], []
            for i, loc in enumerate(batch.column("locs")):
                part = data[offsets[i] : offsets[i + 1]]
                if not loc.is_valid or len(part) < length:
                    removed.append(0)
                    spans.append(0)
                    kept.append(part.tobytes())
                    continue
                loc = np.array(loc.values)
                loc = loc[(loc >> _COUNT >> 34) == base[i] >> 34]
                start = (loc >> _COUNT) - base[i]
                depth = np.zeros(len(part) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + (loc & ((1 << _COUNT) - 1)) + length - 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(part[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts_with_marks.select("doc_id", "text", "base", "locs").mapInArrow(run, schema)


def _numbered(texts: DataFrame) -> DataFrame:
    """Adds base, where a text's places begin: 0, but for the further texts of a doc_id, each 2**34 on (64 texts at most)."""
    twice = texts.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("doc_id")
    if twice.isEmpty():
        return texts.withColumn("base", F.lit(0).cast("long"))
    hashed = texts.withColumn("__h", F.xxhash64("text"))
    ranks = hashed.join(twice, "doc_id", "left_semi").select("doc_id", "__h").distinct().withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy("__h")) - 1)
    out = hashed.join(ranks, ["doc_id", "__h"], "left")
    rank = F.coalesce("__r", F.lit(0)).cast("long")
    return out.select("doc_id", "text", F.when(F.assert_true(rank < 64).isNull(), F.shiftleft(rank, 34)).alias("base"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs: doc_id, text. Returns (doc_id, n_bytes, n_removed, n_spans, kept), kept being the bytes that stay (they need not be UTF-8)."""
    if not gram < length <= gram + 62:
        raise ValueError("length must be above gram and at most gram + 62")
    texts = _numbered(docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = ["key", F.shiftrightunsigned("loc", _LOW), "doc_id", "loc"]
    dealt = _entries(texts, length, gram).repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    marks = written(dealt.mapInArrow(_scan, "gram long, doc_id long, loc long, kind byte"), "marks")
    # texts without a mark need not move
    bits = marked(marks.where("kind < 2").select("doc_id"))
    some, others = passing(texts, bits), passing(texts, bits, others=True)
    opened = marks.where("kind = 1").select("gram", "doc_id", "loc")
    hot = marks.where("kind = 2").select("gram").distinct()
    contexts = _contexts(some.join(opened.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "loc")).alias("open_marks")), "doc_id"), length)
    if hot.isEmpty():
        found = _matched(contexts, length)
    else:
        contexts, hot = written(contexts, "contexts"), written(hot, "hot")
        found = _matched(contexts.join(hot, "gram", "left_anti"), length).union(_joined(contexts.join(hot, "gram", "left_semi"), length))
    covered = marks.where("kind = 0").select("doc_id", "loc").union(found).groupBy("doc_id").agg(F.collect_list("loc").alias("locs"))
    none = F.lit(None).cast("array<long>").alias("locs")
    whole = docs.where(F.col("doc_id").isNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("base"), none)
    cut = some.join(covered, "doc_id", "left").select("doc_id", "text", "base", "locs").union(others.select("doc_id", "text", "base", none)).union(whole)
    return _cut(cut, length)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The definition, for tests."""
    least: dict[bytes, int] = {}
    for doc, text in rows:
        for i in range(len(text) - length + 1):
            s = text[i : i + length]
            least[s] = min(doc, least.get(s, doc))
    out = {}
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if least[text[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out

"""Operator 13: token ids in binary files, compressed by Re-Pair grammars.

Documents are dealt by ranges of doc_id and sorted, and each task writes one file of blocks. A block holds the ids of whole documents, at most
BLOCK_IDS of them or one longer document. Its grammar is made by Re-Pair: the pairs of neighbours that occur most often become
nonterminals, again and again, until no pair occurs twice without overlap. A round replaces all pairs that occur LEAST times at once; where two
overlap, the more frequent one is taken. Rules refer to earlier rounds only, so a block is expanded in as
many array operations as it has rounds.

Block, numbers little-endian: the magic, then 64-bit counts (documents, ids, first nonterminal, rules, symbols, bits of a symbol, bits of a length); doc_id as
int64 and a byte that tells nulls; ids a document as int64; the left sides of rules, the right ones, expansion lengths of rules; the expanded offset of every
SAMPLE-th symbol as int64; symbols. Sides, lengths and symbols stand bit by bit: the lowest of all, then the next. With the lengths and the sampled
offsets, `decode_range` reads ids from anywhere without expanding what stands before.

`write` returns the manifest, a row a block (file, offset, bytes, documents, ids, part, block); only files it names are read. A file is written under a temporary name and
moved, so a task that runs again replaces its file with an equal one. `start` of a block comes from sums of its part, which the
driver adds up (one number a task), and of the parts before.

Defined results: a null text is empty and gives the end id alone; null ids come first; rows with one doc_id follow one another by text, and all are
kept; an empty table gives no file; other columns are ignored. Memory: the texts of BATCH_BYTES, one block, one document.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import documents, scratch_path
from .encoding import BYTE_BPE, ByteBpe, Stretches, for_worker, text_parts

END_ID = 2
BLOCK_IDS = 1 << 20
BATCH_BYTES = 4 << 20
LEAST, COUNTERS, SAMPLE = 2, 18, 1024
_MAGIC, _HEAD = b"RPG2", struct.Struct("<4s7q")
MANIFEST = "file string, offset long, bytes long, n_docs long, n_ids long, part int, block int"


def _pairs(x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that begin at the places `live` of x, and which of them count: of a run of one symbol every second."""
    left, right = x[live], x[live + 1]
    same = left == right
    inside = np.zeros(len(live), bool)
    inside[1:] = same[1:] & same[:-1] & (np.diff(live) == 1)
    place = np.arange(len(live))
    counts = ~same | ((place - np.maximum.accumulate(np.where(inside, 0, place))) & 1 == 0)
    return (left.astype(np.uint64) << np.uint64(32)) | right, counts


def _chosen(at: np.ndarray, pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a pair of `least` occurrences begins that beats the pairs it overlaps, and a number of each place's pair; those that beat others less often are left.

    Of pairs that occur equally often the greater number wins, so the most frequent pair of all is replaced wherever it counts."""
    often = np.bincount(pair)[pair] if len(pair) else pair
    at, pair, often = at[often >= least], pair[often >= least], often[often >= least]
    if not len(at):
        return at, pair
    rank = (often << int(pair.max() + 1).bit_length()) | pair
    apart = np.diff(at) != 1
    won = (rank > np.concatenate([[0], np.where(apart, 0, rank[:-1])])) & (rank > np.concatenate([np.where(apart, 0, rank[1:]), [0]]))
    at, pair = at[won], pair[won]
    paid = np.bincount(pair)[pair] >= least
    return at[paid], pair[paid]


def repair(ids: np.ndarray, vocabulary: int, least: int = LEAST, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k stands for the two symbols rules[k], and is symbol vocabulary + k. Ends when no pair occurs `least` times, or after `rounds`.

    Pairs are counted by a hash, and a counter stands for one of its pairs; another waits for the next round, which hashes anew. Once that finds nothing, pairs are
    counted by sorting. A pair's count never grows, as new occurrences hold a new symbol; so a place whose pair occurs too seldom is looked at again only when
    a new symbol stands at it or behind it."""
    x, rules, n, exact = ids.astype(np.uint32), [np.empty((0, 2), np.uint32)], vocabulary, False
    live, k = np.arange(len(x) - 1), 0
    while len(live) and (rounds is None or k < rounds):
        pairs, counts = _pairs(x, live)
        place, k = np.flatnonzero(counts), k + 1
        pairs = pairs[place]
        if exact:
            names, times = np.unique(pairs, return_counts=True)
            names = names[times >= least]
            if not len(names):
                break
            number = np.minimum(np.searchsorted(names, pairs), len(names) - 1)
            own = often = names[number] == pairs
        else:
            number = ((pairs * np.uint64((2 * (k * 7919 + 48271) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - COUNTERS)).astype(np.int64)
            often = np.bincount(number, minlength=1 << COUNTERS)[number] >= least
            stands = np.empty(1 << COUNTERS, np.uint64)
            stands[number] = pairs
            own = often & (stands[number] == pairs)
        at, number = _chosen(live[place[own]], number[own], least)
        keep = np.ones(len(live), bool)
        keep[place[~often]] = False
        live = live[keep]
        if not len(at):
            if exact:
                break
            exact = True
            continue
        used, number = np.unique(number, return_inverse=True)
        first = np.empty(len(used), np.int64)
        first[number] = at
        rules.append(np.stack([x[first], x[first + 1]], axis=1))
        stay = np.ones(len(x), bool)
        stay[at + 1] = False
        x[at] = n + number
        n += len(used)
        moved = np.cumsum(stay) - 1
        x = x[stay]
        again = np.zeros(len(x) + 1, bool)
        again[moved[live[stay[live]]]] = True
        again[moved[at]] = again[moved[at] - 1] = True
        live = np.flatnonzero(again[: max(len(x) - 1, 0)])
    return np.concatenate(rules), x


def _take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of flat end to end."""
    size = sizes[rows]
    ends = np.cumsum(size)
    return flat[np.repeat(starts[rows] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _levels(rules: np.ndarray, vocabulary: int) -> Iterator[tuple[int, int]]:
    """Runs (first, stop) of rules that refer to symbols before the run only."""
    done, most = 0, rules.max(axis=1).astype(np.int64) - vocabulary if len(rules) else np.empty(0, np.int64)
    while done < len(rules):
        open_ = np.flatnonzero(most[done:] >= done)
        stop = done + (int(open_[0]) if len(open_) else len(rules) - done)
        yield done, stop
        done = stop


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    sizes = np.ones(vocabulary + len(rules), np.int64)
    for first, stop in _levels(rules, vocabulary):
        sizes[vocabulary + first : vocabulary + stop] = sizes[rules[first:stop].astype(np.int64)].sum(axis=1)
    return sizes


class Grammar:
    """Expansions of all symbols, made rule by rule in order of the rounds. Together they are at most half the block for each round."""

    def __init__(self, rules: np.ndarray, vocabulary: int) -> None:
        self.flat, self.starts, self.sizes = np.arange(vocabulary, dtype=np.uint32), np.arange(vocabulary), np.ones(vocabulary, np.int64)
        for first, stop in _levels(rules, vocabulary):
            sides = rules[first:stop].reshape(-1).astype(np.int64)
            new = _take(self.flat, self.starts, self.sizes, sides)
            size = self.sizes[sides].reshape(-1, 2).sum(axis=1)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
            self.flat, self.sizes = np.concatenate([self.flat, new]), np.concatenate([self.sizes, size])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return _take(self.flat, self.starts, self.sizes, symbols.astype(np.int64))


def _to_bits(values: np.ndarray, bits: int) -> bytes:
    """The values bit by bit, each bit of all of them filled up to a byte."""
    return b"".join(np.packbits((values >> k & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(bits))


def _from_bits(data: np.ndarray, n: int, first: int, last: int) -> np.ndarray:
    """Values first to last of n of `_to_bits`, one row of data a bit."""
    out, start = np.zeros(max(0, min(last, n) - first), np.int64), first // 8
    for k, row in enumerate(data):
        out |= np.unpackbits(row[start : -(-last // 8)], bitorder="little")[first - 8 * start :][: len(out)].astype(np.int64) << k
    return out


def pack_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    rules, x = repair(ids, vocabulary)
    sizes_of = expansion_lengths(rules, vocabulary)
    lengths = sizes_of[vocabulary:]
    width, wide = int(vocabulary + len(rules)).bit_length(), int(lengths.max(initial=0)).bit_length()
    size = sizes_of[x]
    sampled = (np.cumsum(size) - size)[::SAMPLE]
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), vocabulary, len(rules), len(x), width, wide)
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), sizes.astype("<i8").tobytes(), _to_bits(rules[:, 0], width), _to_bits(rules[:, 1], width),
        _to_bits(lengths, wide), sampled.astype("<i8").tobytes(), _to_bits(x, width),
    ])


class Block:
    """A block as read: what stands in its tables, and its symbols still packed."""

    def __init__(self, data: bytes) -> None:
        if data[: len(_MAGIC)] != _MAGIC:
            raise ValueError("this is no block of token ids")
        _, docs, self.n_ids, self.vocabulary, rules, self.n_symbols, width, wide = _HEAD.unpack_from(data)
        at = _HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def bits(n: int, width: int) -> np.ndarray:
            return part("u1", width * -(-n // 8)).reshape(width, -(-n // 8))

        ids, null = part("<i8", docs), part("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.sizes = part("<i8", docs)
        self.rules = np.stack([_from_bits(bits(rules, width), rules, 0, rules) for _ in range(2)], axis=1).astype(np.uint32)
        self.lengths = _from_bits(bits(rules, wide), rules, 0, rules)
        self.sampled = part("<i8", -(-self.n_symbols // SAMPLE))
        self.packed = bits(self.n_symbols, width)
        if at != len(data):
            raise ValueError("the block is cut short or has bytes after its end")

    def symbols(self, first: int, last: int) -> np.ndarray:
        return _from_bits(self.packed, self.n_symbols, first, last).astype(np.uint32)

    def ids(self) -> np.ndarray:
        return Grammar(self.rules, self.vocabulary).expand(self.symbols(0, self.n_symbols))

    def _expanded(self, symbol: int, out: list[int]) -> None:
        open_ = [symbol]
        while open_:
            s = open_.pop()
            if s < self.vocabulary:
                out.append(s)
            else:
                open_ += [int(self.rules[s - self.vocabulary][1]), int(self.rules[s - self.vocabulary][0])]

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop: expands the symbols that cover them and no others, from the nearest sampled offset on."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        low, high = int(np.searchsorted(self.sampled, start, "right")) - 1, int(np.searchsorted(self.sampled, stop, "left"))
        x = self.symbols(low * SAMPLE, min(high * SAMPLE, self.n_symbols))
        size = np.where(x >= self.vocabulary, self.lengths[np.maximum(x.astype(np.int64) - self.vocabulary, 0)], 1) if len(self.rules) else np.ones(len(x), np.int64)
        ends = int(self.sampled[low]) + np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip, out = start - int(ends[a] - size[a]), []
        for symbol in x[a:b].tolist():
            self._expanded(symbol, out)
        return np.array(out[skip : skip + stop - start], np.uint32)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes and writes all documents under path; returns the manifest."""
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    dealt = docs.select("doc_id", "text").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        encoder = for_worker(("ids", tokenizer), lambda: Stretches([ByteBpe(tokenizer, plain_specials=False)]))
        vocabulary = max(len(encoder.tokenizers[0].bytes_of), end_id + 1)
        store, root = _store(path)
        name, temporary = f"{root}/ids-{part:06d}.rpg", f"{root}/.ids-{part:06d}-{context.taskAttemptId()}"
        out, at, rows = None, 0, []
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            nonlocal out, at
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temporary, compression=None)
            ids = np.concatenate([h[2] for h in held])
            data = pack_block([d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), ids, vocabulary)
            out.write(data)
            rows.append((f"{path}/{os.path.basename(name)}", at, len(data), sum(len(h[0]) for h in held), len(ids), part, len(rows)))
            at += len(data)
            held.clear()

        for batch in batches:
            for some in text_parts(batch, BATCH_BYTES):
                (ids, sizes), _ = (x := encoder.encode(some.column("text").fill_null("")))[0][0], x[1]
                ends = np.cumsum(sizes)
                sizes = sizes + 1
                ids = np.insert(ids, ends, end_id).astype(np.uint32)
                bounds, names, first = np.concatenate([[0], np.cumsum(sizes)]), some.column("doc_id").to_pylist(), 0
                while first < len(names):  # as many documents as the block still takes
                    room = block_ids - sum(len(h[2]) for h in held)
                    last = int(np.searchsorted(bounds, bounds[first] + room, "right")) - 1
                    if last <= first and held:
                        flush()
                        continue
                    last = max(last, first + 1)
                    held.append((names[first:last], sizes[first:last], ids[bounds[first] : bounds[last]]))
                    first = last
        if held:
            flush()
        if out is not None:
            out.close()
            store.move(temporary, name)
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "offset", "bytes", "n_docs", "n_ids", "part", "block"), r)) for r in rows], schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("offset", "bytes", "n_docs", "n_ids")), ("part", pa.int32()), ("block", pa.int32())]))

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{path}-manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the ids of all blocks before."""
    spark = manifest.sparkSession
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = [0, *accumulate(n for _, n in totals)]
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, __base long")
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    return manifest.withColumn("__own", own).join(F.broadcast(bases), "part").withColumn("start", F.col("__base") + F.col("__own")).drop("__base", "__own")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of the manifest's files, in file order inside a block."""
    blocks = with_starts(manifest).select("file", "offset", "bytes", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = _store(row["file"])
                with store.open_input_file(name) as f:
                    f.seek(row["offset"])
                    block = Block(f.read(row["bytes"]))
                ids = block.ids().astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(block.sizes)])
                if bounds[-1] != len(ids):
                    raise ValueError(f"{row['file']}: sizes and ids differ")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(block.doc_ids, pa.int64()), "start": pa.array(row["start"] + bounds[:-1]), "n_tokens": pa.array(block.sizes),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))),
                })

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """`read_documents` without the ids."""
    return read_documents(manifest).drop("ids")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(write(documents(spark, sf_dir), scratch_path(spark, "token-ids")))

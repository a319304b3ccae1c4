r"""Operator 10: n-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct k-word shingles, as 64-bit hashes. Two documents link when 100 * |A and B| >= threshold * |A or B|.

The postings move once, range-partitioned by (shingle, position, document), so that a shingle of many documents is dealt to many tasks.

1. One pass over the text: set size and a 128-bit signature per document, and a fixed-size sketch of shingle counts. Documents
   of equal signature are one class, whose smallest id stands for it, so copies never meet again.
2. Shingles are ordered by sketched count, rarest first. If two sets link, their prefixes of n - ceil(t * n) + m shingles share at least m
   of them, for every m. Each document takes the m of least estimated cost: a longer prefix reads more postings, but demands
   more shared shingles of a candidate.
3. A posting carries its position. Two sets that link share `need` shingles at least, from their sizes; what follows position i adds at most
   n - i - 1. So the first m shared shingles of a linking pair stand at n - need + m - 1 or before in both. A pair is a candidate if one
   shared shingle is early enough to be its first, and m of them are early enough to be its first m. A text with edits of its own has its own
   shingles first, so its shared ones come too late, and it meets no other member of a large group at all.
4. Only components are wanted, so candidates are tried in stars first: in each posting list all members against the one with the
   earliest position, and, while many pairs are left and lists shrink, against others. Lists whose members are in one component by then have
   nothing left to find. The remaining pairs across components are all tried, within bands of size. No list is cut, no pair is dropped.
5. A tried pair is verified on the whole sets.

Defined results: null and empty texts have no shingles and link with nothing; a null doc_id has component null; rows that repeat a
doc_id are one document that has the links of each row; ties of counts are broken by the hash; other columns, whatever their names,
are not looked at; an empty table gives an empty result. Memory: a few hundred kilobytes of text at a time, one document at least (a
very long one is taken whole), Arrow batches of at most 64 MB, and a sketch of fixed size.

Scale: the sketch's noise is the root of the mean load of its counters. Groups of documents smaller than that are ordered by chance, as by a random
order of shingles, and their candidates are pruned by sizes and positions only; larger groups stand out and are pruned as above.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, written
from ._text import U, mix, shingle_sets
from .components import components
from .filters import marked, only, passing

K, THRESHOLD = 3, 90
#: Counters of the sketch: its size is fixed, whatever the input.
SKETCH_LOG = 22
SKETCH = 1 << SKETCH_LOG
BLOCKS = 64
MAX_MATCH = 4
#: After a first round of stars over whole lists, more are tried while the pairs of open lists are more than so many a posting, and shrink to this
#: share or less, for so many rounds at most; what they leave is tried in full.
PAIRS, SHRINK, MAX_STARS = 10, 0.8, 8
#: In lists of at most so many postings, those that can link with no other are dropped at once.
SMALL_LIST = 4
#: Bits of a posting's packed word below the set's size: number of matches, then position.
MATCH_BITS, POSITION_BITS = 4, 30


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - SKETCH_LOG)).astype(np.int64)


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (doc_id, n, sig_a, sig_b), and one row a task and block with the task's share of the sketch: a byte a
    counter, and (counter, rest) for those above 255."""

    def run(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, row, h in shingle_sets(batch.column("text"), k):
                np.add.at(counts, _counter(h), np.uint32(1))
                n = np.bincount(row, minlength=b - a)
                at = np.concatenate([[0], np.cumsum(n)])
                one, two = (np.concatenate([[U(0)], np.cumsum(x, dtype=U)]) for x in (mix(h ^ U(0xA5A5A5A5)), mix(h + U(0x1234567))))
                sig = [pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in (one, two)]
                none = pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary()), pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n.astype(np.int64)), *sig, *none], names=names)
        for block, part in enumerate(np.split(counts, BLOCKS)):
            if part.any():
                over = np.flatnonzero(part > 255).astype(np.uint32)
                many = np.stack([over, part[over] - np.uint32(255)], axis=1).tobytes()
                part = np.minimum(part, 255).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([block], pa.int32()), pa.array([part], pa.binary()), pa.array([many], pa.binary())], names=names)

    names = ["doc_id", "n", "sig_a", "sig_b", "block", "counts", "over"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, block int, counts binary, over binary")


def _sketch(profiles: DataFrame) -> np.ndarray:
    """The summed sketch. A block's shares are streamed into one sum, however many tasks gave one; BLOCKS sums of fixed size come to the driver."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts, over in zip(batch.column("block").to_pylist(), batch.column("counts"), batch.column("over"), strict=True):
                one = total.setdefault(block, np.zeros(SKETCH // BLOCKS, np.int64))
                one += np.frombuffer(counts.as_buffer(), np.uint8)
                if over.as_py():
                    at, rest = np.frombuffer(over.as_buffer(), np.uint32).reshape(-1, 2).T
                    one[at] += rest
        for block, one in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(one, (1 << 31) - 1).astype(np.int32).tobytes()], pa.binary())], names=["block", "counts"])

    shares = profiles.where(F.col("block").isNotNull()).select("block", "counts", "over").repartition(BLOCKS, "block")
    out = np.zeros((BLOCKS, SKETCH // BLOCKS), np.int32)
    for r in shares.mapInArrow(add, "block int, counts binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def _prefixes(docs: DataFrame, k: int, threshold: int, shared: Broadcast) -> DataFrame:
    """(doc_id, n, match, tokens): the ordered prefix for the chosen number of matches. shared: the summed sketch."""

    def run(batches):
        counts = shared.value
        load = float(counts.sum(dtype=np.int64)) / SKETCH
        floor = load + 3 * load**0.5
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, row, h in shingle_sets(batch.column("text"), k):
                seen = counts[_counter(h)]
                order = np.lexsort((h, seen, row))
                h, seen = h[order], seen[order]
                n = np.bincount(row, minlength=b - a)
                at = np.concatenate([[0], np.cumsum(n)])
                first = n - -(-threshold * n // 100) + 1
                postings = np.concatenate([[0.0], np.cumsum(np.maximum(seen - floor, 0))])
                best, match = np.full(b - a, np.inf), np.ones(b - a, np.int64)
                for m in range(1, MAX_MATCH + 1):
                    length = first + m - 1
                    read = postings[np.minimum(at[:-1] + length, at[1:])] - postings[at[:-1]]
                    cost = np.where((length <= n) | (m == 1), read * (1 + (1 + n / 16) / m) + length, np.inf)
                    match[cost < best] = m
                    best = np.minimum(best, cost)
                length = np.where(n > 0, np.minimum(first + match - 1, n), 0)
                inside = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(length, n)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(h[inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(match), tokens], names=["doc_id", "n", "match", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, match long, tokens array<long>")


def _sets(docs: DataFrame, k: int, shared_bits: Broadcast) -> DataFrame:
    """(doc_id, shingles) of the documents that pass the filter: the sorted hashes, 6 bytes each."""

    def run(batches):
        bits = shared_bits.value
        for batch in batches:
            batch = only(batch, bits)
            ids = batch.column("doc_id")
            for a, b, row, h in shingle_sets(batch.column("text"), k):
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))])
                six = np.ascontiguousarray((h >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([six[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def _whole(packed: pa.Scalar) -> np.ndarray:
    out = np.zeros((len(packed.as_buffer()) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, 6)
    return out.view(U).ravel()


def _verified(pairs: DataFrame, docs: DataFrame, k: int, threshold: int, others: DataFrame | None = None) -> DataFrame:
    """Writes the pairs (a, b) that link, and others besides. Only sets that a pair names are made; a document of many pairs is split by
    AQE's skew join."""
    bits = marked(pairs.select(F.explode(F.array("a", "b"))))
    sets = written(_sets(docs, k, bits), "sets")
    bits.destroy()
    of_a, of_b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(of_b, "b").join(of_a, "a")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                one, two = _whole(x), _whole(y)
                at = np.searchsorted(one, two)
                at[at == len(one)] = 0
                shared = int((one[at] == two).sum()) if len(one) else 0
                keep.append(100 * shared >= threshold * (len(one) + len(two) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long").distinct()
    return written(found if others is None else found.union(others), "verified")


def _unpacked(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size of the set, matches, position) of packed postings."""
    return s >> (MATCH_BITS + POSITION_BITS), (s >> POSITION_BITS) & ((1 << MATCH_BITS) - 1), s & ((1 << POSITION_BITS) - 1)


def _partners(group: np.ndarray, size: np.ndarray, s: np.ndarray, threshold: int) -> np.ndarray:
    """Which postings may link with another of their list (see _may_link), or stand in a list too long to look at here."""
    out = size[group] > SMALL_LIST
    n, most, at = _unpacked(s)
    for d in range(1, SMALL_LIST):
        x, y = slice(None, -d), slice(d, None)
        least = np.minimum(most[x], most[y]) - 1 - -(-(n[x] + n[y]) * threshold // (100 + threshold))
        may = (group[x] == group[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * threshold) & (at[x] <= n[x] + least) & (at[y] <= n[y] + least)
        out[x] |= may
        out[y] |= may
    return out


def _lists(batches, threshold: int):
    """Streams postings sorted by (token, position, doc_id). Emits those whose token has several documents that may link, or touches the border
    of the partition, with the first document, which has the fewest rarer shingles, as centre. State: one posting."""
    names = ["token", "doc_id", "s", "centre", "centre_s"]
    held, carry, began = None, None, True  # held: a posting that is alone so far; carry: (token, centre, its s)

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        t, d, s = (np.array(batch.column(x)) for x in ("token", "doc_id", "s"))
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        goes_on = carry is not None and t[0] == carry[0]
        new[0] = not goes_on
        first = np.flatnonzero(new)
        centre, centre_s = d[first], s[first]
        if goes_on:
            centre, centre_s = np.append(carry[1], centre), np.append(carry[2], centre_s)
        group = np.cumsum(new) - (0 if goes_on else 1)
        size = np.bincount(group)
        keep = size > 1
        if goes_on or began:
            keep[0] = True  # more than one with what came before, or at the border
        if held is not None and goes_on:
            yield out(*held)
        if not (goes_on and len(size) == 1):
            held = None
        elif held is not None:
            held = None
        pick = keep[group]
        inner = np.ones(len(keep), bool)  # lists that lie whole in this batch
        inner[-1] = False
        inner[0] &= not (goes_on or began)
        pick &= ~inner[group] | _partners(group, size, s, threshold)
        yield out(t[pick], d[pick], s[pick], centre[group[pick]], centre_s[group[pick]])
        if not keep[-1]:
            held = t[-1:], d[-1:], s[-1:], d[-1:], s[-1:]
        carry, began = (t[-1], centre[group[-1]], centre_s[group[-1]]), False
    if held is not None:
        yield out(*held)


def _n(s: str) -> Column:
    return F.shiftright(s, MATCH_BITS + POSITION_BITS)


def _match(s: str) -> Column:
    return F.shiftright(s, POSITION_BITS).bitwiseAND(F.lit((1 << MATCH_BITS) - 1))


def _position(s: str) -> Column:
    return F.col(s).bitwiseAND(F.lit((1 << POSITION_BITS) - 1))


def _need(n_a: Column, n_b: Column, threshold: int) -> Column:
    """The fewest shared shingles with which sets of these sizes link."""
    return F.ceil((n_a + n_b) * threshold / (100 + threshold))


def _may_link(s: str, t: str, threshold: int, most: Column | None = None) -> Column:
    """Whether two postings of a shingle may be among the first `most` shared ones of a linking pair; the smaller number of matches if not given."""
    n_a, n_b = _n(s), _n(t)
    last = (F.least(_match(s), _match(t)) if most is None else most) - 1 - _need(n_a, n_b, threshold)
    similar = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * threshold
    return similar & (_position(s) <= n_a + last) & (_position(t) <= n_b + last)


def _candidates(rows: DataFrame, threshold: int) -> DataFrame:
    """rows: (a, b, s, t), two documents and their postings of a shared shingle. The pairs that share early shingles in the number demanded."""
    most = F.least(_match("s"), _match("t"))
    pair = rows.where(_may_link("s", "t", threshold)).groupBy("a", "b").agg(F.count("*").alias("c"), F.min(most).alias("m"), F.max(_may_link("s", "t", threshold, F.lit(1))).alias("first"))
    return pair.where((F.col("c") >= F.col("m")) & F.col("first")).select("a", "b")


def _stars(found: DataFrame, threshold: int) -> DataFrame:
    """Members against centres, smaller id first."""
    other = F.col("doc_id") != F.col("centre")
    return _candidates(found.where(other).select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"), "s", F.col("centre_s").alias("t")), threshold)


def _band(n: Column, threshold: int) -> Column:
    """Sizes in bands a little wider than the threshold's ratio: two sets that link are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (math.log(100 / threshold) * 1.000001)).cast("int") if threshold < 100 else n.cast("int")


def _sides(own: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The postings as those of a pair's larger set, and of its smaller one, which meets its own band and the next. The smaller set needs few
    of its postings only, as the other's size is no less than its own."""
    band = _band(_n("s"), threshold)
    early = _position("s") <= _n("s") - _need(_n("s"), _n("s"), threshold)
    large, small = own.withColumn("band", band), own.where(early).withColumn("band", F.explode(F.sequence(band, band + 1)))
    return tuple(x.select("token", "band", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "s", "component")]) for x, side in ((large, "a"), (small, "b")))


def _pairs_left(own: DataFrame, threshold: int) -> int:
    """A bound on the pairs that _across compares."""
    large, small = (x.groupBy("token", "band").agg(F.count("*").alias(side)) for x, side in zip(_sides(own, threshold), "ab", strict=True))
    return large.join(small, ["token", "band"]).agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0


def _across(own: DataFrame, lists: DataFrame, threshold: int) -> DataFrame:
    """All pairs of different components: first those with a shingle that may be their first shared one, then, of these, those that share
    as many as their prefixes demand."""
    large, small = _sides(own, threshold)
    ordered = (_n("s_a") > _n("s_b")) | ((_n("s_a") == _n("s_b")) & (F.col("doc_id_a") > F.col("doc_id_b")))
    # conditions on both sides stay in the join, so that it gives no row that they refuse
    rows = large.join(small, ["token", "band"]).where(ordered & (F.col("component_a") != F.col("component_b")) & _may_link("s_a", "s_b", threshold, F.lit(1)))
    pairs = written(rows.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct(), "early")
    bits = marked(pairs.select(F.explode(F.array("a", "b"))))
    own = written(passing(lists.select("doc_id", "token", "s"), bits).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token", "s"))).alias("list")), "prefixes")
    bits.destroy()
    of_a, of_b = (own.select(F.col("doc_id").alias(x), F.col("list").alias(f"of_{x}")) for x in "ab")
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "of_a", "of_b").mapInArrow(lambda batches: _enough(batches, threshold), "a long, b long")


def _enough(batches, threshold: int):
    """(a, b, of_a, of_b): the pairs of which early shingles are shared in the number demanded, as in _candidates."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
            (one, s), (two, t) = ((np.array(z.values.field("token")), np.array(z.values.field("s"))) for z in (x, y))
            low, high = np.searchsorted(one, two, "left"), np.searchsorted(one, two, "right")
            times = high - low
            at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            s, t = s[at], np.repeat(t, times)
            (n_a, most_a, at_a), (n_b, most_b, at_b) = (_unpacked(z) for z in (s, t))
            most = np.minimum(most_a, most_b)
            last_a, last_b = (n - 1 - -(-(n_a + n_b) * threshold // (100 + threshold)) for n in (n_a, n_b))
            early = (at_a <= last_a + most) & (at_b <= last_b + most)
            keep.append(bool(early.any() and early.sum() >= most[early].min() and ((at_a <= last_a + 1) & (at_b <= last_b + 1)).any()))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _more(links: DataFrame, pairs: DataFrame, tried: DataFrame, docs: DataFrame, k: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The links with those among pairs that were not tried before, and what was tried now."""
    fresh = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    return (links if fresh.isEmpty() else _verified(fresh, docs, k, threshold, links)), fresh


def link_components(docs: DataFrame, k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    profiles = written(_profiles(docs, k), "profiles")
    rows = profiles.where(F.col("block").isNull()).select("doc_id", "n", "sig_a", "sig_b")
    classes = written(rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("sig_a", "sig_b", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    sketch = context.broadcast(_sketch(profiles))
    prefixes = _prefixes(docs, k, threshold, sketch).where(F.col("n") > 0).join(reps, "doc_id", "left_semi")
    postings = prefixes.select("doc_id", (F.shiftleft("n", MATCH_BITS + POSITION_BITS) + F.shiftleft("match", POSITION_BITS)).alias("s"), F.posexplode("tokens").alias("pos", "token")).select("token", "pos", "doc_id", (F.col("s") + F.col("pos")).alias("s"))
    dealt = postings.repartitionByRange("token", "pos", "doc_id").sortWithinPartitions("token", "pos", "doc_id").select("token", "doc_id", "s")
    lists = written(dealt.mapInArrow(lambda batches: _lists(batches, threshold), "token long, doc_id long, s long, centre long, centre_s long"), "postings")
    sketch.destroy()

    tried = written(_stars(lists, threshold), "pairs")
    links = _verified(tried, docs, k, threshold)
    labels, own, before = components(links), lists, math.inf
    for turn in range(MAX_STARS + 1):
        own = own.select("token", "doc_id", "s").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        # what can still join two components: the postings of lists that reach over both; a written table lets AQE split a long list
        apart = own.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") < F.col("hi"))
        own = written(own.join(written(apart.select("token"), "open-lists"), "token"), "open-postings")
        left = _pairs_left(own, threshold)
        if turn == MAX_STARS or not left or (turn > 0 and (left > SHRINK * before or left <= PAIRS * own.count())):
            break
        # the earliest of the whole list at first, as borders of partitions cut it before
        centre = own.groupBy("token").agg(F.min(F.struct((_position("s") if turn == 0 else F.lit(0)).alias("first"), F.xxhash64("doc_id", F.lit(turn)).alias("h"), F.col("doc_id").alias("centre"), F.col("s").alias("centre_s"), F.col("component").alias("of_centre"))).alias("c"))
        found = own.join(written(centre.select("token", "c.centre", "c.centre_s", "c.of_centre"), "centres"), "token").where(F.col("component") != F.col("of_centre"))
        links, fresh = _more(links, _stars(found, threshold), tried, docs, k, threshold)
        tried, before, labels = tried.union(fresh), left, components(links)
    many = rows.where(F.col("n") > 0).groupBy("doc_id").agg(F.count("*").alias("c")).where((F.col("c") > 1) & F.col("doc_id").isNotNull())
    # a doc_id with several texts joins the classes of them all
    joins = rows.join(many, "doc_id", "left_semi").join(classes, ["sig_a", "sig_b", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(_more(links, _across(own, lists, threshold), tried, docs, k, threshold)[0].union(joins))
    out = rows.join(classes, ["sig_a", "sig_b", "n"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir).select("doc_id", "text"))

"""Topics: candidate similarity, groups, agglomeration, relations, matching, and the lifecycle of snapshots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from . import set_blocks
from .retrieval import top_k
from .tables import checkpointed
from .vector_blocks import BLOCK_ROWS, best_rows, matrix, paired, sides, slices


def shared_items(items: DataFrame, by: list[str], key: str = "uid", digits: int | None = None) -> DataFrame:
    """Jaccard of all pairs that share an item, rounded to `digits`: (by, a, b, jaccard). items: by, uid, item (distinct rows). Pairs meet block by block (`set_blocks`) by
    hashes of their items, and become rows there with all that they share; work, like the result, grows with the square of a group."""
    known = F.col(key).isNotNull()
    for x in by:
        known = known & F.col(x).isNotNull()
    sets = items.where(known).groupBy(*by, F.col(key).alias("uid")).agg(F.count("*").alias("size"), F.collect_list(F.when(F.col("item").isNotNull(), F.xxhash64("item"))).alias("items"))
    rows = checkpointed(sets.withColumn("__group", F.xxhash64(*by)))
    path, pairs = set_blocks.blocks(rows, "uid")
    kinds = {x: rows.schema[x].dataType for x in (*by, "uid")}

    def run(batches):
        for left, right, same in set_blocks.read_pairs(path, batches):
            shared = set_blocks.shared_counts(set_blocks.sets_of(left, "items"), set_blocks.sets_of(right, "items"), len(left), len(right))
            ga, gb = left["__group"].to_numpy(), right["__group"].to_numpy()
            sa, sb = left["size"].to_numpy(), right["size"].to_numpy()
            ua, ub = left["uid"].to_numpy(), right["uid"].to_numpy()
            step = max(1, set_blocks.SLICE_NUMBERS // len(right))
            for start in range(0, len(left), step):
                i, j = np.nonzero(shared[start : start + step])
                i += start
                keep = (ga[i] == gb[j]) & ((ua[i] < ub[j]) if same else (ua[i] != ub[j]))
                i, j = i[keep], j[keep]
                n = shared[i, j].astype(float)
                swap = ua[i] > ub[j]
                u, w = left["uid"].take(pa.array(i)), right["uid"].take(pa.array(j))
                a, b = (pc.if_else(pa.array(swap), y, x) for x, y in ((u, w), (w, u)))
                if len(i):
                    with np.errstate(divide="raise"):  # only where an item repeats
                        jaccard = n / (sa[i] + sb[j] - n)
                    if digits is not None:
                        jaccard = np.copysign(set_blocks.rounded(np.abs(jaccard), digits) / 10.0**digits, jaccard)
                    out = pa.table({**{x: left[x].take(pa.array(i)) for x in by}, "a": a, "b": b, "jaccard": pa.array(jaccard)})
                    yield from out.to_batches(max_chunksize=set_blocks.SENT_ROWS)

    names = ", ".join(f"`{x}` {kinds[x].simpleString()}" for x in by)
    return pairs.mapInArrow(run, f"{names}, a {kinds['uid'].simpleString()}, b {kinds['uid'].simpleString()}, jaccard double")


#: Weights of the parts of candidate similarity.
PARTS = {"topics": 0.35, "facts": 0.30, "atoms": 0.25, "lexical": 0.25}
SAME_CLUSTER = 0.15


def candidate_similarity(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """features: space, uid, part (a key of PARTS), item. clusters: space, uid, cluster. Score of all pairs that share an item; pairs that
    share only a cluster score 0.15 and need no row here, as they are linked anyway."""
    parts = None
    for part, weight in PARTS.items():
        own = shared_items(features.where(F.col("part") == part).select("space", "uid", "item").distinct(), ["space"]).select("space", "a", "b", (F.col("jaccard") * weight).alias("s"))
        parts = own if parts is None else parts.unionByName(own)
    scored = parts.groupBy("space", "a", "b").agg(F.sum("s").alias("s"))
    ca, cb = clusters.select(F.col("uid").alias("a"), F.col("cluster").alias("ca")), clusters.select(F.col("uid").alias("b"), F.col("cluster").alias("cb"))
    joined = scored.join(ca, "a", "left").join(cb, "b", "left")
    return joined.select("space", "a", "b", F.round(F.least(F.lit(1.0), F.col("s") + F.when(F.col("ca") == F.col("cb"), SAME_CLUSTER).otherwise(0.0)), 9).alias("score"))


def connected(edges: DataFrame, nodes: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(uid, root): the least uid that edges (a, b) reach.

    The graph is contracted: in each round every node goes to the least of its neighbours and itself, in an order hashed anew, and on to where
    that one goes; edges between what is left carry over. A constant share of the nodes goes each round, whatever the shape, and finished
    components drop out. Rounds are written, and the maps are put together from the smallest up, so all nodes are joined once."""
    graph = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not graph.isEmpty():
        if len(maps) == max_rounds:
            raise RuntimeError(f"connected: {max_rounds} rounds do not suffice")
        order = lambda x, k=len(maps): F.struct(F.xxhash64(F.lit(k), x).alias("h"), F.col(x).alias("n"))
        both = graph.union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = checkpointed(both.groupBy("a").agg(F.min(order("b")).alias("low")).select(F.col("a").alias("u"), F.least("low", order("a"))["n"].alias("to")))
        step = checkpointed(first.join(first.select(F.col("u").alias("to"), F.col("to").alias("root")), "to").select("u", "root"))
        maps.append(step)
        ends = graph.join(step.select(F.col("u").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("u").alias("b"), F.col("root").alias("rb")), "b")
        graph = checkpointed(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    uids = nodes.select("uid").distinct()
    if not maps:
        return uids.select("uid", F.col("uid").alias("root"))
    whole = maps[-1]
    for step in reversed(maps[:-1]):
        whole = step.withColumnRenamed("root", "mid").join(whole.select(F.col("u").alias("mid"), "root"), "mid", "left").select("u", F.coalesce("root", "mid").alias("root"))
    named = checkpointed(uids.join(whole.withColumnRenamed("u", "uid"), "uid", "left").select("uid", F.coalesce("root", "uid").alias("rep")))
    return named.join(named.groupBy("rep").agg(F.min("uid").alias("root")), "rep").select("uid", "root")


def candidate_groups(scores: DataFrame, clusters: DataFrame, threshold: float = 0.52) -> DataFrame:
    """(space, uid, root): components of pairs at the threshold, and of clusters, each a star to its first member."""
    star = clusters.withColumn("a", F.min("uid").over(Window.partitionBy("space", "cluster"))).where(F.col("a") != F.col("uid")).select("a", F.col("uid").alias("b"))
    edges = scores.where(F.col("score") >= threshold).select("a", "b").union(star)
    return connected(edges, clusters).join(clusters.select("uid", "space").distinct(), "uid").select("space", "uid", "root")


def _kinds(items: DataFrame, *names: str) -> list[str]:
    return [items.schema[x].dataType.simpleString() for x in names]


def vector_pairs(items: DataFrame, floor: float, by: str = "space", block_rows: int = BLOCK_ROWS, label: str | None = None, minimum: float = 0.0, bonus: float = 0.0) -> DataFrame:
    """Exact cosine of pairs within a space at the floor: (space, a, b, cosine). items: space, uid, embedding. With a label column, also the score, that is the cosine and
    the bonus for equal labels, which must reach the minimum.

    Every item is sent to the pairs of blocks that its block is in; a pair of blocks is one matrix product. Cost grows with the square of a
    space; so does the result at a low floor."""
    extra = [F.col(label).cast("string").alias("__label")] if label else []
    each = paired(items.select(by, "uid", c.unit(F.col("embedding")).alias("__v"), *extra), by, "uid", block_rows)

    def run(table: pa.Table) -> pa.Table:
        left, right, same = sides(table)
        u, w = left["uid"].to_numpy(), right["uid"].to_numpy()
        lu, lw = (left["__label"].to_numpy(), right["__label"].to_numpy()) if label else (None, None)
        out = [[], [], [], []]
        if len(left) and len(right):
            for start, scores in slices(matrix(left["__v"]), matrix(right["__v"])):
                i, j = np.nonzero(~(scores < floor))
                cosine, i = scores[i, j], i + start
                keep = u[i] < w[j] if same else u[i] != w[j]
                score = cosine
                if label:
                    score = np.round(cosine + bonus * ((lu[i] == lw[j]) & (lu[i] != None)), 9)  # noqa: E711  a null label equals none
                    keep = keep & ~(score < minimum)
                for column, values in zip(out, (np.where(u[i] < w[j], u[i], w[j]), np.where(u[i] < w[j], w[j], u[i]), cosine, score), strict=True):
                    column.append(values[keep])
        a, b, cosine, score = (np.concatenate(x) if x else np.array([], float) for x in out)
        ids = table.schema.field("uid").type
        columns = {by: pa.array([table[by][0].as_py()] * len(a), table.schema.field(by).type), "a": pa.array(a, ids), "b": pa.array(b, ids), "cosine": pa.array(cosine, pa.float64())}
        return pa.table(columns | ({"score": pa.array(score, pa.float64())} if label else {}))

    space, uid = _kinds(items, by, "uid")
    return each.groupBy(by, "__dim", "__x", "__y").applyInArrow(run, f"`{by}` {space}, a {uid}, b {uid}, cosine double" + (", score double" if label else ""))


def vector_neighbours(items: DataFrame, floor: float, k: int, by: str = "space", block_rows: int = 2 * BLOCK_ROWS) -> DataFrame:
    """neighbour_rankings of vector_pairs, without the pairs: of each pair of blocks only the k nearest of each item leave it."""
    each = paired(items.select(by, "uid", c.unit(F.col("embedding")).alias("__v")), by, "uid", block_rows)

    def run(table: pa.Table) -> pa.Table:
        left, right, same = sides(table)
        out = [[], [], []]
        for one, two in ((left, right),) if same else ((left, right), (right, left)):
            if not len(one) or not len(two):
                continue
            u, w = one["uid"].to_numpy(), two["uid"].to_numpy()
            for start, scores in slices(matrix(one["__v"]), matrix(two["__v"])):
                scores[scores < floor] = -np.inf
                if same:
                    scores[u[start : start + len(scores), None] == w[None, :]] = -np.inf
                i, j = np.nonzero(best_rows(scores, k))
                for column, values in zip(out, (u[i + start], w[j], scores[i, j]), strict=True):
                    column.append(values)
        uid, other, cosine = (np.concatenate(x) if x else np.array([], float) for x in out)
        ids = table.schema.field("uid").type
        return pa.table({by: pa.array([table[by][0].as_py()] * len(uid), table.schema.field(by).type), "uid": pa.array(uid, ids), "other": pa.array(other, ids), "cosine": pa.array(cosine, pa.float64())})

    space, uid = _kinds(items, by, "uid")
    near = each.groupBy(by, "__dim", "__x", "__y").applyInArrow(run, f"`{by}` {space}, uid {uid}, other {uid}, cosine double")
    return top_k(near, k, by=[by, "uid"], score="cosine", ids=("other",))


def lsh_pairs(items: DataFrame, floor: float, tables: int = 8, width: float = 0.6) -> DataFrame:
    """Approximate vector_pairs by random projections of unit vectors (Spark ML), then the exact cosine; recall depends on tables."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    unit = items.select("space", "uid", c.unit(F.col("embedding")).alias("v")).withColumn("x", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=width, numHashTables=tables, seed=3).fit(unit)
    near = model.approxSimilarityJoin(unit, unit, (2 - 2 * floor) ** 0.5 + 1e-9, "d").where((F.col("datasetA.uid") < F.col("datasetB.uid")) & (F.col("datasetA.space") == F.col("datasetB.space")))
    return near.select(F.col("datasetA.space").alias("space"), F.col("datasetA.uid").alias("a"), F.col("datasetB.uid").alias("b"), F.round(c.dot(F.col("datasetA.v"), F.col("datasetB.v")), 9).alias("cosine")).where(F.col("cosine") >= floor)


def neighbour_rankings(pairs: DataFrame, k: int) -> DataFrame:
    """Each item's k nearest others: space, uid, other, cosine, rank, and the margin to the next."""
    both = pairs.select("space", F.col("a").alias("uid"), F.col("b").alias("other"), "cosine").unionByName(pairs.select("space", F.col("b").alias("uid"), F.col("a").alias("other"), "cosine"))
    return top_k(both, k, by=["space", "uid"], score="cosine", ids=("other",))


def margins(rankings: DataFrame, threshold: float) -> DataFrame:
    w = Window.partitionBy("space", "uid").orderBy(F.col("cosine").desc(), "other")
    return rankings.withColumn("margin", F.col("cosine") - F.coalesce(F.lead("cosine").over(w), F.lit(threshold)))


def pair_scores(pairs: DataFrame, labels: DataFrame, minimum: float = 0.52, bonus: float = 0.08) -> DataFrame:
    """Cosine plus the bonus for equal labels, at the minimum."""
    la, lb = labels.select(F.col("uid").alias("a"), F.col("label").alias("la")), labels.select(F.col("uid").alias("b"), F.col("label").alias("lb"))
    out = pairs.join(la, "a").join(lb, "b").withColumn("score", F.round(F.col("cosine") + F.when(F.col("la") == F.col("lb"), bonus).otherwise(0.0), 9))
    return out.where(F.col("score") >= minimum).select("space", "a", "b", "score")


def seed_edges(scores: DataFrame, strong: float = 0.78, mutual: float = 0.63, rank_mean: float = 0.60, reranked: DataFrame | None = None) -> DataFrame:
    """Edges that may start a merge: strong scores, or fair ones that both sides rank well. reranked: a, b, percentile (directed); without
    it the ranks are those of the scores."""
    both = scores.select("space", "a", "b", "score").unionByName(scores.select("space", F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    if reranked is None:
        w = Window.partitionBy("space", "a")
        n, r = F.count("*").over(w), F.rank().over(w.orderBy(F.col("score").desc()))
        reranked = both.select("a", "b", F.when(n == 1, 1.0).otherwise((n - r) / (n - 1)).alias("percentile"))
    there = reranked.select("a", "b", F.col("percentile").alias("p1"))
    back = reranked.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("percentile").alias("p2"))
    df = scores.join(there, ["a", "b"], "left").join(back, ["a", "b"], "left").withColumn("mean_rank", F.coalesce((F.col("p1") + F.col("p2")) / 2, F.lit(0.0)))
    kind = F.when(F.col("score") >= strong, "strong").when((F.col("score") >= mutual) & (F.least("p1", "p2") >= 0.5), "mutual").when(F.col("mean_rank") >= rank_mean, "ranked")
    return df.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("space", "a", "b", "score", "kind", "mean_rank")


def agglomerate(scores: DataFrame, seeds: DataFrame, nodes: DataFrame, minimum: float = 0.52, mean: float = 0.65, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Merges along seed edges, best first, where the least cross score reaches `minimum` and the mean `mean`; order decides, so a
    component of seed edges is one group. Groups beyond `most` members come back in the second table, unmerged and counted.
    Returns ((root, uid, cluster), (root, n))."""
    roots = connected(seeds.select("a", "b"), nodes)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    too_large = sizes.where(F.col("n") > most)
    kept = roots.join(too_large, "root", "left_anti")
    ra, rb = kept.select(F.col("uid").alias("a"), "root"), kept.select(F.col("uid").alias("b"), F.col("root").alias("rb"))
    inside = scores.join(ra, "a").join(rb, "b").where(F.col("root") == F.col("rb")).join(seeds.select("a", "b", F.lit(True).alias("seed")), ["a", "b"], "left").select("root", "a", "b", "score", "seed")
    alone = kept.select("root", F.col("uid").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("seed"))

    def merge(pdf):
        import pandas as pd

        pairs = pdf[pdf["b"].notna()]
        score = {(int(a), int(b)): s for a, b, s in zip(pairs["a"], pairs["b"], pairs["score"], strict=True)}
        cluster = {int(u): [int(u)] for u in pdf.loc[pdf["b"].isna(), "a"]}
        own = {u: u for u in cluster}
        edges = pairs[pairs["seed"].eq(True)].sort_values(["score", "a", "b"], ascending=[False, True, True])
        for a, b in zip(edges["a"].astype(int), edges["b"].astype(int), strict=True):
            x, y = own[a], own[b]
            if x == y:
                continue
            cross = [score.get((min(i, j), max(i, j)), 0.0) for i in cluster[x] for j in cluster[y]]
            if min(cross) >= minimum and sum(cross) / len(cross) >= mean:
                lo, hi = min(x, y), max(x, y)
                cluster[lo] = cluster[x] + cluster[y]
                for u in cluster[hi]:
                    own[u] = lo
                for u in cluster[lo]:
                    own[u] = lo
                del cluster[hi]
        root = pdf["root"].iloc[0]
        return pd.DataFrame([(root, u, k) for u, k in own.items()], columns=["root", "uid", "cluster"])

    return inside.unionByName(alone).groupBy("root").applyInPandas(merge, "root long, uid long, cluster long"), too_large


def clusters_of_all(scores: DataFrame, seeds: DataFrame, nodes: DataFrame, minimum: float = 0.52, mean: float = 0.65, most: int = 5000) -> DataFrame:
    """(root, uid, cluster, unmerged) of every node: agglomerate's clusters, and the nodes of components beyond `most`, each its own
    cluster and marked as unmerged."""
    seeds = checkpointed(seeds)
    clusters, too_large = agglomerate(scores, seeds, nodes, minimum, mean, most)
    large = connected(seeds.select("a", "b"), nodes).join(too_large, "root", "left_semi")
    return clusters.withColumn("unmerged", F.lit(False)).unionByName(large.select("root", "uid", F.col("uid").alias("cluster"), F.lit(True).alias("unmerged")))


#: Edges left of a group up to which one task chooses among them.
LOCAL_EDGES = 4_000_000


def _choose(degree: int, bonus: float):
    """The greedy choice of `bounded_edges` among all rows (a, b, score, da, db) of a table, da and db being what the ends have already."""

    def run(table: pa.Table) -> pa.Table:
        names = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().to_numpy(zero_copy_only=False)
        names, ends = np.unique(names, return_inverse=True)
        a, b = ends[: len(table)], ends[len(table) :]
        have = np.zeros(len(names), np.int64)
        have[a], have[b] = table["da"].to_numpy(), table["db"].to_numpy()
        score, rows = table["score"].to_numpy(), np.arange(len(table))
        chosen = []
        while len(rows):
            x, y = a[rows], b[rows]
            value = score[rows] + bonus * ((have[x] == 0).astype(int) + (have[y] == 0))
            place = np.empty(len(rows), np.int64)
            place[np.lexsort((y, x, -np.copysign(set_blocks.rounded(np.abs(value), 9), value)))] = np.arange(len(rows))
            best = np.full(len(names), len(rows))
            np.minimum.at(best, x, place)
            np.minimum.at(best, y, place)
            take = (best[x] == place) & (best[y] == place)
            chosen.append(rows[take])
            have += np.bincount(x[take], minlength=len(names)) + np.bincount(y[take], minlength=len(names))
            rows = rows[~take & (have[x] < degree) & (have[y] < degree)]
        return table.select(["a", "b", "score"]).take(pa.array(np.concatenate(chosen) if chosen else np.empty(0, np.int64)))

    return run


def bounded_edges(edges: DataFrame, degree: int = 3, bonus: float = 0.10, by: str | None = None, local: int | None = None) -> DataFrame:
    """Greedy choice by score + bonus per uncovered endpoint, at most `degree` edges a node. edges: a, b, score, and maybe `by`, a group that holds whole components.

    In rounds: an edge that is the best left at both its ends is taken. An edge's value depends only on its ends and only falls, so
    this chooses what one edge at a time would; ties are broken by (a, b). How many rounds there are depends on the scores, but the edges left get
    fewer, and once no group has more than `local` of them a task finishes each group."""
    local = LOCAL_EDGES if local is None else local
    left = checkpointed(edges.select("a", "b", "score", (F.xxhash64(by) if by else F.lit(0).cast("long")).alias("__by")).distinct())
    taken = checkpointed(left.limit(0).drop("__by"))
    while True:
        ends = taken.select(F.col("a").alias("u")).union(taken.select("b")).groupBy("u").agg(F.count("*").cast("int").alias("d"))
        da, db = ends.select(F.col("u").alias("a"), F.col("d").alias("da")), ends.select(F.col("u").alias("b"), F.col("d").alias("db"))
        live = checkpointed(left.join(da, "a", "left").join(db, "b", "left").fillna(0, ["da", "db"]).where((F.col("da") < degree) & (F.col("db") < degree)))
        if (live.groupBy("__by").count().agg(F.max("count")).first()[0] or 0) <= local:
            kinds = ", ".join(f"{x} {live.schema[x].dataType.simpleString()}" for x in ("a", "b", "score"))
            return checkpointed(taken.unionByName(live.groupBy("__by").applyInArrow(_choose(degree, bonus), kinds)))
        value = F.round(F.col("score") + bonus * ((F.col("da") == 0).cast("int") + (F.col("db") == 0).cast("int")), 9)
        live = live.select("a", "b", "score", "__by", F.struct((-value).alias("v"), "a", "b").alias("k"))
        ranked = live.select("*", F.explode(F.array("a", "b")).alias("u")).withColumn("best", F.min("k").over(Window.partitionBy("u")))
        chosen = checkpointed(ranked.groupBy("a", "b", "score", "__by").agg(F.bool_and(F.col("k") == F.col("best")).alias("take")))
        taken = checkpointed(taken.unionByName(chosen.where("take").select("a", "b", "score")))
        left = chosen.where(~F.col("take")).drop("take")


def orphan_swaps(chosen: DataFrame, eligible: DataFrame, nodes: DataFrame, degree: int = 3) -> DataFrame:
    """Connects nodes without a chosen edge: their best eligible edge displaces the weakest edge at a full partner, if that edge's other
    end keeps one. chosen, eligible: a, b, score. Returns a, b, score: of all components, whatever their size.

    No swap leaves a node without an edge, so only eligible edges at nodes that have none at first can enter. A group is a component of
    these and the chosen edges, at most `degree` a node; chosen edges of components without such a node stay as they are."""
    on = checkpointed(chosen.select("a", "b", "score"))
    ends = on.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    lone = nodes.select("uid").distinct().join(ends, "uid", "left_anti")
    la, lb = lone.select(F.col("uid").alias("a"), F.lit(True).alias("la")), lone.select(F.col("uid").alias("b"), F.lit(True).alias("lb"))
    entering = checkpointed(eligible.select("a", "b", "score").join(la, "a", "left").join(lb, "b", "left").where("la or lb").select("a", "b", "score"))
    both = on.withColumn("on", F.lit(True)).unionByName(entering.withColumn("on", F.lit(False)))
    roots = connected(both.select("a", "b"), both.select(F.explode(F.array("a", "b")).alias("uid")))
    marked = both.join(roots.withColumnRenamed("uid", "a"), "a")
    swapping = marked.where(~F.col("on")).select("root").distinct()

    def swap(pdf):
        on = {(a, b): s for a, b, s, x in zip(pdf["a"], pdf["b"], pdf["score"], pdf["on"].eq(True), strict=True) if x}
        edges = sorted(zip(pdf["score"], pdf["a"], pdf["b"], strict=True), key=lambda e: (-e[0], e[1], e[2]))
        deg: dict[int, int] = {}
        at: dict[int, set[tuple[int, int]]] = {}
        for a, b in on:
            deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
            at.setdefault(a, set()).add((a, b))
            at.setdefault(b, set()).add((a, b))
        for score, a, b in edges:
            if (a, b) in on or not ({a, b} & {x for x in (a, b) if not deg.get(x)}):
                continue
            other = b if not deg.get(a) else a
            if deg.get(other, 0) >= degree:
                loose = sorted((on[e], e) for e in at[other] if deg[e[0] if e[1] == other else e[1]] > 1)
                if not loose:
                    continue
                out = loose[0][1]
                del on[out]
                for x in out:
                    deg[x] -= 1
                    at[x].discard(out)
            on[(a, b)] = score
            deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
            at.setdefault(a, set()).add((a, b))
            at.setdefault(b, set()).add((a, b))
        import pandas as pd

        return pd.DataFrame([(a, b, s) for (a, b), s in on.items()], columns=["a", "b", "score"])

    swapped = marked.join(swapping, "root", "left_semi").groupBy("root").applyInPandas(swap, "a long, b long, score double")
    return swapped.unionByName(marked.join(swapping, "root", "left_anti").select("a", "b", "score"))


def centroid(df: DataFrame, by: list[str], embedding: str = "embedding") -> DataFrame:
    """Mean vector of each group, as sums per place: nothing of a group is collected but one row per dimension."""
    each = df.select(*by, F.posexplode(embedding).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def merge_atoms(atoms: DataFrame) -> DataFrame:
    """atoms: topic_id, kind, content, importance, confidence, timeline. One row per (topic, kind, canonical content)."""
    keyed = atoms.withColumn("fingerprint", c.fingerprint(F.col("content")))
    out = keyed.groupBy("topic_id", "kind", "fingerprint").agg(F.min("content").alias("content"), F.max("importance").alias("importance"), F.max("confidence").alias("confidence"), F.countDistinct("timeline").alias("n_sources"))
    return out.withColumn("calibrated", (F.col("confidence") * F.col("n_sources") + 1.2) / (F.col("n_sources") + 2))


def link_weights(links: DataFrame) -> DataFrame:
    """links: topic_id, timeline, cluster, confidence (null: none). Contribution least(1, 0.6 + 0.4 / n), affinity 1 / n, n the topic's links
    in the cluster; similarity is the mean confidence, 0.5 without."""
    per = links.groupBy("topic_id", "timeline", "cluster").agg(F.coalesce(F.avg("confidence"), F.lit(0.5)).alias("similarity"))
    n = F.count("*").over(Window.partitionBy("topic_id", "cluster"))
    return per.withColumn("contribution", F.least(F.lit(1.0), 0.6 + 0.4 / n)).withColumn("affinity", 1 / n)


def collision_free(fragments: DataFrame) -> DataFrame:
    """Fragments of one uid get a uid of uid and meaning; single ones keep theirs. fragments: uid, semantic."""
    n = F.count("*").over(Window.partitionBy("uid"))
    return fragments.withColumn("__n", n).withColumn("final_uid", F.when(F.col("__n") > 1, F.sha1(F.concat_ws(":", "uid", "semantic"))).otherwise(F.col("uid"))).drop("__n")


def stale_links(links: DataFrame, changed: DataFrame) -> DataFrame:
    """Links of changed timelines (timeline, revision) whose revision is older are stale; and so are topics with one."""
    out = links.join(changed.select("timeline", F.col("revision").alias("__now")), "timeline", "left")
    return out.withColumn("status", F.when(F.col("__now") > F.col("revision"), "stale").otherwise(F.col("status"))).drop("__now")


def archive_outside(topics: DataFrame, build: DataFrame) -> DataFrame:
    """Topics that a build does not hold are archived."""
    return topics.join(build.select("topic_id", F.lit(True).alias("__in")).distinct(), "topic_id", "left").withColumn("status", F.when(F.col("__in"), F.col("status")).otherwise("archived")).drop("__in")


def drop_archived(topics: DataFrame, links: DataFrame, fragments: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes chosen archived topics, their links, and fragments that nothing links to any more (only those once linked to one)."""
    gone = topics.where(F.col("status") == "archived").join(chosen, "topic_id", "left_semi").select("topic_id")
    kept = links.join(gone, "topic_id", "left_anti")
    orphaned = links.join(gone, "topic_id", "left_semi").select("fragment_id").distinct().join(kept.select("fragment_id"), "fragment_id", "left_anti")
    return topics.join(gone, "topic_id", "left_anti"), kept, fragments.join(orphaned, "fragment_id", "left_anti")


def unindexed(memories: DataFrame, links: DataFrame, active_topics: DataFrame) -> DataFrame:
    """Memories (uid, revision, space) without a link of their revision to an active topic."""
    live = links.join(active_topics.select("topic_id"), "topic_id", "left_semi").select("uid", "revision", "space")
    return memories.join(live, ["uid", "revision", "space"], "left_anti")


def incremental_scope(memories: DataFrame, links: DataFrame, active_topics: DataFrame) -> DataFrame:
    """(kind, id): memories to index, and topics linked to an older revision of one."""
    new = unindexed(memories, links, active_topics)
    touched = links.join(new.select("uid"), "uid", "left_semi").join(active_topics.select("topic_id"), "topic_id", "left_semi").select("topic_id").distinct()
    return new.select(F.lit("memory").alias("kind"), F.col("uid").alias("id")).unionByName(touched.select(F.lit("topic").alias("kind"), F.col("topic_id").alias("id")))


def novel_facts(facts: DataFrame, parent_facts: DataFrame, near: float = 0.90, contained: int = 12) -> DataFrame:
    """facts (parent, fact_id, content) that are not equal to, contained in (from 12 characters), or near a fact of their parent
    (parent, content)."""
    f = facts.withColumn("__c", c.canonical_text(F.col("content"))).withColumn("__f", c.retrieval_features(F.col("content")))
    p = parent_facts.select("parent", c.canonical_text(F.col("content")).alias("__pc"), c.retrieval_features(F.col("content")).alias("__pf"))
    known = f.join(p, "parent").where((F.col("__c") == F.col("__pc")) | ((F.length("__c") >= contained) & F.col("__pc").contains(F.col("__c"))) | (c.jaccard(F.col("__f"), F.col("__pf")) >= near))
    return facts.join(known.select("parent", "fact_id").distinct(), ["parent", "fact_id"], "left_anti")


def dominant_label(groups: DataFrame) -> DataFrame:
    """Most frequent label of each group, ties by name. groups: root, label."""
    n = groups.groupBy("root", "label").agg(F.count("*").alias("score"))
    return top_k(n, 1, by=["root"], ids=("label",)).select("root", "label", F.col("score").alias("n"))


def actor_rollup(mentions: DataFrame) -> DataFrame:
    """mentions: topic_id, actor, role, confidence. Roles, best confidence, and whether the actor took part."""
    roles: Column = F.array_sort(F.collect_set("role"))
    return mentions.groupBy("topic_id", "actor").agg(roles.alias("roles"), F.max("confidence").alias("confidence")).withColumn("participant", F.arrays_overlap("roles", F.array(F.lit("speaker"), F.lit("narrator"), F.lit("responder"))))

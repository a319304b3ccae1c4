"""Products of vectors block by block: rows dealt to blocks of bounded size, one matrix product a pair of blocks, so no pair of vectors is a Spark row before it counts.

A group is one pair of blocks of one key. The number of blocks follows the counted rows, so a group stays of one size however large the
input; the product inside is taken by slices of SLICE_NUMBERS scores. Scores are rounded to nine digits. Work is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, numbers in a slice of scores, and the most tasks that pairs of blocks are dealt to.
BLOCK_ROWS, SLICE_NUMBERS, TASKS = 4096, 2_000_000, 2_000


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column, all of one length, as rows."""
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(rows), len(flat) // max(1, len(rows)))


def slices(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rounded scores) of runs of rows of left with all of right."""
    step = max(1, SLICE_NUMBERS // max(1, len(right)))
    for start in range(0, len(left), step):
        yield start, np.round(left[start : start + step] @ right.T, 9)


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Which scores are among the k best of their row, ties with the last included; -inf never is."""
    if scores.shape[1] > k:
        floor = np.partition(scores, -k, axis=1)[:, -k]
        return (scores >= floor[:, None]) & (scores > -np.inf)
    return scores > -np.inf


def n_blocks(rows: int, size: int = BLOCK_ROWS) -> int:
    return max(1, -(-rows // size))


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def in_each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _most(df: DataFrame, on: list[str]) -> tuple[int, int, int]:
    """Rows of the largest key, how many keys, and all rows."""
    count = df.groupBy(*on).count().agg(F.max("count").alias("most"), F.count("*").alias("keys"), F.sum("count").alias("rows")).first()
    return count["most"] or 0, count["keys"], count["rows"] or 0


def _tasks(df: DataFrame, groups: int, rows: int) -> int:
    """Tasks for groups of blocks: not more than groups, nor so many that they hold next to nothing."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(TASKS, groups, max(usual, -(-rows // BLOCK_ROWS))))


def paired(items: DataFrame, by: str, key: str, size: int = BLOCK_ROWS) -> DataFrame:
    """items (by, key, __v and others) once for each pair of blocks that their block is in: with __blk and the pair, __x <= __y; __dim is the vectors' length."""
    held = items.where(F.col("__v").isNotNull() & F.col(by).isNotNull() & F.col(key).isNotNull())
    most, keys, rows = _most(held, [by])
    n = n_blocks(most, size)
    each = held.withColumn("__dim", F.size("__v")).withColumn("__blk", block_of(key, n)).withColumn("__other", in_each(n))
    each = each.withColumns({"__x": F.least("__blk", "__other"), "__y": F.greatest("__blk", "__other")}).drop("__other")
    return each.repartition(_tasks(items, keys * n * (n + 1) // 2, rows * n), by, "__dim", "__x", "__y")


def sides(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The two blocks of a group of `paired`, and whether they are the same."""
    x, y = table["__x"][0].as_py(), table["__y"][0].as_py()
    return table.filter(pc.equal(table["__blk"], x)), table.filter(pc.equal(table["__blk"], y)), x == y


def met(rows: DataFrame, probes: DataFrame, on: tuple[str, ...] = (), scope: tuple[str, ...] = (), k: int | None = None, floor: float | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """(on, query_id, doc_id, score) of probes with the rows of their key: each probe's k best of each block with all ties, or all from `floor` on whose query_id is less.

    rows: on, doc_id, scope columns, __v; probes: on, query_id, __q_ scope columns (null: no restriction), __q; keys are not null. Rows go to blocks four times as large as probes."""
    held, asked = rows.where(F.col("__v").isNotNull()), probes.where(F.col("__q").isNotNull())
    (most_rows, keys, all_rows), (most_probes, _, all_probes) = _most(held, list(on)), _most(asked, list(on))
    ni, nq = n_blocks(most_rows, 4 * size), n_blocks(most_probes, size)
    dealt = lambda key, v, n: F.pmod(F.xxhash64(key, v), F.lit(n)).cast("int")
    own = held.select(*on, F.lit(False).alias("__probe"), "doc_id", F.lit(None).cast(probes.schema["query_id"].dataType).alias("query_id"), *scope, *[F.lit(None).cast(probes.schema["__q_" + x].dataType).alias("__q_" + x) for x in scope], F.col("__v"), dealt("doc_id", "__v", ni).alias("__y"), in_each(nq).alias("__x"))
    theirs = asked.select(*on, F.lit(True).alias("__probe"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "query_id", *[F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in scope], *["__q_" + x for x in scope], F.col("__q").alias("__v"), dealt("query_id", "__q", nq).alias("__x"), in_each(ni).alias("__y"))
    key = [*on, "__dim", "__x", "__y"]
    both = own.unionByName(theirs).withColumn("__dim", F.size("__v")).repartition(_tasks(rows, keys * ni * nq, all_rows * nq + all_probes * ni), *key)

    def run(table: pa.Table) -> pa.Table:
        left, right = table.filter(table["__probe"]), table.filter(pc.invert(table["__probe"]))
        at, to, score = [], [], []
        if len(left) and len(right):
            q, v = left["query_id"].to_numpy(), right["doc_id"].to_numpy()
            for start, scores in slices(matrix(left["__v"]), matrix(right["__v"])):
                part = slice(start, start + len(scores))
                for x in scope:
                    asks, has = left["__q_" + x].to_numpy()[part], right[x].to_numpy()
                    free = left["__q_" + x].is_null().to_numpy()[part]
                    scores[~((asks[:, None] == has[None, :]) | free[:, None])] = -np.inf
                i, j = np.nonzero(best_rows(scores, k) if k else ~(scores < floor) & (q[part, None] < v[None, :]))
                at.append(i + start)
                to.append(j)
                score.append(scores[i, j])
        at, to = (np.concatenate(x) if x else np.array([], int) for x in (at, to))
        columns = {x: pa.array([table[x][0].as_py()] * len(at), table.schema.field(x).type) for x in on}
        return pa.table(columns | {"query_id": left["query_id"].take(pa.array(at)), "doc_id": right["doc_id"].take(pa.array(to)), "score": pa.array(np.concatenate(score) if score else [], pa.float64())})

    kinds = ", ".join(f"`{x}` {both.schema[x].dataType.simpleString()}" for x in (*on, "query_id", "doc_id"))
    return both.groupBy(*key).applyInArrow(run, kinds + ", score double")

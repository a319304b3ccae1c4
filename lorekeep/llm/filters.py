"""Filters that tell which documents may matter to a later step, so that all others need not move.

A filter never rejects a marked document; what passes by chance is harmless to its users. It has eight bits for each marked row, up to
16 MB: on tables with more than some tens of millions of marked rows it lets more through, which costs a shuffle and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from ._text import U, mix

LEAST_LOG, MOST_LOG = 16, 27


def marked(ids: DataFrame) -> Broadcast:
    """A broadcast bitmap with the hashes of the doc_ids: a filter that passes every one of them and some others."""
    log = min(MOST_LOG, max(LEAST_LOG, (8 * ids.count()).bit_length()))

    def run(batches):
        bits = np.zeros(1 << (log - 3), np.uint8)
        for batch in batches:
            at = _place(batch.column(0), log)
            np.bitwise_or.at(bits, at >> 3, _bit(at))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(1 << (log - 3), np.uint8)
    for r in ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out)


def _bit(at: np.ndarray) -> np.ndarray:
    return np.right_shift(np.uint8(128), (at & 7).astype(np.uint8))


def _place(ids: pa.Array, log: int) -> np.ndarray:
    return (mix(np.array(ids.fill_null(0)).astype(np.int64).view(U)) >> U(64 - log)).astype(np.int64)


def only(batch: pa.RecordBatch, bits: np.ndarray, others: bool = False) -> pa.RecordBatch:
    """The rows of the batch that pass (or, with others, the rest)."""
    at = _place(batch.column("doc_id"), (8 * len(bits)).bit_length() - 1)
    return batch.filter(pa.array(((bits[at >> 3] & _bit(at)) > 0) != others))


def passing(df: DataFrame, shared: Broadcast, others: bool = False) -> DataFrame:
    """The rows whose doc_id passes the filter (or, with others, the rest), without a shuffle."""

    def run(batches):
        bits = shared.value
        for batch in batches:
            yield only(batch, bits, others)

    return df.mapInArrow(run, df.schema)

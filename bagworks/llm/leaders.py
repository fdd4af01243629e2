"""Most frequent items among billions: external sort and run-length counting.

Occurrences are range-partitioned by their whole key (owner, term, record, slot), so that even one term with a third of all rows is
spread over many ranges, and sorted there by Spark's spilling sort. One pass over each sorted range drops redelivered copies,
combines equal neighbours to run lengths and keeps a bounded heap per owner. The runs at a range's two ends may go on next door;
they are passed on as parts beside the heap and added up at the end, so the counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.llm.arrays import changes, column, pack, sum_by_key, unpack
from bagworks.session import checked_broadcast, materialize

_SCHEMA = "owner int, term int, n bigint"


def _top(key: np.ndarray, n: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` greatest counts of each owner; ties go to the lower term."""
    owner = key >> 32
    order = np.lexsort((key, -n, owner))
    key, n, owner = key[order], n[order], owner[order]
    start = np.flatnonzero(changes(owner))
    rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return key[rank < keep], n[rank < keep]


def run_lengths(occ: DataFrame, keep: int) -> DataFrame:
    """(owner, term, n): for each range its `keep` longest complete runs of each owner, the parts of runs at its ends, and, with a
    null term, each owner's occurrences."""

    def emit(owner, term, n) -> pa.RecordBatch:
        t = pa.nulls(len(owner), pa.int32()) if term is None else pa.array(term, pa.int32())
        return pa.record_batch([pa.array(owner, pa.int32()), t, pa.array(n, pa.int64())], names=["owner", "term", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_key, open_n, at_start = None, None, 0, True
        heap_k, heap_n, size = [], [], 0
        tot_k, tot_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            cols = [column(b, c) for c in ("owner", "term", "record", "slot")]
            new = changes(*cols)
            if last is not None:
                new[0] = any(c[0] != p for c, p in zip(cols, last))
            last = [c[-1] for c in cols]
            key = pack(cols[0], cols[1])
            at = np.flatnonzero(changes(key))
            keys, n = key[at], np.add.reduceat(new.astype(np.int64), at)
            tot_k, tot_n = sum_by_key(np.concatenate((tot_k, keys >> 32)), np.concatenate((tot_n, n)))
            if open_key is not None and keys[0] == open_key:
                n[0] += open_n
            elif open_key is not None:
                keys, n = np.concatenate(([open_key], keys)), np.concatenate(([open_n], n))
            if at_start and len(keys) > 1:  # the range's first run
                o, t = unpack(keys[:1])
                yield emit(o, t, n[:1])
                keys, n, at_start = keys[1:], n[1:], False
            open_key, open_n = keys[-1], n[-1]
            heap_k.append(keys[:-1])
            heap_n.append(n[:-1])
            size += len(keys) - 1
            if size > 1 << 18:
                k, n = _top(np.concatenate(heap_k), np.concatenate(heap_n), keep)
                heap_k, heap_n = [k], [n]
                size = len(k) if len(k) < 1 << 17 else 0  # with very many owners the heaps of those passed go out
                if not size:
                    o, t = unpack(k)
                    yield emit(o, t, n)
                    heap_k, heap_n = [], []
        if open_key is not None:
            o, t = unpack(np.array([open_key]))
            yield emit(o, t, np.array([open_n]))
        if size:
            k, n = _top(np.concatenate(heap_k), np.concatenate(heap_n), keep)
            o, t = unpack(k)
            yield emit(o, t, n)
        if len(tot_k):
            yield emit(tot_k, None, tot_n)

    cols = ["owner", "term", "record", "slot"]
    return occ.select(*cols).repartitionByRange(*cols).sortWithinPartitions(*cols).mapInArrow(merge, _SCHEMA)


def leading_terms(occ: DataFrame, share: float) -> DataFrame:
    """(owner, term, occurrences, owner_occurrences) of the terms with at least `share` of their owner's occurrences, exact.

    At most 1/share terms of an owner can reach the share, so heaps of that size lose none. occ: (owner INT, record BIGINT, term
    INT, slot INT); repeated rows count once; an empty table gives no row.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    runs = materialize(run_lengths(occ, math.ceil(1 / share)))
    total = runs.where("term is null").groupBy("owner").agg(F.sum("n").alias("owner_occurrences"))
    counts = runs.where("term is not null").groupBy("owner", "term").agg(F.sum("n").alias("occurrences"))
    return counts.join(checked_broadcast(total), "owner").where(F.col("occurrences") >= F.col("owner_occurrences") * F.lit(share * (1 - 1e-12))).select("owner", "term", "occurrences", "owner_occurrences")

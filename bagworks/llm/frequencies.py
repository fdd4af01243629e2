"""Frequency of every distinct term: heavy-light aggregation.

Rows are brought together by record once, sorted there, and redelivered copies dropped on the way through the sorted stream. Each
task counts the heavy terms in exact local counter arrays over a broadcast dictionary of bounded size; only the remaining terms
are shuffled row by row; the two count tables are united in one exchange. Which terms are heavy is only a matter of speed: both
ways count exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.llm.arrays import changes, column, pack, unpack

#: Most terms that are counted in local arrays: the size of what is broadcast and of each task's counters.
HEAVY_TERMS = 4096
#: One record in so many is looked at to detect the heavy terms.
DETECT_IN = 64


def heavy_terms(occ: DataFrame, limit: int = HEAVY_TERMS, detect_in: int = DETECT_IN) -> np.ndarray:
    """Sorted packed (owner, term) keys, at most `limit`, of the terms that lead in one record of `detect_in`, by hash of record."""
    part = occ.where(F.pmod(F.xxhash64("record"), F.lit(detect_in)) == 0)
    top = part.groupBy("owner", "term").agg(F.count(F.lit(1)).alias("n")).where("n >= 16").orderBy(F.desc("n"), "owner", "term").limit(limit).collect()
    return np.sort(pack(np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top], np.int64)))


def term_frequencies(occ: DataFrame, heavy: np.ndarray | None = None) -> DataFrame:
    """(owner, term, occurrences, records) of a table (owner INT, record BIGINT, term INT, slot INT).

    Exact counts of distinct (record, term, slot) and distinct (record, term). A row with a null term gives, as `records`, the
    owner's records with at least one term. Repeated rows count once; an empty table gives no row.
    """
    spark = occ.sparkSession
    shared = spark.sparkContext.broadcast(heavy_terms(occ) if heavy is None else np.sort(np.asarray(heavy, np.int64)))
    schema = "owner int, term int, occurrences bigint, records bigint"

    def emit(owner, term, n, df, none=False) -> pa.RecordBatch:
        t = pa.nulls(len(owner), pa.int32()) if none else pa.array(term, pa.int32())
        return pa.record_batch([pa.array(owner, pa.int32()), t, pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["owner", "term", "occurrences", "records"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        occurrences, records = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
        totals: dict[int, int] = {}
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [column(b, c) for c in ("owner", "record", "term", "slot")]
            if last is not None:  # the row before the batch stands in front of it, so that what goes on isn't new
                cols = [np.concatenate(([p], c)) for p, c in zip(last, cols)]
            last_now = [c[-1] for c in cols]
            new_record, new_term, new_row = changes(*cols[:2]), changes(*cols[:3]), changes(*cols)
            if last is not None:
                new_record[0] = new_term[0] = new_row[0] = False
            last = last_now
            owners, n = np.unique(cols[0][new_record], return_counts=True)
            for o, k in zip(owners.tolist(), n.tolist()):
                totals[o] = totals.get(o, 0) + k
            if len(totals) > 100_000:
                yield emit(np.fromiter(totals, np.int64), None, np.zeros(len(totals), np.int64), np.fromiter(totals.values(), np.int64), none=True)
                totals = {}
            key, first = pack(cols[0], cols[2])[new_row], new_term[new_row]
            at = np.searchsorted(keys, key)
            is_heavy = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key) if len(keys) else np.zeros(len(key), bool)
            occurrences += np.bincount(at[is_heavy], minlength=len(occurrences))
            records += np.bincount(at[is_heavy & first], minlength=len(records))
            light = ~is_heavy
            if light.any():
                o, t = unpack(key[light])
                yield emit(o, t, np.ones(len(o), np.int64), first[light].astype(np.int64))
        met = np.flatnonzero(occurrences)
        if len(met):
            o, t = unpack(keys[met])
            yield emit(o, t, occurrences[met], records[met])
        if totals:
            yield emit(np.fromiter(totals, np.int64), None, np.zeros(len(totals), np.int64), np.fromiter(totals.values(), np.int64), none=True)

    together = occ.repartition("owner", "record").sortWithinPartitions("owner", "record", "term", "slot")
    counted = together.mapInArrow(count, schema)
    return counted.groupBy("owner", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))

"""Items that appear together: a blocked Gram matrix of binary record-item blocks.

The items of an owner are dealt into item blocks, its records into record blocks. A record is sent once to each item block that
holds one of its items, with the items that follow; a task sums the transpose-products of one item block's rows over its record
blocks, so nearly all adding happens before anything is written. Blocks that hold all records of their owner are complete and drop
pairs below the wanted support at once; parts of split record blocks are added up by pair.

Two bounds prune without losing a pair: an item with fewer records than the wanted support is in no such pair, and with lift
wanted, neither is one with more than n / lift records, as c(a,b) <= c(a).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.llm.arrays import column, lists, mix64, pack, sum_by_key, unpack
from bagworks.session import materialize

#: The dictionary of kept items is broadcast up to so many rows (24 bytes each); beyond, records are filtered by a join.
DICTIONARY_ROWS = 2_000_000
#: Items in an item block, and records in a record block, of one owner, about.
ITEM_BLOCK, RECORD_BLOCK = 1024, 4_000_000
#: A task folds its pair instances into counts whenever it holds so many, and hands counts on when it holds so many of them.
FOLD, HELD = 2_000_000, 8_000_000


def _kept(base: DataFrame, min_support: int, min_lift: float) -> tuple[DataFrame, DataFrame]:
    """(owner, item, c, n, blocks, salts) of the items that can be in a pair, and (owner, n)."""
    n = base.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    single = base.select("owner", F.explode(F.array_distinct("items")).alias("item")).groupBy("owner", "item").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_support)
    single = single.join(n, "owner")
    if min_lift > 0:
        single = single.where(F.col("c") * F.lit(float(min_lift)) <= F.col("n") * F.lit(1 + 1e-12))
    kept = materialize(single)
    size = kept.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / ITEM_BLOCK).cast("int").alias("blocks"), F.ceil(F.max("n") / RECORD_BLOCK).cast("int").alias("salts"))
    return kept, size


def _expand(owner, off, items, record, blocks, salts) -> pa.RecordBatch | None:
    """For every record and item block: the record's items from its first item in that block on. Items are sorted in a record."""
    lens = np.diff(off)
    rec = np.repeat(np.arange(len(lens)), lens)
    blk = (mix64(items.astype(np.int64)) % np.maximum(blocks[rec], 1).astype(np.uint64)).astype(np.int64)
    pos = np.arange(len(items))
    order = np.lexsort((pos, blk, rec))
    r, b = rec[order], blk[order]
    first = np.ones(len(order), bool)
    first[1:] = (r[1:] != r[:-1]) | (b[1:] != b[:-1])
    at = order[first]
    at = at[off[rec[at] + 1] - at >= 2]  # the last item of a record has no partner
    if not len(at):
        return None
    n = off[rec[at] + 1] - at
    out_off = np.concatenate(([0], np.cumsum(n)))
    flat = items[np.repeat(at - out_off[:-1], n) + np.arange(out_off[-1])]
    o = owner[rec[at]]
    salt = (mix64(record[rec[at]]) % np.maximum(salts[rec[at]], 1).astype(np.uint64)).astype(np.int32)
    arr = pa.ListArray.from_arrays(pa.array(out_off, pa.int32()), pa.array(flat, pa.int32()))
    return pa.record_batch([pa.array(o, pa.int32()), pa.array(blk[at], pa.int32()), pa.array(salt, pa.int32()), pa.array(blocks[rec[at]], pa.int32()), pa.array(salts[rec[at]] > 1, pa.bool_()), arr], names=["owner", "block", "salt", "blocks", "split", "items"])


def _products(off, items, in_block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a, b), a before b in a record and a in the block: one diagonal of the record blocks' products after another, in pieces
    of about FOLD pairs, so neither many nor very long records are held as pairs at once."""
    end = np.repeat(off[1:], np.diff(off))
    own = np.flatnonzero(in_block)
    before = np.cumsum(end[own] - own - 1)
    cuts = np.flatnonzero(np.diff(before // FOLD)) + 1
    for a_at in np.split(own, cuts):
        a, b, d = [], [], 1
        while len(a_at):
            a_at = a_at[a_at + d < end[a_at]]
            a.append(items[a_at])
            b.append(items[a_at + d])
            d += 1
        if a:
            yield np.concatenate(a), np.concatenate(b)


def pair_counts(base: DataFrame, min_support: int = 1, min_lift: float = 0.0, *, dictionary_rows: int = DICTIONARY_ROWS) -> DataFrame:
    """(owner, item_a, item_b, c_ab, c_a, c_b, n): item_a < item_b, in how many records they stand together, singly, and of how many.

    base: (owner INT, record BIGINT, items ARRAY<INT>), each record once, items sorted without nulls; repeats inside a record count
    once. Pairs with c_ab >= min_support and c_ab * n >= min_lift * c_a * c_b, all of them, exact. Without lift wanted every pair
    with the support comes out. Empty tables give no row.
    """
    if min_support < 1:
        raise ValueError("min_support must be at least 1")
    spark = base.sparkSession
    base = base.select("owner", "record", F.array_distinct("items").alias("items"))
    kept, size = _kept(base, min_support, min_lift)
    few = kept.limit(dictionary_rows + 1).count() <= dictionary_rows
    sizes = kept.join(size, "owner").select("owner", "item", "blocks", "salts")
    out_schema = "owner int, block int, salt int, blocks int, split boolean, items array<int>"

    if few:
        t = sizes.toArrow()
        key = pack(column(t, "owner"), column(t, "item")) if t.num_rows else np.zeros(0, np.int64)
        order = np.argsort(key)
        known = spark.sparkContext.broadcast((key[order], column(t, "blocks", np.int32)[order], column(t, "salts", np.int32)[order]) if t.num_rows else (key, key.astype(np.int32), key.astype(np.int32)))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, blocks, salts = known.value
            for b in batches:
                if not b.num_rows or not len(key):
                    continue
                owner, record = column(b, "owner"), column(b, "record")
                off, items = lists(b.column(b.schema.get_field_index("items")))
                rec = np.repeat(np.arange(len(owner)), np.diff(off))
                k = pack(owner[rec], items)
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                keep = key[at] == k
                new_off = np.concatenate(([0], np.cumsum(np.bincount(rec[keep], minlength=len(owner)))))
                per_b, per_s = np.ones(len(owner), np.int32), np.ones(len(owner), np.int32)
                per_b[rec[keep]], per_s[rec[keep]] = blocks[at[keep]], salts[at[keep]]
                out = _expand(owner, new_off, items[keep], record, per_b, per_s)
                if out is not None:
                    yield out

        sent = base.mapInArrow(send, out_schema)
    else:
        # the dictionary doesn't fit: occurrences meet it in a shuffled join and are put together again by record
        long = base.select("owner", "record", F.explode("items").alias("item")).join(sizes, ["owner", "item"])
        again = long.groupBy("owner", "record").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("blocks").alias("blocks"), F.first("salts").alias("salts"))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    off, items = lists(b.column(b.schema.get_field_index("items")))
                    out = _expand(column(b, "owner"), off, items, column(b, "record"), column(b, "blocks", np.int32), column(b, "salts", np.int32))
                    if out is not None:
                        yield out

        sent = again.mapInArrow(send, out_schema)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, split, key, n, held_a, held_b, held = None, False, np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], 0

        def fold() -> None:
            nonlocal key, n, held_a, held_b, held
            if held:
                k, c = np.unique(pack(np.concatenate(held_a), np.concatenate(held_b)), return_counts=True)
                key, n = sum_by_key(np.concatenate((key, k)), np.concatenate((n, c.astype(np.int64)))) if len(key) else (k, c.astype(np.int64))
                held_a, held_b, held = [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal key, n
            fold()
            keep = slice(None) if split else n >= min_support
            k, c = key[keep], n[keep]
            for i in range(0, len(k), 1 << 16):
                a, b = unpack(k[i : i + (1 << 16)])
                yield pa.record_batch([pa.array(np.full(len(a), now[0]), pa.int32()), pa.array(a), pa.array(b), pa.array(c[i : i + (1 << 16)], pa.int64())], names=["owner", "item_a", "item_b", "c_ab"])
            key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        for b in batches:
            if not b.num_rows:
                continue
            owner, block, salt = (column(b, c) for c in ("owner", "block", "salt"))
            blocks = column(b, "blocks")
            parts = np.asarray(b.column(b.schema.get_field_index("split")).to_pylist(), bool)
            off, items = lists(b.column(b.schema.get_field_index("items")))
            cut = np.flatnonzero((owner[1:] != owner[:-1]) | (block[1:] != block[:-1]) | (salt[1:] != salt[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(owner)]):
                this = (int(owner[lo]), int(block[lo]), int(salt[lo]))
                if this != now:
                    if now is not None:
                        yield from done()
                    now, split = this, bool(parts[lo])
                own = items[off[lo] : off[hi]]
                in_block = mix64(own.astype(np.int64)) % np.uint64(max(int(blocks[lo]), 1)) == np.uint64(this[1])
                for a, p in _products(off[lo : hi + 1] - off[lo], own, in_block):
                    held_a.append(a)
                    held_b.append(p)
                    held += len(a)
                    if held > FOLD:
                        fold()
                        if len(key) > HELD:  # from here on the block's counts are parts
                            split = True
                            yield from done()
        if now is not None:
            yield from done()

    placed = sent.repartition("owner", "block", "salt").sortWithinPartitions("owner", "block", "salt")
    sums = placed.mapInArrow(gram, "owner int, item_a int, item_b int, c_ab bigint").groupBy("owner", "item_a", "item_b").agg(F.sum("c_ab").alias("c_ab")).where(F.col("c_ab") >= min_support)
    a = kept.select("owner", F.col("item").alias("item_a"), F.col("c").alias("c_a"), "n")
    b = kept.select("owner", F.col("item").alias("item_b"), F.col("c").alias("c_b"))
    out = sums.join(a, ["owner", "item_a"]).join(b, ["owner", "item_b"]).select("owner", "item_a", "item_b", "c_ab", "c_a", "c_b", "n")
    return out.where(F.col("c_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("c_a") * F.col("c_b")) if min_lift > 0 else out

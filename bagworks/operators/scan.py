"""Ordered primitives: ranks in equal-key runs, prefix sums, ordered merges and segment gathers.

A window ordered over a whole table runs in one task. Here a scan goes in two levels: rows are dealt to ordered buckets, the
buckets' sums are scanned as a small table, and each bucket is scanned on its own from its offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagworks.session import fresh, materialize


def local_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "r") -> DataFrame:
    """Adds `name`: the row's place, from 0, among the rows of equal keys, in the total order `order`.

    Nulls are a key of their own and order first. Rows that tie in `order` get different places in any order.
    """
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def run_length(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """(keys..., n): the multiplicity of each key; nulls are a key of their own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def bucket_scan(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], bucket: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before this one, within its keys.

    `bucket` is a column that never falls along `order` within a key: it cuts a key's rows into pieces that are scanned apart. The
    pieces' sums, one row each, are scanned as a table of their own. Null values count 0.
    """
    v, off, own = fresh(df, "v", "off", "own")
    df = df.withColumn(v, F.coalesce(value.cast("bigint"), F.lit(0)))
    parts = df.groupBy(*keys, bucket).agg(F.sum(v).alias(own))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(off, F.coalesce(F.sum(own).over(before), F.lit(0))).drop(own)
    by = [*keys, bucket]
    mine = [f"__by{i}" for i in range(len(by))]
    parts = parts.select(*[F.col(k).alias(m) for k, m in zip(by, mine)], off)
    cond = reduce(and_, (F.col(k).eqNullSafe(F.col(m)) for k, m in zip(by, mine)))
    joined = df.join(parts, cond, "left").drop(*mine)
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.col(off) + F.coalesce(F.sum(v).over(w), F.lit(0))).drop(v, off)


def exclusive_scan(df: DataFrame, value: str | Column, order: Sequence[str], name: str = "prefix", partitions: int | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` (null counts 0) over all rows before this one in the total order `order`.

    Rows are range-partitioned by `order` and written once with their range's number, as the ranges' bounds come from a sample and
    must be the same when the rows are read for their sums and for the scan; an empty table stays empty.
    """
    (b,) = fresh(df, "bucket")
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    held = materialize(ranged.withColumn(b, F.spark_partition_id()))
    v, off, own = fresh(held, "v", "off", "own")
    value = F.col(value) if isinstance(value, str) else value
    held = held.withColumn(v, F.coalesce(value.cast("bigint"), F.lit(0)))
    parts = held.groupBy(b).agg(F.sum(v).alias(own))  # a row a partition
    parts = parts.select(b, F.coalesce(F.sum(own).over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(off))
    w = Window.partitionBy(b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return held.join(F.broadcast(parts), b).withColumn(name, F.col(off) + F.coalesce(F.sum(v).over(w), F.lit(0))).select(*df.columns, name)


def place(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """Adds `name`: the row's place, from 0, in the order `order` over the whole table; rows that tie take their places in any order."""
    return exclusive_scan(df, F.lit(1), order, name)


def sort_first(df: DataFrame, pos: str, order: Sequence[str], n: int) -> DataFrame:
    """df as an array whose places are in `pos`: the rows at places below n are put in the order `order`, the others stay.

    `pos` holds 0, 1, 2, ...; rows with a null place stay as they are. Only the rows that move are shuffled.
    """
    (new,) = fresh(df, "place")
    moved = place(df.where(F.col(pos) < n), order, new).withColumn(pos, F.col(new).cast(df.schema[pos].dataType)).drop(new)
    return moved.select(*df.columns).unionByName(df.where((F.col(pos) >= n) | F.col(pos).isNull()))


def sorted_merge(a: DataFrame, b: DataFrame, order: Sequence[str], name: str = "side") -> DataFrame:
    """All rows of both tables in one ascending order, a's before b's where they tie: columns of a and `name` (0 for a, 1 for b).

    Columns are matched by name. The result is range-partitioned and sorted; nulls come first.
    """
    both = a.withColumn(name, F.lit(0)).unionByName(b.select(*a.columns).withColumn(name, F.lit(1)))
    return both.orderBy(*order, name)


def segment_gather(values: DataFrame, segments: DataFrame, *, seg: str = "seg", offset: str = "off", length: str = "len", pos: str = "pos", span: int = 1024) -> DataFrame:
    """(seg, i, value columns...): for each segment the rows of `values` at positions off .. off + len - 1, i counting from 0.

    A range join as an equi-join: a segment is cut into pieces by blocks of `span` positions, and pieces meet positions of their
    block. Segments may overlap; positions that don't exist give no row; null or non-positive lengths give none.
    """
    if span < 1:
        raise ValueError("span must be at least 1")
    (blk,) = fresh(values, "blk")
    cut = segments.select(F.col(seg).alias("__seg"), F.col(offset).cast("bigint").alias("__off"), F.col(length).cast("bigint").alias("__len")).where("__len > 0 and __off is not null")
    cut = cut.withColumn(blk, F.explode(F.sequence(F.floor(F.col("__off") / span), F.floor((F.col("__off") + F.col("__len") - 1) / span))))
    v = values.withColumn(blk, F.floor(F.col(pos) / span))
    hit = v.join(cut, blk).where((F.col(pos) >= F.col("__off")) & (F.col(pos) < F.col("__off") + F.col("__len")))
    rest = [c for c in values.columns if c not in (pos, seg, "i")]
    return hit.select(F.col("__seg").alias(seg), (F.col(pos) - F.col("__off")).alias("i"), *rest)

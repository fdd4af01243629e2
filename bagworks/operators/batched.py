"""Set operations on many pairs of sets at once.

A collection of sets is a long table (set_id, k), one row per element with its repeats; a batch is a table of pairs (pair_id, a_id,
b_id). All pairs go in one plan: sets are counted by (set, element) on the map side, met by pair, and summed. Sizes of union and the
differences follow from the intersection by arithmetic. Nulls in set_id or k don't count. An id that has no element is an empty set:
its intersections are 0 and its unions are the other set's size.

Two ways lead from an element to the pairs that share it: by the element, where all its sets meet, or by the pair list, where each of
its sets is repeated for the pairs it is in. An element of c sets costs about c^2 / 2 rows the first way and c times the pairs of a
set the second way, so every element goes the way that costs it less. Both are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.session import BROADCAST_ROWS, materialize

#: Blocks that ids are dealt to where all pairs are made.
BLOCKS = 16


def element_counts(sets: DataFrame, *, set_col: str = "set_id", key_col: str = "k", distinct: bool = False) -> DataFrame:
    """(set_id, k, m): each element of each set with its copies (1 with `distinct`)."""
    rows = sets.select(F.col(set_col).alias("set_id"), F.col(key_col).alias("k")).where("set_id is not null and k is not null")
    m = F.lit(1).cast("bigint") if distinct else F.count(F.lit(1))
    return rows.distinct().withColumn("m", m) if distinct else rows.groupBy("set_id", "k").agg(m.alias("m"))


def all_pairs(sets: DataFrame, *, set_col: str = "set_id", blocks: int = BLOCKS) -> DataFrame:
    """(pair_id, a_id, b_id) of every two ids, a_id < b_id. Ids are dealt to blocks, and every two blocks meet in a task of their own.

    The result grows with the square of the number of sets and is written, so a pair keeps its number; for many sets give a pair table
    instead. Null ids are in no pair.
    """
    ids = sets.select(F.col(set_col).alias("id")).where("id is not null").distinct().withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    a = ids.select(F.col("id").alias("a_id"), F.col("blk").alias("x"), F.explode(every).alias("y"))
    b = ids.select(F.col("id").alias("b_id"), F.explode(every).alias("x"), F.col("blk").alias("y"))
    return materialize(a.join(b, ["x", "y"]).where("a_id < b_id").select(F.monotonically_increasing_id().alias("pair_id"), "a_id", "b_id"))


def _met(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(pair_id, k, n): the common elements of each pair with min(m, n). counts: a table that is cheap to read again."""
    p = pairs.select("pair_id", "a_id", "b_id").where("a_id is not null and b_id is not null")
    n_pairs, n_sets = p.count(), counts.select("set_id").distinct().count()
    p = F.broadcast(p) if n_pairs <= BROADCAST_ROWS else p
    most = 2 * n_pairs // max(n_sets, 1) + 1
    shared = counts.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    # by the element: its sets meet once for every two of them, the lesser id first
    x = counts.join(shared.where(F.col("c") <= most).select("k"), "k", "left_semi")
    y = x.select(F.col("set_id").alias("hi"), "k", F.col("m").alias("mb"))
    ends = p.select("pair_id", F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"))
    light = x.select(F.col("set_id").alias("lo"), "k", F.col("m").alias("ma")).join(y, "k").where("lo <= hi").join(ends, ["lo", "hi"])
    # by the pair list: elements that are in more sets than a set has pairs
    z = counts.join(shared.where(F.col("c") > most).select("k"), "k", "left_semi")
    a = z.select(F.col("set_id").alias("a_id"), "k", F.col("m").alias("ma"))
    b = z.select(F.col("set_id").alias("b_id"), "k", F.col("m").alias("mb"))
    heavy = a.join(p, "a_id").join(b, ["b_id", "k"])
    out = lambda d: d.select("pair_id", "k", F.least("ma", "mb").alias("n"))
    return out(light).unionByName(out(heavy))


def batched_counts(pairs: DataFrame, sets: DataFrame, *, set_col: str = "set_id", key_col: str = "k", distinct: bool = False) -> DataFrame:
    """(pair_id, a_id, b_id, size_a, size_b, intersection, union, difference, sym_difference, jaccard): one row per pair, also for
    pairs with nothing in common; jaccard is 0 where the union is empty."""
    counts = materialize(element_counts(sets, set_col=set_col, key_col=key_col, distinct=distinct))
    size = counts.groupBy("set_id").agg(F.sum("m").alias("size"))
    met = _met(pairs, counts).groupBy("pair_id").agg(F.sum("n").alias("i"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    p = pairs.select("pair_id", "a_id", "b_id")
    p = p.join(size.select(F.col("set_id").alias("a_id"), F.col("size").alias("sa")), "a_id", "left").join(size.select(F.col("set_id").alias("b_id"), F.col("size").alias("sb")), "b_id", "left").join(met, "pair_id", "left")
    p = p.select("pair_id", "a_id", "b_id", zero("sa").alias("size_a"), zero("sb").alias("size_b"), zero("i").alias("intersection"))
    u = F.col("size_a") + F.col("size_b") - F.col("intersection")
    return p.select("*", u.alias("union"), (F.col("size_a") - F.col("intersection")).alias("difference"), (u - F.col("intersection")).alias("sym_difference"), F.when(u > 0, F.col("intersection") / u).otherwise(F.lit(0.0)).alias("jaccard"))


def batched_intersections(pairs: DataFrame, sets: DataFrame, *, set_col: str = "set_id", key_col: str = "k", distinct: bool = False, arrays: bool = False) -> DataFrame:
    """The common elements of each pair: (pair_id, k, n) with n copies, or with `arrays` (pair_id, keys, n), one cell per pair that holds
    them all, sorted and repeated; pairs with nothing in common give no row, with `arrays` an empty one."""
    met = _met(pairs, materialize(element_counts(sets, set_col=set_col, key_col=key_col, distinct=distinct)))
    if not arrays:
        return met
    one = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "n"))), lambda x: F.array_repeat(x["k"], x["n"].cast("int"))))
    cells = met.groupBy("pair_id").agg(one.alias("keys"), F.sum("n").alias("n"))
    empty = F.array().cast(f"array<{sets.schema[key_col].dataType.simpleString()}>")
    return pairs.select("pair_id").join(cells, "pair_id", "left").select("pair_id", F.coalesce("keys", empty).alias("keys"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

"""Frequent itemsets over vertical tidsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.session import materialize


def vertical(transactions: DataFrame, *, tid: str = "tid", items: str = "items", multiset: bool = False) -> DataFrame:
    """(item, tid): the vertical format as a long table. Null items, tids and lists don't count; an item repeated in a transaction
    counts once, or with `multiset` as often as it stands there."""
    rows = transactions.select(F.col(tid).alias("tid"), F.explode(items).alias("item")).where("tid is not null and item is not null").select("item", "tid")
    return rows if multiset else rows.distinct()


def tidsets(long: DataFrame) -> DataFrame:
    """(item, tids, support): one sorted list per item, for export; a hot item's list is one cell."""
    return long.groupBy("item").agg(F.sort_array(F.collect_list("tid")).alias("tids"), F.count(F.lit(1)).alias("support"))


def eclat(long: DataFrame, min_support: int, max_size: int | None = None) -> DataFrame:
    """(itemset ARRAY sorted, size, support) of all itemsets with at least `min_support` transactions, from a long (item, tid) table.

    Level by level: the members of a class share all items but the last; two of a class meet on (class number, tid), so a hot item's
    tids are spread by tid, and counts are combined on the map side. Each level's pairs are written once, which also cuts the
    lineage; it ends when a level is empty. Repeated (item, tid) rows are copies, as in a multiset: a set's copies in a transaction
    are the fewest of its items', and its support their sum. Empty input gives no row.
    """
    if min_support < 1:
        raise ValueError("min_support must be at least 1")
    number = F.monotonically_increasing_id()  # written at once, so a set keeps its number
    long = long.where("item is not null and tid is not null").groupBy("item", "tid").agg(F.count(F.lit(1)).alias("m"))
    support = long.groupBy("item").agg(F.sum("m").alias("support")).where(F.col("support") >= min_support)
    level = materialize(support.select(F.array("item").alias("itemset"), "support", number.alias("id")))
    found, size = [], 1
    own = level.select(F.col("itemset")[0].alias("item"), "id")
    state = long.join(own, "item").select(F.lit(-1).cast("bigint").alias("cls"), "item", "id", "tid", "m")
    while not level.isEmpty():
        found.append(level.select("itemset", F.lit(size).alias("size"), "support"))
        size += 1
        if max_size is not None and size > max_size:
            break
        state = materialize(state)
        a = state.select("cls", "tid", F.col("item").alias("x"), F.col("id").alias("up"), F.col("m").alias("ma"))
        b = state.select("cls", "tid", "item", F.col("m").alias("mb"))
        # a level's pairs are made and written once: they are counted, and those of frequent sets are the next state
        pairs = materialize(a.join(b, ["cls", "tid"]).where("x < item").select(F.col("up").alias("cls"), "item", "tid", F.least("ma", "mb").alias("m")))
        frequent = pairs.groupBy("cls", "item").agg(F.sum("m").alias("support")).where(F.col("support") >= min_support)
        parent = level.select(F.col("id").alias("cls"), F.col("itemset").alias("prefix"))
        level = materialize(frequent.join(parent, "cls").select("cls", "item", F.concat("prefix", F.array("item")).alias("itemset"), "support", number.alias("id")))
        state = pairs.join(level.select("cls", "item", "id"), ["cls", "item"])
    if not found:
        found.append(level.select("itemset", F.lit(1).alias("size"), "support"))
    return reduce(DataFrame.unionByName, found)

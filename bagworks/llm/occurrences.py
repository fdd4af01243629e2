"""The occurrence tables that the counting operators start from: redelivered copies and nulls are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baskets(df: DataFrame, owner: str, record: str, items: str) -> DataFrame:
    """(owner, record, items): each record once, its non-null items in ascending order, repeats kept.

    Copies of a record that were delivered again hold the same items in another order; if they ever differ, the greatest list
    holds. Rows with a null owner or record, null lists, and lists without any item give no row.
    """
    kept = F.array_sort(F.filter(items, lambda x: x.isNotNull()))
    rows = df.where(F.col(owner).isNotNull() & F.col(record).isNotNull()).select(F.col(owner).alias("owner"), F.col(record).alias("record"), kept.alias("items"))
    return rows.where(F.size("items") > 0).groupBy("owner", "record").agg(F.max("items").alias("items"))


def basket_occurrences(base: DataFrame) -> DataFrame:
    """(owner, record, term, slot) of what `baskets` gives."""
    return base.select("owner", "record", F.posexplode("items").alias("slot", "term")).select("owner", "record", "term", "slot")


def long_occurrences(df: DataFrame, owner: str, record: str, term: str, slot: str) -> DataFrame:
    """(owner, record, term, slot) of a long table. Redelivered rows are still there: the operators drop them where they sort."""
    cols = [F.col(owner).alias("owner"), F.col(record).cast("bigint").alias("record"), F.col(term).alias("term"), F.coalesce(F.col(slot), F.lit(-1)).alias("slot")]
    return df.where(F.col(owner).isNotNull() & F.col(record).isNotNull() & F.col(term).isNotNull()).select(*cols)

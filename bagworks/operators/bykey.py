"""Multiset algebra by key, with a payload: the i-th copy of a key in A pairs with the i-th in B.

Which copies of a key are the first ones is set by `ordinal`, columns that order a key's rows totally. Intersection keeps A's
first min(m, n) rows of a key, difference A's last m - n, union all of A's and B's last n - m, symmetric difference the last |m - n|
of the longer side. Rows with a null in the key are no member of any set here: they are dropped. The result has A's columns;
B's rows, where they come out, give the same columns by name.

A key's rank is a window, so a key's rows meet in one task. `hot_rows` names the size from which a key is ranked in pieces instead:
such keys are range-partitioned by their ordinal and ranked by offsets. None leaves every key whole and saves the count of keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.operators.scan import bucket_scan, local_rank
from bagworks.session import checked_broadcast, fresh, materialize

#: Rows of a key from which on it is ranked in pieces.
HOT_ROWS = 1_000_000


def ranked(df: DataFrame, keys: Sequence[str], ordinal: Sequence[str], name: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """df without null keys, with `name`: the place of each row among its key's, from 0."""
    keys, ordinal = list(keys), list(ordinal)
    if not keys or not ordinal:
        raise ValueError("keys and ordinal must name columns")
    df = df.dropna(subset=keys)
    if hot_rows is None:
        return local_rank(df, keys, ordinal, name)
    (c,) = fresh(df, "c")
    hot = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c)).where(F.col(c) > hot_rows).select(*keys))  # at most rows / hot_rows keys
    if hot.isEmpty():
        return local_rank(df, keys, ordinal, name)
    hot = checked_broadcast(hot)
    (piece,) = fresh(df, "piece")
    apart = df.join(hot, keys, "left_semi").repartitionByRange(*keys, *ordinal)
    apart = materialize(apart.withColumn(piece, F.spark_partition_id()))
    spread = bucket_scan(apart, F.lit(1), keys, ordinal, piece, name).drop(piece)
    rest = local_rank(df.join(hot, keys, "left_anti"), keys, ordinal, name)
    return rest.unionByName(spread.select(*rest.columns))


def by_key(a: DataFrame, b: DataFrame, keys: Sequence[str], ordinal: Sequence[str], op: str, *, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """`op` of intersection, difference, union, sym_difference by `keys`; see the module. Empty sides are allowed."""
    keys = list(keys)
    (r,) = fresh(a, "r")
    cols = a.columns
    ra = ranked(a, keys, ordinal, r, hot_rows)
    on = [*keys, r]
    need = cols if op in ("union", "sym_difference") else [*keys, *[c for c in ordinal if c not in keys]]
    # of B only its numbers of copies count where none of its rows come out: ranks 0 .. n - 1 are the same in any order
    rb = ranked(b.select(*need), keys, ordinal, r, hot_rows)
    if op == "intersection":
        out = ra.join(rb.select(*on), on, "left_semi")
    elif op == "difference":
        out = ra.join(rb.select(*on), on, "left_anti")
    elif op == "union":
        out = ra.unionByName(rb.join(ra.select(*on), on, "left_anti"))
    elif op == "sym_difference":
        out = ra.join(rb.select(*on), on, "left_anti").unionByName(rb.join(ra.select(*on), on, "left_anti"))
    else:
        raise ValueError(f"op={op!r}")
    return out.select(*cols)


def first_match_join(a: DataFrame, b: DataFrame, keys: Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    """For every row of B whose key A has, one row: B's row with the payload of A's first row of that key by `ordinal`.

    Columns: keys, A's other columns as a_<name>, B's other columns. Null keys match nothing. A's rows are reduced to one a key on
    the map side before any shuffle.
    """
    keys = list(keys)
    rest_a = [c for c in a.columns if c not in keys]
    first = a.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct(*[F.col(o) for o in ordinal], *[F.col(c).alias(f"__p_{i}") for i, c in enumerate(rest_a)])).alias("__first"))
    first = first.select(*keys, *[F.col(f"__first.__p_{i}").alias(f"a_{c}") for i, c in enumerate(rest_a)])
    return b.join(first, keys).select(*keys, *[f"a_{c}" for c in rest_a], *[c for c in b.columns if c not in keys])

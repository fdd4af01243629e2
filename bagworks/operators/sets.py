"""Multiset algebra on whole rows: with m copies of a row in A and n in B, intersection has min(m, n), difference max(m - n, 0),
union max(m, n) and symmetric difference |m - n|.

Rows are compared over all columns of A, matched by name in B; nulls equal each other, as in SQL's set operators. Inputs needn't
be sorted, outputs aren't. All forms count rows by key before they shuffle, so a row with any multiplicity is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagworks.session import fresh

OPS = ("intersection", "difference", "union", "sym_difference")
#: Copies up to which a row is unfolded where it was counted, and copies in a piece of a row with more.
_FEW, _CHUNK = 8, 1 << 15


def multiplicity(op: str, m: Column, n: Column) -> Column:
    """Copies in the result of a row with m copies in A and n in B."""
    if op == "intersection":
        return F.least(m, n)
    if op == "difference":
        return F.greatest(m - n, F.lit(0))
    if op == "union":
        return F.greatest(m, n)
    if op == "sym_difference":
        return F.abs(m - n)
    raise ValueError(f"op={op!r}; one of {', '.join(OPS)}")


def multiplicities(a: DataFrame, b: DataFrame, m: str = "m", n: str = "n") -> DataFrame:
    """(columns of a, m, n): each distinct row of either side with its copies on both: one exchange, combined on the map side."""
    cols = a.columns
    if {c.lower() for c in cols} & {m.lower(), n.lower()}:
        raise ValueError(f"a has a column {m} or {n}; name the counts otherwise")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = a.select(*cols, one.alias(m), zero.alias(n)).unionByName(b.select(*cols, zero.alias(m), one.alias(n)))
    return both.groupBy(*cols).agg(F.sum(m).alias(m), F.sum(n).alias(n))


def unfold(df: DataFrame, copies: str, partitions: int | None = None) -> DataFrame:
    """Each row `copies` times, without that column; null and non-positive counts give none.

    Few counted rows can stand for very many copies, and adaptive execution would merge them into one task. So rows of more than a
    few copies are cut into pieces, which are dealt by hash to a stated number of tasks (by default the session's shuffle
    partitions) before they are unfolded; the others, whose copies stay in proportion to what was counted, are unfolded in place.
    """
    (piece,) = fresh(df, "piece")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c != copies]
    times = lambda d, c: d.select(*rest, F.explode(F.array_repeat(F.lit(0), c.cast("int"))).alias(piece)).drop(piece)
    few = times(df.where((F.col(copies) > 0) & (F.col(copies) <= _FEW)), F.col(copies))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1, F.lit(_CHUNK).cast("bigint"))
    many = df.where(F.col(copies) > _FEW).withColumn(piece, F.explode(starts)).repartition(n, *rest, piece)
    return few.unionByName(times(many, F.least(F.col(copies) - F.col(piece), F.lit(_CHUNK))))


def multiset_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """The rows of `op` with their copies. Extra columns of b don't count; a column of a that b lacks is an error."""
    m, n = fresh(a, "m", "n")
    both = multiplicities(a, b, m, n)
    return unfold(both.select(*a.columns, multiplicity(op, F.col(m), F.col(n)).alias(m)), m)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return multiset_op(a, b, "intersection")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return multiset_op(a, b, "difference")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return multiset_op(a, b, "union")


def sym_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return multiset_op(a, b, "sym_difference")


def distinct_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """The same operations over sets: every row at most once."""
    m, n = fresh(a, "m", "n")
    both = multiplicities(a, b, m, n).select(*a.columns, F.least(F.col(m), F.lit(1)).alias(m), F.least(F.col(n), F.lit(1)).alias(n))
    return both.where(multiplicity(op, F.col(m), F.col(n)) > 0).select(*a.columns)


def op_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: size_a, size_b and the sizes of all four results, from one exchange and without any result rows; 0 for empty sides."""
    m, n = fresh(a, "m", "n")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return multiplicities(a, b, m, n).agg(total(F.col(m)).alias("size_a"), total(F.col(n)).alias("size_b"), *[total(multiplicity(op, F.col(m), F.col(n))).alias(op) for op in OPS])

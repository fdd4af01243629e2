"""Joins in their SQL meaning. The by-rank forms, which pair copies and never multiply, are in `bykey`.

Adaptive execution picks broadcast or sort-merge and splits skewed partitions of the latter; for keys known to be hot, `hot` salts them.
Nulls in the key match nothing: inner and semi joins drop them, the anti join keeps A's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.operators.skew import salted_join


def _only(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep)


def equi_join(a: DataFrame, b: DataFrame, on: Sequence[str], *, hot: DataFrame | None = None) -> DataFrame:
    """Inner join; a column outside `on` that both sides have comes out as <name> from a and b_<name> from b."""
    on = list(on)
    clash = {c.lower() for c in a.columns} - {c.lower() for c in on}
    b = b.select(*[F.col(c).alias(f"b_{c}") if c.lower() in clash else F.col(c) for c in b.columns])
    return a.join(b, on) if hot is None else salted_join(a, b, on, hot=hot)


def semi_join(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a whose key b has. Only b's keys are read, each once."""
    return a.join(_only(b, on), list(on), "left_semi")


def anti_join(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a whose key b lacks, also those with a null key."""
    return a.join(_only(b, on), list(on), "left_anti")


def chain_join(first: DataFrame, *steps: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """first joined with each (table, columns) in turn, in one plan, so unused columns are pruned at every scan."""
    out = first
    for table, on in steps:
        out = equi_join(out, table, on)
    return out

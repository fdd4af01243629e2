"""Aggregates of timed runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_stats(value: Column) -> list[Column]:
    """n, mean, sd, least, most, median, p95, cv, sem of a column: nulls don't count, NaN counts as the greatest value. With one value
    sd, cv and sem are null; cv is null where the mean is 0."""
    v = value.cast("double")
    n, mean, sd = F.count(v), F.avg(v), F.stddev_samp(v)
    return [
        n.alias("n"), mean.alias("mean"), sd.alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.95).alias("p95"), (sd / F.nullif(mean, F.lit(0.0))).alias("cv"), (sd / F.sqrt(n)).alias("sem"),
    ]


def summarize_runs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., run statistics) per group. Percentiles are exact and hold a group's distinct values in one task."""
    return df.groupBy(*keys).agg(*run_stats(F.col(value)))

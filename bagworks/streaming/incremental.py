"""Batch operators over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def running_multiplicities(stream: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """(keys..., m, n) over an unbounded stream whose column `side` is 'a' or 'b': what `operators.sets.multiplicities` gives for the
    rows so far, to be written in update or complete mode. The state is one row per distinct key. Other sides don't count."""
    count = lambda s: F.sum((F.col(side) == s).cast("bigint"))
    return stream.where(F.col(side).isin("a", "b")).groupBy(*keys).agg(count("a").alias("m"), count("b").alias("n"))


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], *, width: str, late: str) -> DataFrame:
    """(start, keys..., n) per tumbling window of `width`, closed once the watermark of `late` passes; later rows are dropped."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def each_batch(stream: DataFrame, op: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """A writer that applies a batch operator to every micro-batch and writes it to its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        op(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write)

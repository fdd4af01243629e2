"""Triangles of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.session import materialize


def forward_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(u, v): every edge once, u the end of lower degree (the lower id where degrees tie). Loops, repeats and nulls are dropped.

    So oriented no vertex has more than sqrt(2 E) neighbours ahead, however large a hub is.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = materialize(e.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct())
    deg = e.select(F.col("a").alias("x")).unionAll(e.select("b")).groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    both = e.join(deg.select(F.col("x").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("x").alias("b"), F.col("d").alias("db")), "b")
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return both.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))


def triangle_count(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row, `triangles`: 0 for an empty graph.

    Every edge (u, v) brings the list of u's neighbours ahead, at most sqrt(2 E) long, to v's own list; what both hold closes a
    triangle, each once. So an exchange carries lists by edge, never a row for every wedge.
    """
    ahead = materialize(forward_edges(edges, src, dst).groupBy("u").agg(F.collect_list("v").alias("ahead")))
    edge = ahead.select(F.explode("ahead").alias("v"), "ahead")
    closed = edge.join(ahead.select(F.col("u").alias("v"), F.col("ahead").alias("next")), "v").select(F.size(F.array_intersect("ahead", "next")).alias("n"))
    return closed.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("triangles"))

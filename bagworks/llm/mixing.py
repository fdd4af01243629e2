"""Mixing sources to target weights: weighted fair queueing.

A source's documents stand in an order shuffled by hash. Each has a virtual finish time, the tokens of its source up to and with
it, over all its repeats, divided by the source's weight; taken in that order every source is served in proportion to its weight as
long as it lasts, and what a source can't give goes to the others by their weights. Documents are sorted by it over the whole table and
cut at the total budget.

The running sums go in two levels (source, hash bucket), so a source with a third of all rows isn't one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.operators.scan import bucket_scan, exclusive_scan
from bagworks.session import materialize

#: Most sources that a target table may name; documents of a source in a bucket of the running sum, about.
MAX_SOURCES, BUCKET_ROWS = 10_000, 50_000


def source_name(col: str):
    """One spelling of a source: lower case, no outer blanks, runs of blanks, '_' and '-' as one '-'."""
    return F.regexp_replace(F.lower(F.trim(F.col(col), F.lit(" \t\r\n"))), r"[\s_\-]+", "-")


def plan_mixture(totals: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None) -> tuple[int, float, dict[str, int]]:
    """(budget, virtual time, tokens by source): how far the queue is served. The budget is by default the tokens of all sources
    named, and never more than all repeats give."""
    most = {s: totals.get(s, 0) * max(0, r) for s, (w, r) in targets.items() if w > 0}
    budget = min(sum(totals.get(s, 0) for s in most) if budget is None else budget, sum(most.values()))
    v, left, open_ = 0.0, float(budget), {s for s, m in most.items() if m > 0}
    given = dict.fromkeys(targets, 0.0)
    while open_ and left > 0.5:
        weight = sum(targets[s][0] for s in open_)
        step = min(left / weight, min((most[s] - given[s]) / targets[s][0] for s in open_))
        v += step
        for s in open_:
            given[s] += step * targets[s][0]
        left -= step * weight
        open_ = {s for s in open_ if most[s] - given[s] > 0.5}
    return budget, v, {s: round(g) for s, g in given.items()}


def mix_sources(docs: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 0) -> DataFrame:
    """(seq, doc_id, repeat, source, n_tokens, vft): the mixture in order; `seq` is the first token's number in it.

    docs: (doc_id, source, n_tokens), sources in any spelling; targets: (source, target_share, max_repeats), at most MAX_SOURCES rows,
    one a source after spelling (the last by share holds if not). Documents whose source isn't named, or null, aren't served; shares
    needn't add up to 1; null or non-positive shares serve nothing; a source without documents leaves its share to the others. `repeat`
    counts from 0. Null ids give no row, null sizes count 0. Empty tables give no row.
    """
    rows = targets.select(source_name("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target rows")
    wanted = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in sorted(rows, key=lambda r: (r[0], r[1] or 0))}
    named = [s for s, (w, r) in wanted.items() if w > 0 and r > 0]

    own = docs.where(F.col("doc_id").isNotNull()).select("doc_id", source_name("source").alias("source"), F.greatest(F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    own = own.where(F.col("source").isin(named)) if named else own.where(F.lit(False))
    own = materialize(own.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")))
    stats = {r["source"]: r for r in own.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("m")).collect()}  # a row a named source
    totals = {s: r["t"] for s, r in stats.items()}
    budget, v, _ = plan_mixture(totals, {s: wanted[s] for s in named}, budget)

    bits = max(0, math.ceil(math.log2(max(1, max((r["n"] for r in stats.values()), default=1) / BUCKET_ROWS))))
    scanned = bucket_scan(own.withColumn("bucket", F.shiftright("h", 63 - bits) if bits else F.lit(0)), F.col("n_tokens"), ["source"], ["h", "doc_id"], "bucket", "before")
    spark = docs.sparkSession
    info = spark.createDataFrame([(s, totals[s], wanted[s][0], wanted[s][1]) for s in totals], "source string, total bigint, weight double, repeats int")
    # one longest document beyond the planned time on every source, so that rounding to whole documents can't leave the budget unmet
    margin = max((r["m"] for r in stats.values()), default=0) / min((wanted[s][0] for s in totals), default=1.0)
    served = scanned.join(F.broadcast(info), "source").withColumn("repeat", F.explode(F.expr("sequence(0, repeats - 1)")))
    served = served.withColumn("vft", (F.col("repeat") * F.col("total") + F.col("before") + F.col("n_tokens")) / F.col("weight")).where(F.col("vft") <= v + margin)
    queue = served.select("vft", "source", "repeat", "h", "doc_id", "n_tokens")
    line = exclusive_scan(queue, "n_tokens", ["vft", "source", "repeat", "h", "doc_id"], "seq")
    return line.where(F.col("seq") + F.col("n_tokens") <= budget).select("seq", "doc_id", "repeat", "source", "n_tokens", "vft")


def shares_report(mixture: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, used_tokens, actual_share, top_repeat) of each target, with 0 for
    sources that gave nothing; shares are rounded to 6 places; `top_repeat` is how often its most used document stands there."""
    have = docs.groupBy(source_name("source").alias("source")).agg(F.sum("n_tokens").alias("available_tokens"))
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), (F.max("repeat") + 1).alias("top_repeat"))
    used = materialize(used)  # a row a source
    total = used.agg(F.sum("used_tokens")).first()[0] or 0
    t = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    out = t.join(have, "source", "left").join(used, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select(
        "source", "target_share", "max_repeats", zero(F.col("available_tokens")).alias("available_tokens"), zero(F.col("used_tokens")).alias("used_tokens"),
        F.round(zero(F.col("used_tokens")) / F.lit(max(total, 1)), 6).alias("actual_share"), F.coalesce("top_repeat", F.lit(0)).cast("int").alias("top_repeat"),
    )

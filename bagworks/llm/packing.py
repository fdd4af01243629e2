"""Filling fixed-capacity containers: vector best-fit.

An item takes three resources of its container: tokens, one place, and attention cost (its tokens squared). Items are dealt to
shards by hash, so each shard is a fair sample of the sizes; in a shard they are placed by falling size into the open container
that suits them best among those with room in all three resources: by default the one with the least weighted residual norm
afterwards, or by the greatest weighted dot product of demand and residual. What a shard leaves in containers that aren't full
enough is packed again together with that of other shards, so the waste doesn't grow with the number of shards.

Items longer than the capacity are cut into full containers and a rest, the only splitting there is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.session import materialize

#: Items in a shard, about, and the fill below which a shard's containers are packed again.
SHARD_ITEMS, REPACK_BELOW = 10_000, 0.985
#: Most tasks that shards are dealt to.
MAX_TASKS = 10_000


@dataclass(frozen=True)
class Capacity:
    """Of one container. `cost` bounds the sum of squared sizes; an item that exceeds it alone has a container to itself."""

    tokens: int = 8192
    items: int = 64
    cost: float | None = None
    weights: tuple[float, float, float] = (1.0, 0.02, 0.05)
    rule: str = "residual"

    def __post_init__(self):
        if self.tokens < 1 or self.items < 1 or self.rule not in ("residual", "dot"):
            raise ValueError(f"bad capacity: {self}")

    @property
    def most_cost(self) -> float:
        return float(self.tokens) ** 2 if self.cost is None else float(self.cost)


def _place(sizes: np.ndarray, order: np.ndarray, out: np.ndarray, cap: Capacity, tokens: float, resid: np.ndarray) -> np.ndarray:
    """Places the items of `order` into the bins whose residuals are the rows of `resid`, or into new ones of `tokens`; gives all residuals."""
    full, w = np.array([tokens, cap.items, cap.most_cost], float), np.asarray(cap.weights, float)
    unit = np.array([cap.tokens, cap.items, cap.most_cost], float)
    made, n_open = len(resid), len(resid)
    room = np.concatenate([resid, np.empty((64, 3))])  # of the open bins
    number = np.concatenate([np.arange(made), np.empty(64, np.int64)])
    ends = {}  # residuals of the bins that nothing more goes into
    least = int(sizes[order].min()) if len(order) else 0
    for i in order:
        size = int(sizes[i])
        need = np.array([size, 1.0, float(size) ** 2])
        open_ = room[:n_open]
        fits = np.flatnonzero((open_ >= need).all(axis=1))
        if len(fits):
            r = open_[fits] / unit
            score = -(((r - need / unit) ** 2) @ w) if cap.rule == "residual" else (r * (need / unit)) @ w
            at = fits[int(np.argmax(score))]
        else:
            if n_open == len(room):
                room, number = np.concatenate([room, np.empty_like(room)]), np.concatenate([number, np.empty_like(number)])
            at = n_open
            room[at], number[at] = full, made
            n_open, made = n_open + 1, made + 1
        room[at] -= need
        out[i] = number[at]
        if room[at, 0] < least or room[at, 1] < 1 or room[at, 2] <= 0 and size:
            ends[int(number[at])] = room[at].copy()
            n_open -= 1
            room[at], number[at] = room[n_open], number[n_open]
    left = np.empty((made, 3))
    left[number[:n_open].astype(np.int64)] = room[:n_open]
    for k, r in ends.items():
        left[k] = r
    return left


def best_fit(sizes: np.ndarray, cap: Capacity) -> np.ndarray:
    """The container number of each item, in any order of items; sizes are at most cap.tokens.

    Items go by falling size. Where that takes more containers than the scarcest resource asks for, the small items, which take more of
    the places than of the tokens, have run out of places: then the large ones are placed into containers that hold the small
    ones' even share of tokens back, the small ones fill that, smallest first, and the better result holds.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    bins = len(_place(sizes, order, out, cap, cap.tokens, np.empty((0, 3))))
    fewest = max(-(-int(sizes.sum()) // cap.tokens), -(-len(sizes) // cap.items))
    small = sizes[order] * cap.items <= cap.tokens
    if bins <= 1.01 * fewest + 1 or not small.any() or small.all():
        return out
    back = sizes[order[small]].sum() / fewest
    other, large = np.empty_like(out), order[~small]
    alone = sizes[large] > cap.tokens - back
    left = _place(sizes, large[alone], other, cap, cap.tokens, np.empty((0, 3)))
    rest = _place(sizes, large[~alone], shifted := np.empty_like(out), cap, cap.tokens - back, np.empty((0, 3)))
    other[large[~alone]] = shifted[large[~alone]] + len(left)
    rest[:, 0] += back
    return other if len(_place(sizes, order[small][::-1], other, cap, cap.tokens, np.concatenate([left, rest]))) < bins else out


_OUT = "id bigint, piece int, n_tokens bigint, level int, shard bigint, bin int, kept boolean"


def _pack(df: DataFrame, level: int, cap: Capacity) -> DataFrame:
    """df: (id, piece, n_tokens, shard). `kept`: the container is full enough; the others may be packed again with other shards'."""

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        f["bin"] = best_fit(f["n_tokens"].to_numpy(np.int64), cap)
        f["level"] = level
        f["cost"] = f["n_tokens"].astype(float) ** 2
        by = f.groupby("bin").agg(n=("n_tokens", "sum"), k=("n_tokens", "size"), c=("cost", "sum"))
        full = (by["n"] >= REPACK_BELOW * cap.tokens) | (by["k"] >= cap.items) | (by["c"] >= REPACK_BELOW * cap.most_cost)
        f["kept"] = f["bin"].map(full)
        return f[["id", "piece", "n_tokens", "level", "shard", "bin", "kept"]]

    return df.groupBy("shard").applyInPandas(pack, _OUT)


def pack_documents(sizes: DataFrame, cap: Capacity = Capacity(), *, id_col: str = "doc_id", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id, place, start): every item once, or, if it is too long alone, in pieces.

    sizes: (doc_id BIGINT unique, n_tokens). Null ids give no row; null sizes count 0; items of size 0 take a place and no tokens.
    `place` counts a container's items from 0, `start` is the item's first token there. Deterministic for the same rows.

    A level deals what is left to shards of about `shard_items` items, however many shards that takes; the items of containers that
    aren't full enough are packed again at the next level, dealt anew. Where a level saves less than one container in two hundred,
    its items can't fill containers better, and the levels end with what they made.
    """
    rows = sizes.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.greatest(F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    c = cap.tokens
    pieces = F.expr(f"sequence(0L, greatest((n + {c} - 1) div {c} - 1, 0L))")
    rows = rows.select("id", "n", F.explode(pieces).alias("p")).select("id", F.col("p").cast("int").alias("piece"), F.least(F.col("n") - F.col("p") * c, F.lit(c)).cast("bigint").alias("n_tokens"))
    rows = materialize(rows)
    whole = rows.where(F.col("n_tokens") >= c).select("id", "piece", "n_tokens", F.lit(0).alias("level"), F.col("id").alias("shard"), F.col("piece").alias("bin"))
    kept, level, before, last = [whole], 1, None, None
    left = rows.where(F.col("n_tokens") < c).select("id", "piece", "n_tokens")
    n_left = left.count()
    while n_left:
        shards = math.ceil(n_left / shard_items)
        # shards by a hash of the level; a shard's items vary by chance about shard_items
        # and are dealt to a stated number of tasks: a shard is little data but much work, and adaptive execution would merge them by size
        dealt = left.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), "id", "piece"), F.lit(shards))).repartition(min(shards, MAX_TASKS), "shard")
        packed = materialize(_pack(dealt, level, cap))
        of = packed.groupBy("shard", "bin", "kept").agg(F.count(F.lit(1)).alias("k")).groupBy("kept").agg(F.count(F.lit(1)).alias("bins"), F.sum("k").alias("items"))
        made = {r.kept: (r.bins, r["items"]) for r in of.collect()}
        if before is not None and sum(n for n, _ in made.values()) * 200 > before * 199:
            kept.append(last)  # dealing anew doesn't help: the level before stands as it was
            break
        if shards == 1 or not made.get(False):
            kept.append(packed.drop("kept"))
            break
        kept.append(packed.where("kept").drop("kept"))
        last = packed.where("not kept").drop("kept")
        left = last.select("id", "piece", "n_tokens")
        before, n_left = made[False]
        level += 1
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    # at level 0 the item itself names its container
    name = F.when(F.col("level") == 0, F.xxhash64(F.lit("whole"), "shard", "bin")).otherwise(F.xxhash64("level", "shard", "bin"))
    one = F.struct(F.col("n_tokens").alias("n"), "id", "piece")
    bins = out.groupBy("level", "shard", "bin").agg(F.sort_array(F.collect_list(one), asc=False).alias("items"))  # at most cap.items
    placed = bins.select(name.alias("container_id"), F.posexplode("items").alias("place", "x"), "items")
    return placed.select(
        F.col("x.id").alias(id_col), F.col("x.piece").alias("piece"), F.col("x.n").alias("n_tokens"), "container_id", "place",
        F.expr("aggregate(slice(items, 1, place), 0L, (s, y) -> s + y.n)").alias("start"),
    )

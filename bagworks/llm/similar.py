"""All similar pairs between set-valued records: metric pivot partitioning under Jaccard distance.

Every record has a home, the nearest pivot within RHO of the threshold's distance r, or itself where no pivot is so near: it is a pivot
then. A pivot's cell holds its own records and, as guests, all others whose distance to the pivot is at most r more than the cell's
radius: by the triangle inequality every record that is similar to an own record is among them. Cells are joined exactly; two
records whose distances to the pivot differ by more than r are left out unseen.

How many pivots: a ball of radius below 2/3 holds at most two sets that have no value in common (each needs more than a third of the
pivot), so N unrelated records need at least N / 2 pivots, and looking at all of them for every record is no option.
The pivots near a record are found by an index over values instead: two sets that are similar enough share one of their first
n - ceil(t n) + 1 values in any order of values, here from rare to frequent. A pivot stands there under the first values of all its
own records, once each, so a large group of near copies costs rows in proportion to it and meets others as one pivot.

Exact copies are one class before any of this and are joined as one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagworks.llm.arrays import column, lists, mix64
from bagworks.operators.skew import salted_join
from bagworks.session import checked_broadcast, materialize

#: Radius of a pivot's own ball as a share of the threshold's distance (at a half, all its records are similar to each other), and
#: first values of a record that are looked up for pivots.
RHO, LOOKED_UP = 0.5, 3
#: Values are ordered by counters over 2^22 hashes of them, held as one byte each: 4 MB are sent to every task at any size. Values of
#: one counter only share their place in the order.
RARITY_BITS = 22
#: Rows of a value or of a cell from which on it is dealt to several tasks.
CELL_ROWS = 20_000


def classes(sets: DataFrame, id_col: str, values_col: str, min_size: int = 1) -> DataFrame:
    """(id, h1, h2, n, v): the distinct non-null values of each record, sorted, and a 128-bit class id that equal sets share.

    Records with fewer than `min_size` distinct values, with a null id or a null list give no row.
    """
    v = F.array_sort(F.array_distinct(F.filter(values_col, lambda x: x.isNotNull())))
    rows = sets.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v")).where(F.size("v") >= min_size)
    return rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v"), F.lit("second")).alias("h2"), F.size("v").alias("n"), "v")


def _rarity(sets: DataFrame) -> np.ndarray:
    """A byte for each hash of a value, that grows with how many records hold a value of this hash: 0 none, 1 exactly one."""
    size = 1 << RARITY_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, k = np.zeros(size, np.int64), [], 0

        def fold() -> None:
            nonlocal held, k
            if held:
                n[:] += np.bincount((mix64(np.concatenate(held).astype(np.int64)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
            held, k = [], 0

        for b in batches:
            held.append(lists(b.column(0))[1])
            k += len(held[-1])
            if k > size:
                fold()
        fold()
        at = np.flatnonzero(n)
        for i in range(0, len(at), 1 << 16):
            yield pa.record_batch([pa.array(at[i : i + (1 << 16)].astype(np.int32)), pa.array(n[at[i : i + (1 << 16)]])], names=["slot", "n"])

    met = sets.select("v").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2^22 rows
    out = np.zeros(size, np.uint8)
    if met.num_rows:
        out[column(met, "slot")] = 1 + np.floor(8 * np.log2(column(met, "n"))).astype(np.uint8)
    return out


def _with_front(spark: SparkSession, reps: DataFrame, rarity: np.ndarray, num: int, den: int) -> DataFrame:
    """Adds `front`: each record's first n - ceil(t n) + 1 values in the order of rarity, without those that it alone holds."""
    shared = spark.sparkContext.broadcast(rarity)

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            off, flat = lists(b.column(b.schema.get_field_index("v")))
            flat = flat.astype(np.int64)
            n = np.diff(off)
            rec = np.repeat(np.arange(len(n)), n)
            h = mix64(flat)
            rare = rarity[(h & np.uint64(len(rarity) - 1)).astype(np.int64)]
            order = np.lexsort((h, rare, rec))
            place = np.arange(len(flat)) - off[rec]
            keep = (place < (n + (-n * num) // den + 1)[rec]) & (rare[order] > 1)
            ends = np.concatenate(([0], np.cumsum(np.bincount(rec[keep], minlength=len(n)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[order][keep]))], names=[*b.schema.names, "front"])

    return reps.mapInArrow(front, "h1 bigint, h2 bigint, n int, v array<bigint>, front array<bigint>")


def _distance(n: str, m: str, v: str, w: str) -> Column:
    c = F.size(F.array_intersect(v, w))
    return 1 - c / (F.col(n) + F.col(m) - c)


def _hot(df: DataFrame, *by: str, rows: int) -> DataFrame:
    """Keys that so many rows have that a task of their own isn't enough: at most all rows / `rows`."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > rows).select(*by)


def _homes(t: DataFrame, rho: float, cell_rows: int) -> DataFrame:
    """(h1, h2, p1, p2, d): the nearest pivot, within rho, of each record that is no pivot itself. t: records with their front.

    A pivot is the first by hash of the records whose rarest value is the same; the pivots of a record's first values are looked at.
    """
    heads = t.select("h1", "h2", F.posexplode(F.slice("front", 1, LOOKED_UP)).alias("pos", "value"))
    lead = heads.where("pos = 0").groupBy("value").agg(F.min_by(F.struct("h1", "h2"), F.struct(F.xxhash64("h1", "h2"), "h1", "h2")).alias("p"), F.count(F.lit(1)).alias("c"))
    lead = lead.where("c > 1").select("value", F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"), "c").join(t.select("h1", "h2", "n", "v"), ["h1", "h2"])
    lead = materialize(lead.select("value", F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("n").alias("m"), F.col("v").alias("w"), "c"))
    met = salted_join(heads.select("h1", "h2", "value"), lead.drop("c"), ["value"], hot=lead.where(F.col("c") > cell_rows).select("value"), salt_on=["h1", "h2"])
    met = met.join(lead.select(F.col("p1").alias("h1"), F.col("p2").alias("h2")), ["h1", "h2"], "left_anti").join(t.select("h1", "h2", "n", "v"), ["h1", "h2"])
    d = met.select("h1", "h2", F.struct(_distance("n", "m", "v", "w").alias("d"), "p1", "p2").alias("x")).where(F.col("x.d") <= rho + 1e-9)
    return materialize(d.groupBy("h1", "h2").agg(F.min("x").alias("x")).select("h1", "h2", "x.p1", "x.p2", "x.d"))


def pivot_cells(sets: DataFrame, num: int = 7, den: int = 10, *, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(own, guests): both (p1, p2, h1, h2, n, v, d), the records of each pivot's cell and their distance to it.

    `own` has every record that stands in a cell of more than one record, in its home; `guests` those that are near enough to a cell's
    records to be similar to one with a lesser (h1, h2).
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must lie in (0, 1]")
    spark, r = sets.sparkSession, 1 - num / den
    reps = sets.groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("v").alias("v"))
    t = materialize(_with_front(spark, reps, _rarity(sets), num, den).where("size(front) > 0"))  # others are similar to none
    home = _homes(t, RHO * r, cell_rows)
    radius = home.groupBy("p1", "p2").agg(F.max("d").alias("radius"))
    first = t.select("h1", "h2", "n", "front").join(checked_broadcast(home), ["h1", "h2"], "left")
    own = lambda c, d: F.coalesce(F.col(c), F.col(d)).alias(c)
    rows = materialize(first.select("h1", "h2", "n", own("p1", "h1"), own("p2", "h2"), F.explode("front").alias("value")))
    pivots = rows.groupBy("value", "p1", "p2").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min(F.struct("h1", "h2")).alias("lowest"))
    pivots = pivots.select("value", F.col("p1").alias("q1"), F.col("p2").alias("q2"), "least", "most", "lowest")
    near = salted_join(rows, pivots, ["value"], hot=_hot(rows, "value", rows=cell_rows), salt_on=["h1", "h2"])
    sizes = (F.col("n") * den >= F.col("least") * num) & (F.col("most") * den >= F.col("n") * num)
    near = near.where(sizes & (F.col("lowest") < F.struct("h1", "h2")) & ((F.col("p1") != F.col("q1")) | (F.col("p2") != F.col("q2"))))
    near = materialize(near.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "h1", "h2").distinct())
    record = t.select("h1", "h2", "n", "v")
    pivot = record.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("n").alias("m"), F.col("v").alias("w"))
    far = salted_join(near.join(record, ["h1", "h2"]), pivot, ["p1", "p2"], hot=_hot(near, "p1", "p2", rows=cell_rows), salt_on=["h1", "h2"])
    far = far.select("p1", "p2", "h1", "h2", "n", "v", _distance("n", "m", "v", "w").alias("d")).join(radius, ["p1", "p2"], "left")
    guests = materialize(far.where(F.col("d") <= F.coalesce("radius", F.lit(0.0)) + r + 1e-9).drop("radius"))
    used = guests.select("p1", "p2").unionByName(home.select("p1", "p2")).distinct()
    lone = used.select("p1", "p2", F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.lit(0.0).alias("d"))
    members = home.select("p1", "p2", "h1", "h2", "d").unionByName(lone)
    return materialize(members.join(record, ["h1", "h2"]).select(*guests.columns)), guests


def similar_classes(sets: DataFrame, num: int = 7, den: int = 10, *, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a1, a2, b1, b2, n_a, n_b, shared): pairs of different classes with Jaccard similarity at least num / den, each once, exact.

    sets: what `classes` gives, values BIGINT, best a written table. Class a is the lesser by (h1, h2), and the pair comes out in its
    home's cell. No threshold at 0: num must be positive. Empty tables give no row.
    """
    own, guests = pivot_cells(sets, num, den, cell_rows=cell_rows)
    r = 1 - num / den
    a = own.select("p1", "p2", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("n").alias("n_a"), F.col("v").alias("va"), F.col("d").alias("da"))
    b = own.unionByName(guests).select("p1", "p2", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("n").alias("n_b"), F.col("v").alias("vb"), F.col("d").alias("db"))
    both = salted_join(a, b, ["p1", "p2"], hot=_hot(own, "p1", "p2", rows=cell_rows), salt_on=["a1", "a2"])
    both = both.where((F.struct("a1", "a2") < F.struct("b1", "b2")) & (F.abs(F.col("da") - F.col("db")) <= r + 1e-9))
    both = both.where((F.greatest("n_a", "n_b") * num <= F.least("n_a", "n_b") * den))
    both = both.select("a1", "a2", "b1", "b2", "n_a", "n_b", F.size(F.array_intersect("va", "vb")).cast("bigint").alias("shared"))
    return both.where(F.col("shared") * (den + num) >= (F.col("n_a") + F.col("n_b")) * num)


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_1, id_2), id_1 < id_2: all linked records, copies expanded: for results that must name every pair."""
    m = members.select("id", "h1", "h2")
    x = m.select(F.col("id").alias("i"), F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    y = m.select(F.col("id").alias("j"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    across = links.select("a1", "a2", "b1", "b2").join(x, ["a1", "a2"]).join(y, ["b1", "b2"]).select("i", "j")
    copies = m.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    same = x.join(copies, ["a1", "a2"], "left_semi")
    within = same.join(same.select(F.col("i").alias("j"), "a1", "a2"), ["a1", "a2"]).where("i < j").select("i", "j")
    return across.unionByName(within).where("i <> j").select(F.least("i", "j").alias("id_1"), F.greatest("i", "j").alias("id_2")).distinct()

"""Overlap sizes between many large sets: binary prefix tries with subtree counts.

Values are mixed by a bijection of their unsigned 32-bit range, so a prefix of the mixed value is a hash range of even load. The
ranges are dealt to tasks, rows of a range travelling together as lists. For each range a task builds the tries of all sets once,
bottom up: a node has, for each set that reaches it, the count of the set's values below it and their fingerprint. Then it descends
all sets' tries together. A node that only one set reaches is an empty branch for every partner and is skipped. Two sets whose
fingerprints and counts at a node are the same have the same values there: the overlap is the count, and no leaf is visited; one
value alone is its own fingerprint, so nodes where every set has one value are settled where they stand. Where a set fills its whole
subtree, the overlap with any other is the other's count. What is left goes deeper, at most to the leaves. No intersection is ever made,
only counts per pair of sets, and the ranges' counts add up.

A value met in very many sets would make every task count the same pairs of sets. Such values leave the tries as (set, value) rows and
are counted apart, once for each two blocks of sets; with a least share only for sets that such values alone could carry to it, and for
pairs that the other values leave open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.llm.arrays import changes, column, lists, mix64, sum_by_key
from bagworks.session import checked_broadcast, materialize

_MASK = np.uint64(0xFFFFFFFF)
_STEP = 6  # bits a level
#: Values of a hash range, at most about; rows that a task sorts into ranges at once; pair counts that a task holds before it hands them on.
RANGE_ROWS, _CHUNK, _PAIRS = 125_000, 1_000_000, 1_000_000
#: Values met in more sets than this are counted by blocks of sets; sets of such a block; their entries of a block that are counted at once.
_HOT, _SETS, _ENTRIES = 64, 2048, 1_000_000
#: Sets at a node from which on their pairs are products of blocks, and the width of such a block.
_WIDE, _BLOCK = 64, 2048


def mix32(k: np.ndarray) -> np.ndarray:
    """A bijection of 0..2^32-1 (odd multipliers and shifts)."""
    x = k.astype(np.uint64) & _MASK
    for shift, odd in ((16, 0x9E3779B1), (15, 0x85EBCA6B), (16, 1)):
        x ^= x >> np.uint64(shift)
        x = (x * np.uint64(odd)) & _MASK
    return x


class PairCounter:
    """Counts by pair of local set numbers: dense up to `dense` sets, else sorted keys folded now and then."""

    def __init__(self, n_sets: int, dense: int = 2048, fold: int = 4_000_000):
        self.n, self.fold_at = n_sets, fold
        self.dense = np.zeros(n_sets * n_sets, np.int64) if n_sets <= dense else None
        self.key, self.cnt, self.held, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        #: Entries (set at a node) that were skipped as empty branches, settled above the leaves, settled as leaves.
        self.skipped = self.subtrees = self.leaves = 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        """a != b, in any order."""
        if not len(a):
            return
        self.held.append((np.minimum(a, b).astype(np.int64) * self.n + np.maximum(a, b), n.astype(np.int64)))
        self.size += len(a)
        if self.size > self.fold_at:
            self.fold()

    def fold(self) -> None:
        if not self.held:
            return
        key, n = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        if self.dense is not None:
            self.dense += np.bincount(key, weights=n, minlength=len(self.dense)).astype(np.int64)
        else:
            self.key, self.cnt = sum_by_key(np.concatenate((self.key, key)), np.concatenate((self.cnt, n)))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.fold()
        if self.dense is not None:
            self.key = np.flatnonzero(self.dense)
            self.cnt = self.dense[self.key]
        return self.key // self.n, self.key % self.n, self.cnt


def _pairs(counter: PairCounter, group: np.ndarray, sets: np.ndarray, size: np.ndarray, full: np.ndarray | None = None) -> None:
    """Adds, for every two rows of a group (rows stand by group), the size of the first; with `full`, only pairs with a full row, and
    the size of the other."""
    start = np.flatnonzero(changes(group))
    end = np.append(start[1:], len(group))
    width = end - start
    wide = width > _WIDE if full is None else np.zeros(len(width), bool)
    for lo in range(0, int(wide.sum()), 512):
        # values that very many sets share: products of blocks of the binary group-by-set matrix
        part = np.flatnonzero(wide)[lo : lo + 512]
        at = np.concatenate([np.arange(start[i], end[i]) for i in part])
        met, col = np.unique(sets[at], return_inverse=True)
        row = np.repeat(np.arange(len(part)), width[part])
        own = size[at].astype(np.float64)
        for i in range(0, len(met), _BLOCK):
            x = np.zeros((len(part), min(_BLOCK, len(met) - i)))
            mine = (col >= i) & (col < i + _BLOCK)
            x[row[mine], col[mine] - i] = own[mine]
            for j in range(i, len(met), _BLOCK):
                y = np.zeros((len(part), min(_BLOCK, len(met) - j)))
                other = (col >= j) & (col < j + _BLOCK)
                y[row[other], col[other] - j] = 1
                g = np.rint(x.T @ y).astype(np.int64)
                a, b = np.nonzero(np.triu(g, 1) if i == j else g)
                counter.add(met[a + i], met[b + j], g[a, b])
    thin = np.repeat(~wide, width)
    stop = np.repeat(end, width)
    at, d = np.flatnonzero(thin), 1
    while len(at):
        at = at[at + d < stop[at]]
        p, q = at, at + d
        if full is not None:
            some = full[p] | full[q]
            p, q = p[some], q[some]
            counter.add(sets[p], sets[q], np.where(full[p], size[q], size[p]))
        else:
            counter.add(sets[p], sets[q], size[p])
        d += 1


class Level:
    """The nodes of one depth: sorted by (node, set); the place of each one's parent in the level above is in `up`."""

    def __init__(self, depth: int, node, sets, count, print_):
        self.depth, self.node, self.sets, self.count, self.print = depth, node, sets, count, print_
        self.up = np.zeros(0, np.int64)


def build(mixed: np.ndarray, sets: np.ndarray, n_sets: int, start: int) -> list[Level]:
    """The tries of all sets below `start` bits, from the top level down. (mixed, set) rows are distinct and sorted."""
    below = Level(32, mixed.astype(np.int64), sets.astype(np.int64), np.ones(len(mixed), np.int64), mix64(mixed))
    out = [below]
    depths = sorted(set(range(min(start + _STEP, 32), 32, _STEP)), reverse=True)
    for depth in depths:
        key = (below.node >> (below.depth - depth)) * n_sets + below.sets
        order = np.argsort(key, kind="stable")
        new = changes(key[order])
        below.up = np.empty(len(key), np.int64)
        below.up[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        first = key[order][at]
        here = Level(depth, first // n_sets, first % n_sets, np.add.reduceat(below.count[order], at), np.add.reduceat(below.print[order], at))
        out.append(here)
        below = here
    return out[::-1]


def descend(levels: list[Level], counter: PairCounter) -> None:
    """Counts, for each two sets, the values they share."""
    open_ = None
    for level in levels:
        alive = np.ones(len(level.node), bool) if open_ is None else open_[level.up]
        at = np.flatnonzero(alive)
        node, sets, count, mark = level.node[at], level.sets[at], level.count[at], level.print[at]
        open_ = np.zeros(len(level.node), bool)
        if not len(at):
            continue
        start = np.flatnonzero(changes(node))
        width = np.diff(np.append(start, len(node)))
        each = lambda x: np.repeat(x, width)
        met = width > 1
        counter.skipped += int(width[~met].sum())
        ones = np.maximum.reduceat(count, start) == 1
        same = (np.minimum.reduceat(mark, start) == np.maximum.reduceat(mark, start)) & (np.minimum.reduceat(count, start) == np.maximum.reduceat(count, start))
        done = each(met & (ones | same))
        if done.any():
            settled = int(done.sum())
            counter.leaves += settled if level.depth == 32 else 0
            counter.subtrees += settled if level.depth < 32 else 0
            n, s, c, f = node[done], sets[done], count[done], mark[done]
            order = np.lexsort((f, n))
            n, s, c, f = n[order], s[order], c[order], f[order]
            _pairs(counter, np.cumsum(changes(n, f)), s, c)
        left = each(met & ~(ones | same))
        full = count == (1 << (32 - level.depth))
        use = left & each(np.maximum.reduceat(full, start))
        if use.any():
            counter.subtrees += int((use & full).sum())
            _pairs(counter, node[use], sets[use], count[use], full[use])
        open_[at[left & ~full]] = True


def _overlaps(df: DataFrame, set_col: str, value_col: str, ranges: int | None) -> tuple[DataFrame, DataFrame]:
    """(kind, x, y, n): by kind 0 values but hot ones shared by sets x and y, 1 size of x, 2 entries by outcome x (0 skipped, 1 subtrees,
    2 leaves), 3 hot value y of set x; and (x, name) of the sets. Sets go by a 64-bit hash of their name."""
    spark = df.sparkSession
    name = F.upper(F.trim(F.col(set_col).cast("string"), F.lit(" \t\r\n")))
    rows = df.select(name.alias("s"), F.col(value_col).cast("bigint").alias("k")).where("s is not null and k is not null")
    names = rows.select(F.xxhash64("s").alias("x"), F.col("s").alias("name")).distinct()
    bits = min(24, max(6, math.ceil(math.log2(max(rows.count(), 1) / RANGE_ROWS + 1))))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as lists by hash range. Repeats, even a value that fills a third of the table, are gone before anything is shuffled."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            s, m = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((s, m))
            s, m = s[order], m[order]
            once = changes(m, s)
            s, m = s[once], m[once]
            r = (m >> (32 - bits)).astype(np.int32)
            at = np.flatnonzero(changes(r))
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                end = at[lo + 4096] if lo + 4096 < len(at) else len(r)
                off = pa.array(np.append(part, end) - part[0], pa.int32())
                yield pa.record_batch([pa.array(r[part]), pa.ListArray.from_arrays(off, pa.array(s[part[0] : end])), pa.ListArray.from_arrays(off, pa.array(m[part[0] : end]))], names=["r", "s", "m"])

        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(1).to_numpy(zero_copy_only=False)
            if k.min() < 0 or k.max() > 0xFFFFFFFF:
                raise ValueError("values must lie in 0..2^32-1")
            held.append((b.column(0).to_numpy(zero_copy_only=False), mix32(k).astype(np.int64)))
            size += len(k)
            if size >= _CHUNK:
                yield from dealt()
                held, size = [], 0
        if held:
            yield from dealt()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64)  # hashes of the sets met, by number
        met, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        totals = np.zeros(3, np.int64)

        def descended(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal known, met, size, key, n, totals
            s, m = (np.concatenate(x) for x in zip(*parts))
            ids, local = np.unique(s, return_inverse=True)
            order = np.lexsort((local, m))
            local, m = local[order], m[order]
            once = changes(m, local)
            local, m = local[once], m[once]
            met, size = sum_by_key(np.concatenate((met, ids)), np.concatenate((size, np.bincount(local, minlength=len(ids)))))
            at = np.flatnonzero(changes(m))
            width = np.diff(np.append(at, len(m)))
            hot = np.repeat(width > _HOT, width)
            yield from rows_of(3, ids[local[hot]], m[hot] - 2**31, np.ones(int(hot.sum()), np.int64))
            local, m = local[~hot], m[~hot]
            counter = PairCounter(len(ids), dense=512, fold=_PAIRS)
            descend(build(m.astype(np.uint64), local, len(ids), bits), counter)
            totals += (counter.skipped, counter.subtrees, counter.leaves)
            a, b, c = counter.result()
            if not np.isin(ids, known, assume_unique=True).all():
                now = np.union1d(known, ids)
                to = np.searchsorted(now, known)
                key = (to[key >> 32] << 32) | to[key & 0xFFFFFFFF]
                known = now
            to = np.searchsorted(known, ids)
            key, n = sum_by_key(np.concatenate((key, (to[a] << 32) | to[b])), np.concatenate((n, c)))
            if len(key) > _PAIRS:
                yield from told()

        def rows_of(kind: int, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(x), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.record_batch([pa.array(np.full(len(x[part]), kind, np.int8)), *[pa.array(c[part].astype(np.int64)) for c in (x, y, n)]], names=["kind", "x", "y", "n"])

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal key, n
            for i in range(0, len(key), 1 << 16):
                k = key[i : i + (1 << 16)]
                yield from rows_of(0, known[k >> 32], known[k & 0xFFFFFFFF], n[i : i + (1 << 16)])
            key, n = key[:0], n[:0]

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for b in batches:
            r = column(b, "r").tolist()
            off, s = lists(b.column(b.schema.get_field_index("s")))
            _, m = lists(b.column(b.schema.get_field_index("m")))
            for i, x in enumerate(r):
                if x != now and parts:
                    yield from descended(parts)
                    parts = []
                now = x
                parts.append((s[off[i] : off[i + 1]], m[off[i] : off[i + 1]]))
        if parts:
            yield from descended(parts)
        yield from told()
        yield from rows_of(1, met, np.zeros(len(met), np.int64), size)
        yield from rows_of(2, np.arange(3), np.zeros(3, np.int64), totals)

    dealt = rows.select(F.xxhash64("s").alias("s"), "k").mapInArrow(deal, "r int, s array<bigint>, m array<bigint>")
    part = dealt.repartition(ranges, "r").sortWithinPartitions("r").mapInArrow(count, "kind tinyint, x bigint, y bigint, n bigint")
    low, high = F.when(F.col("kind") == 0, F.least("x", "y")).otherwise(F.col("x")), F.greatest("x", "y")
    sums = part.groupBy("kind", low.alias("x"), F.when(F.col("kind") == 0, high).when(F.col("kind") == 3, F.col("y")).alias("y")).agg(F.sum("n").alias("n"))
    return materialize(sums), names


def _add_products(acc: np.ndarray, a: np.ndarray, va: np.ndarray, b: np.ndarray, vb: np.ndarray) -> None:
    """Adds to acc[i, j] how many values the pairs (i, value) of a, va and (j, value) of b, vb share."""
    both = np.intersect1d(va, vb)
    sides = []
    for i, v in ((a, va), (b, vb)):
        order = np.argsort(v, kind="stable")
        i, v = i[order], v[order]
        at = np.minimum(np.searchsorted(both, v), max(len(both) - 1, 0))
        here = both[at] == v if len(both) else np.zeros(len(v), bool)
        sides.append((i[here], at[here]))
    (a, va), (b, vb) = sides
    begin_a, begin_b = (np.searchsorted(v, np.arange(len(both) + 1)) for v in (va, vb))
    flat = acc.reshape(-1)
    for lo in range(0, len(both), 512):
        hi = min(lo + 512, len(both))
        i, j = slice(begin_a[lo], begin_a[hi]), slice(begin_b[lo], begin_b[hi])
        wedges = int((np.diff(begin_a[lo : hi + 1]) * np.diff(begin_b[lo : hi + 1])).sum())
        if 400 * wedges > (hi - lo) * acc.size:  # dense enough for a product of matrices
            x, y = np.zeros((hi - lo, acc.shape[0]), np.float32), np.zeros((hi - lo, acc.shape[1]), np.float32)
            x[va[i] - lo, a[i]] = 1
            y[vb[j] - lo, b[j]] = 1
            for r in range(0, acc.shape[0], 512):
                acc[r : r + 512] += (x[:, r : r + 512].T @ y).astype(np.int32)
            continue
        times = (begin_b[1:] - begin_b[:-1])[va[i]]
        total = np.cumsum(times)
        cuts = np.unique(np.searchsorted(total, np.arange(0, wedges + 500_000, 500_000)))
        for s, e in zip(cuts, np.append(cuts[1:], len(times))):
            t, v = times[s:e], va[i][s:e]
            ahead = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
            np.add.at(flat, np.repeat(a[i][s:e], t) * acc.shape[1] + b[np.repeat(begin_b[v], t) + ahead], 1)


def _hot_pairs(hot: DataFrame, share: float, left: int, right: int) -> DataFrame:
    """(x, y, n): how many values of `hot` (x, size, chosen, p, ys: a set's values by piece p) each two sets share. With a share only
    pairs that share at least that part of the smaller set, which is a chosen one; without, all sets are chosen.

    A task holds a matrix of counts of two blocks of sets and adds piece after piece to it. left, right: chosen sets, and all.
    """
    lefts, rights = max(1, math.ceil(left / _SETS)), max(1, math.ceil(right / _SETS))
    whole = share <= 0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, piece = None, None
        numbers: tuple[dict, dict] = ({}, {})
        sizes: tuple[list, list] = ([], [])
        held: tuple[list, list] = ([], [])
        acc = np.zeros((0, 0), np.int32)

        def add() -> None:
            nonlocal acc
            if all(held):
                if any(len(x) > n for x, n in zip(numbers, acc.shape)):
                    more = np.zeros([max(n, len(x) + (_SETS >> 3)) for x, n in zip(numbers, acc.shape)], np.int32)
                    more[: acc.shape[0], : acc.shape[1]] = acc
                    acc = more
                of, v = zip(*[(np.repeat([i for i, _ in h], [len(ys) for _, ys in h]), np.concatenate([ys for _, ys in h])) for h in held])
                _add_products(acc, of[0], v[0], of[1], v[1])
            for h in held:
                h.clear()

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal acc
            add()
            ids, size = ([np.fromiter(n, np.int64, len(n)) for n in numbers], [np.array(s, np.int64) for s in sizes])
            rows = min(acc.shape[0], len(ids[0]))
            for lo in range(0, rows, 32):
                part = slice(lo, min(lo + 32, rows))
                n, (x, s), y, z = acc[part, : len(ids[1])], (ids[0][part, None], size[0][part, None]), ids[1][: acc.shape[1]], size[1][: acc.shape[1]]
                keep = n >= (share - 1e-12) * s if not whole else n > 0
                if not whole or group[0] == group[1]:  # else the two meet nowhere else
                    keep &= (s < z) | ((s == z) & (x < y))
                i, j = np.nonzero(keep & (n > 0))
                if len(i):
                    yield pa.record_batch([pa.array(x[i, 0]), pa.array(y[j]), pa.array(n[i, j].astype(np.int64))], names=["x", "y", "n"])
            acc = np.zeros((0, 0), np.int32)
            for c in (*numbers, *sizes):
                c.clear()

        for b in batches:
            i, j, p, side, x, size = (column(b, c).tolist() for c in ("i", "j", "p", "side", "x", "size"))
            off, ys = lists(b.column(b.schema.get_field_index("ys")))
            for r in range(b.num_rows):
                if (i[r], j[r]) != group:
                    if group is not None:
                        yield from told()
                    group, piece = (i[r], j[r]), p[r]
                elif p[r] != piece:
                    add()
                    piece = p[r]
                known = numbers[side[r]]
                if x[r] not in known:
                    known[x[r]] = len(known)
                    sizes[side[r]].append(size[r])
                held[side[r]].append((known[x[r]], ys[off[r] : off[r + 1]]))
        if group is not None:
            yield from told()

    block = lambda n: F.pmod(F.xxhash64("x"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rest = ["p", "x", "size", "ys"]
    a = hot.where("chosen").select(block(lefts).alias("i"), every(rights).alias("j"), F.lit(0).alias("side"), *rest)
    b = hot.select(every(lefts).alias("i"), block(rights).alias("j"), F.lit(1).alias("side"), *rest)
    sent = a.unionByName(b)
    if whole:
        sent = sent.where("i <= j")
    tasks = min(lefts * rights, int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "p").mapInArrow(meet, "x bigint, y bigint, n bigint").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n")


def set_overlaps(df: DataFrame, set_col: str, value_col: str, *, min_share: float = 0.0, ranges: int | None = None) -> DataFrame:
    """(set_a, set_b, shared, size_a, size_b): for each two sets with something in common, set_a < set_b, exact.

    Set ids are strings, compared without outer blanks and case; values lie in 0..2^32-1 (others raise an error). Null ids and
    values don't count, repeated values count once; empty tables give no row. With `min_share` only pairs that share at least that part
    of the smaller set. `ranges`: tasks that the hash ranges are dealt to, by default the session's shuffle partitions.
    """
    sums, names = _overlaps(df, set_col, value_col, ranges)
    share = float(min_share) - 1e-12
    held = sums.where("kind = 3").groupBy("x").agg(F.count(F.lit(1)).alias("hot"))
    sets = sums.where("kind = 1").select("x", F.col("n").alias("size")).join(names, "x").join(held, "x", "left").fillna(0, ["hot"])
    sets = materialize(sets.withColumn("chosen", (F.col("hot") > 0) & (F.col("hot") >= share * F.col("size"))))
    chosen, some, entries = sets.agg(F.count_if("chosen"), F.count_if(F.col("hot") > 0), F.coalesce(F.sum("hot"), F.lit(0))).first()
    size = checked_broadcast(sets)
    a = size.select("x", F.col("name").alias("a"), F.col("size").alias("na"), F.col("hot").alias("ha"))
    b = size.select(F.col("x").alias("y"), F.col("name").alias("b"), F.col("size").alias("nb"), F.col("hot").alias("hb"))
    enough = lambda n: n >= F.lit(share) * F.least("na", "nb")
    pairs = sums.where("kind = 0").select("x", "y", "n")
    if some:
        pieces = math.ceil(entries / math.ceil(some / _SETS) / _ENTRIES)
        hot = sums.where("kind = 3").groupBy("x", F.pmod("y", F.lit(pieces)).cast("int").alias("p")).agg(F.collect_list(F.col("y").cast("int")).alias("ys"))
        hot = materialize(hot.join(size.select("x", "size", "chosen"), "x"))
        add = F.sum("n").alias("n")
        if min_share > 0:
            open_ = materialize(pairs.join(a, "x").join(b, "y").where(enough(F.col("n") + F.least("ha", "hb"))).select("x", "y", "n"))
            other = hot.select(F.col("x").alias("y"), "p", F.col("ys").alias("zs"))
            more = open_.select("x", "y").join(hot.select("x", "p", "ys"), "x").join(other, ["y", "p"]).select("x", "y", F.size(F.array_intersect("ys", "zs")).cast("bigint").alias("n"))
            pairs = open_.unionByName(more).groupBy("x", "y").agg(add)
            if chosen:  # a pair that hot values alone carry to the share; where it was open, its whole count is no less
                pairs = pairs.unionByName(_hot_pairs(hot, share, chosen, some)).groupBy("x", "y").agg(F.max("n").alias("n"))
        else:
            pairs = pairs.unionByName(_hot_pairs(hot, 0.0, some, some)).groupBy("x", "y").agg(add)
    out = pairs.withColumnRenamed("n", "shared").join(a, "x").join(b, "y")
    if min_share > 0:
        out = out.where(enough(F.col("shared")))
    first = F.col("a") < F.col("b")
    pick = lambda u, v: F.when(first, F.col(u)).otherwise(F.col(v))
    return out.select(pick("a", "b").alias("set_a"), pick("b", "a").alias("set_b"), "shared", pick("na", "nb").alias("size_a"), pick("nb", "na").alias("size_b"))


def descent_report(df: DataFrame, set_col: str, value_col: str) -> DataFrame:
    """(outcome, entries): how many entries, a set at a node, were skipped as empty branches, settled by their subtrees' counts above the
    leaves, and settled as leaves."""
    sums, _ = _overlaps(df, set_col, value_col, None)
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("skipped", "subtree", "leaf")]), (F.col("x") + 1).cast("int"))
    return sums.where("kind = 2").select(outcome.alias("outcome"), F.col("n").alias("entries"))

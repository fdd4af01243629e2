"""Percentiles of very large columns: deterministic buffer collapsing.

A summary is a list of sorted buffers, each with a weight: one stored value stands for `weight` values of the column. Buffers of one
level have one size; `fan` of them are collapsed together: their weighted merge is walked in order and evenly spaced positions are
kept. Collapsing goes by levels, as in a balanced tree. Level 0 has buffers of SIZE values, every level twice the one before, up to TOP:
a collapse to spacing g moves a rank by at most g / 2, so a level of size k adds at most n / (2 k), and all levels together about
n / (2 SIZE), whatever n is. The bound is carried along in `error`.

Summaries are rows, so those of separate partitions, days or deliveries are added by `merge_summaries`. A summary also bounds every
percentile between two of its values; `exact_quantiles` counts the column once more between these bounds alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bagworks.llm.arrays import changes, lists
from bagworks.session import checked_broadcast, materialize

#: Values in a buffer of the lowest and of the highest levels, and buffers collapsed at once.
SIZE, TOP, FAN = 128, 8192, 4
#: Values that a task holds before it hands summaries on, and values of one key that a task merges.
HELD = 1_000_000


def collapse(buffers: Sequence[tuple[int, int, np.ndarray]], size: int) -> tuple[int, int, np.ndarray]:
    """One buffer (weight, error, sorted values) for several: evenly spaced positions of their weighted merge.

    Deterministic; the buffers' order doesn't matter. The spacing is the least whole number at which all weight fits in `size`
    values. The count stays exact: positions lie at the middle of every spacing, and a remainder below one spacing stays behind as
    a buffer of its own (see `Summary.push`), so none is lost.
    """
    values = np.concatenate([v for _, _, v in buffers])
    weights = np.concatenate([np.full(len(v), w, np.int64) for w, _, v in buffers])
    order = np.lexsort((weights, values))
    values, weights = values[order], weights[order]
    cum = np.cumsum(weights)
    total = int(cum[-1])
    g = max(1, -(-total // size))
    at = np.arange(g // 2, total - total % g, g)  # middle of each whole spacing
    return g, g // 2 + sum(e for _, e, _ in buffers), values[np.searchsorted(cum, at, side="right")]


class Summary:
    """Buffers of one key, by level."""

    def __init__(self, size: int = SIZE, fan: int = FAN, top: int = TOP):
        self.size, self.fan, self.top = size, fan, max(top, size)
        self.raw: list[np.ndarray] = []
        self.n_raw = 0
        self.levels: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def size_of(self, level: int) -> int:
        return min(self.top, self.size << min(level, 40))

    def held(self) -> int:
        return self.n_raw + sum(len(v) for bs in self.levels.values() for *_, v in bs)

    def add(self, values: np.ndarray) -> None:
        self.raw.append(values)
        self.n_raw += len(values)
        if self.n_raw >= self.size * self.fan:
            self._cut()

    def _cut(self) -> None:
        v = np.concatenate(self.raw) if self.raw else np.zeros(0)
        full = len(v) // self.size * self.size
        self.raw, self.n_raw = [v[full:]] if full < len(v) else [], len(v) - full
        for i in range(0, full, self.size):
            self.push(0, (1, 0, np.sort(v[i : i + self.size])))

    def push(self, level: int, buffer: tuple[int, int, np.ndarray]) -> None:
        at = self.levels.setdefault(level, [])
        at.append(buffer)
        if len(at) < self.fan:
            return
        del self.levels[level]
        weight = sum(w * len(v) for w, _, v in at)
        one = collapse(at, self.size_of(level + 1))
        rest = weight - one[0] * len(one[2])
        if rest:  # the top of the merge, less than one spacing of it: one value with that weight
            self.push(level, (rest, rest, np.array([max(v[-1] for _, _, v in at)])))
        self.push(level + 1, one)

    def buffers(self) -> list[tuple[int, int, int, np.ndarray]]:
        out = [(k, *b) for k, bs in self.levels.items() for b in bs]
        if self.n_raw:
            out.append((0, 1, 0, np.sort(np.concatenate(self.raw))))
        return out


_OWN = ["level", "weight", "error", "values"]


def _schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    own = [T.StructField("level", T.IntegerType()), T.StructField("weight", T.LongType()), T.StructField("error", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))]
    return T.StructType([df.schema[k] for k in keys] + own)


def _batch(keys: Sequence[str], types: Sequence[pa.DataType], held: Sequence[tuple[tuple, Summary]]) -> pa.RecordBatch:
    rows = [(k, b) for k, s in held for b in s.buffers()]
    ends = np.concatenate(([0], np.cumsum([len(b[3]) for _, b in rows])))
    values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([b[3] for _, b in rows] or [np.zeros(0)])))
    own = [pa.array([k[i] for k, _ in rows], t) for i, t in enumerate(types)]
    return pa.record_batch([*own, pa.array([b[0] for _, b in rows], pa.int32()), pa.array([b[1] for _, b in rows], pa.int64()), pa.array([b[2] for _, b in rows], pa.int64()), values], names=[*keys, *_OWN])


def summarize(df: DataFrame, keys: Sequence[str], value: str, *, size: int = SIZE, fan: int = FAN, held_values: int = HELD) -> DataFrame:
    """(keys..., level, weight, error, values): summaries of each input partition, without a shuffle, in bounded memory.

    Null, NaN and infinite values don't count; null keys form a key. A task holds summaries of at most about `held_values` values and
    hands them on when there are more. Empty tables give no row.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Summary] = {}
        types: list[pa.DataType] = []
        stored = 0
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.column(i).type for i in range(len(keys))]
            code = np.zeros(b.num_rows, np.int64)
            for i in range(len(keys)):
                c = pc.dictionary_encode(b.column(i))
                code = code * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(changes(code[order]))
            names = zip(*(b.column(i).take(pa.array(order[start])).to_pylist() for i in range(len(keys))))
            values = b.column(len(keys)).to_numpy(zero_copy_only=False)[order]
            for key, part in zip(names, np.split(values, start[1:])):
                s = held[key] if key in held else held.setdefault(key, Summary(size, fan))
                stored -= s.held()
                s.add(part)
                stored += s.held()
            if stored > held_values:
                yield _batch(keys, types, list(held.items()))
                held, stored = {}, 0
        if held:
            yield _batch(keys, types, list(held.items()))

    return rows.mapInArrow(build, _schema(df, keys))


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, n_by: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows (level, weight, error, values)) of rows that come sorted by their first n_by columns, of which the first n_keys are the key."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            by = list(zip(*(b.column(i).to_pylist() for i in range(n_by)))) if n_by else [()] * b.num_rows
            level, weight, error = (b.column(b.schema.get_field_index(c)).to_pylist() for c in _OWN[:3])
            off, flat = lists(b.column(b.schema.get_field_index("values")))
            for i, row in enumerate(zip(level, weight, error)):
                yield by[i], (*row, flat[off[i] : off[i + 1]])

    for by, part in itertools.groupby(rows(), key=lambda r: r[0]):
        yield by[:n_keys], (r for _, r in part)


def _merged(rows: Iterator[tuple], size: int, fan: int) -> Summary:
    s = Summary(size, fan)
    for level, w, e, v in rows:
        if level == 0 and w == 1:
            s.add(np.asarray(v, np.float64))
        else:
            s.push(level, (w, e, np.asarray(v, np.float64)))
    return s


def merge_summaries(summaries: DataFrame, keys: Sequence[str], *, size: int = SIZE, fan: int = FAN, held_values: int = HELD) -> DataFrame:
    """Summaries of the same keys as one, by a tree: a key's rows are dealt to lanes of about `held_values` values, each lane is merged by
    one task, and so on while a key's rows hold more than that. So no task ever holds more of a key, however many partitions it was
    met in. Buffers of a level are collapsed together, as in one summary."""
    keys = list(keys)
    schema = _schema(summaries, keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [schema_types[k] for k in keys]
        for key, rows in _groups(batches, len(keys), len(keys) + 1):
            yield _batch(keys, types, [(key, _merged(rows, size, fan))])

    from pyspark.sql.pandas.types import to_arrow_type

    schema_types = {k: to_arrow_type(schema[k].dataType) for k in keys}
    now, before = materialize(summaries.select(*keys, *_OWN)), None
    while True:
        most = now.groupBy(*keys).agg(F.sum(F.size("values")).alias("n")).agg(F.max("n")).first()[0] or 0
        lanes = -(-most // held_values)
        if before is not None:  # at least four summaries meet in a lane, also where they hold more than that
            lanes = min(lanes, -(-before // 4) if before > 4 else 1)
        before = lanes
        lane = F.pmod(F.xxhash64("values", "weight"), F.lit(max(lanes, 1))).cast("int") if lanes > 1 else F.lit(0)
        placed = now.select(*keys, lane.alias("__lane"), *_OWN)
        placed = placed.repartition(*keys, "__lane").sortWithinPartitions(*keys, "__lane", "level", "weight", "values")
        one = placed.mapInArrow(merge, schema)
        if lanes <= 1:
            return one
        now = materialize(one)


def quantiles_of(summaries: DataFrame, keys: Sequence[str], probabilities: Sequence[float], *, size: int = SIZE, fan: int = FAN, held_values: int = HELD) -> DataFrame:
    """(keys..., n, rank_error, quantiles, above, upto): lower quantiles (value of rank ceil(p n)) of merged summaries, in order of
    `probabilities`; `n` is exact, and each value's true rank lies within `rank_error` of the wanted one. The true quantile is greater
    than `above` (null: no bound) and at most `upto`."""
    keys, probs = list(keys), [float(p) for p in probabilities]
    if not all(0 <= p <= 1 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    more = [T.StructField("n", T.LongType()), T.StructField("rank_error", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("quantiles", "above", "upto")]]
    schema = T.StructType([summaries.schema[k] for k in keys] + more)
    one = merge_summaries(summaries, keys, size=size, fan=fan, held_values=held_values)
    names = [f.name for f in schema.fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        types: list[pa.DataType] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.column(i).type for i in range(len(keys))]
                yield b

        for key, rows in _groups(typed(), len(keys), len(keys)):
            rows = list(rows)
            v = np.concatenate([x[3] for x in rows])
            w = np.concatenate([np.full(len(x[3]), x[1], np.int64) for x in rows])
            order = np.argsort(v, kind="stable")
            v, cum = v[order], np.cumsum(w[order])
            last = np.append(v[1:] != v[:-1], True)  # ranks of a value are those of its last copy
            v, cum = v[last], cum[last]
            n, error = int(cum[-1]), int(sum(x[2] for x in rows))
            rank = np.array([max(1, math.ceil(p * n - 1e-9)) for p in probs])
            at = np.searchsorted(cum, rank, side="left")
            low, high = np.searchsorted(cum, rank - error, side="left") - 1, np.searchsorted(cum, rank + error, side="left")
            row = [*key, n, error, v[at].tolist(), [v[i] if i >= 0 else None for i in low], [v[i] if i < len(v) else float("inf") for i in high]]
            for c, x in zip(out, row):
                c.append(x)
        if out[-1]:
            kinds = [*types, pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return one.mapInArrow(read, schema)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, bounds: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(keys..., n, quantiles): the exact lower quantiles, from what `quantiles_of` gave for the same rows and probabilities.

    One more pass over the column: values up to a bound are only counted, on the map side; those between the bounds, a share of about
    1 / SIZE of a key's, are ranked by distinct value. df is read as `summarize` reads it.
    """
    keys, probs = list(keys), [float(p) for p in probabilities]
    mine = [f"__k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double").alias("__v")
    rows = df.select(*keys, v).where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    b = bounds.select(*[F.col(k).alias(m) for k, m in zip(keys, mine)], "n", F.posexplode(F.arrays_zip("above", "upto")).alias("i", "x"))
    b = materialize(b.select(*mine, "n", "i", "x.above", "x.upto"))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, mine)))
    met = rows.join(checked_broadcast(b), on).where(F.col("__v") <= F.col("upto")).select(*mine, "i", "n", F.when(F.col("__v") > F.coalesce("above", F.lit(-math.inf)), F.col("__v")).alias("at"))
    met = met.groupBy(*mine, "i", "n", "at").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*mine, "i").orderBy(F.asc_nulls_first("at")))
    p = F.array(*[F.lit(x) for x in probs])
    wanted = F.greatest(F.lit(1), F.ceil(F.get(p, F.col("i")) * F.col("n") - 1e-9))
    exact = met.withColumn("upto", upto).where((F.col("upto") >= wanted) & F.col("at").isNotNull()).groupBy(*mine, "i", "n").agg(F.min("at").alias("q"))
    out = exact.groupBy(*mine, "n").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("q"))
    return out.select(*[F.col(m).alias(k) for k, m in zip(keys, mine)], "n", F.col("q.q").alias("quantiles"))

"""Per-key results where a few keys hold most of the rows.

Every operator here aggregates twice: by (key, salt) first, then by key over the partial results. The first exchange is keyed by
the salted key, so no task holds more than a salt's share of a hot key, and Spark's map-side combine has already shrunk it.
The salt is a function of the row (a block of the ordered column, or a hash of chosen columns), not a random number: a retried
task gives the same salt again, and a partial result over an ordered block keeps what an order-sensitive result needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagworks.session import fresh, materialize

_WORD = 6  # 64 positions a word: one BIGINT bitmap
#: Hot keys of a join that are sent to every task.
HOT_KEYS = 10_000


def hot_keys(df: DataFrame, keys: Sequence[str], *, share: float = 0.01, limit: int = 1000) -> DataFrame:
    """Keys with at least `share` of all rows (at most 1/share of them, at most `limit`), with their exact row counts.

    Null keys count as a key. An empty table gives no row.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    (n,) = fresh(df, "rows")
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    total = df.count()
    return per.where(F.col(n) >= F.lit(total * share)).orderBy(F.desc(n), *keys).limit(limit).select(*keys, F.col(n).alias("n_rows"))


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: Mapping[str, Column],
    merge: Mapping[str, Column],
    *,
    salt_on: Sequence[str],
    salts: int = 64,
) -> DataFrame:
    """Two-stage aggregation by `keys`: partial results by (keys, salt), then merged by keys.

    `partial` names the aggregates of the first stage; `merge` those of the second, over the columns that `partial` made. The salt
    is a hash of `salt_on`; null keys form a group of their own, null salt columns have a salt too. An empty table gives no row.
    Columns of df that aren't used may have any name.
    """
    if salts < 1:
        raise ValueError("salts must be at least 1")
    (s,) = fresh(df, "salt")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_on]), F.lit(salts))
    first = df.withColumn(s, salt).groupBy(*keys, s).agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], *, hot: DataFrame, salts: int = 32, how: str = "inner", salt_on: Sequence[str] = ()) -> DataFrame:
    """Equi-join where `hot` (a table of keys in `on`) names the keys that are spread over `salts` tasks.

    Rows of `small` are repeated for the hot keys only; every other key keeps one salt. `how`: inner, left or left_semi. Null keys
    join with nothing, as in SQL; `left` keeps them. Both sides must see the same hot keys, so these are read once: up to HOT_KEYS
    are sent to every task, more are written and joined by a shuffle.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"how={how!r}")
    h, s = fresh(big.join(small.limit(0), list(on), "left"), "hot", "salt")
    keys = hot.select(*on).distinct()
    met = keys.limit(HOT_KEYS + 1).collect()
    marked = F.broadcast(big.sparkSession.createDataFrame(met, keys.schema)) if len(met) <= HOT_KEYS else materialize(keys)
    marked = marked.withColumn(h, F.lit(True))
    cols = [F.col(c) for c in (salt_on or big.columns)]
    a = big.join(marked, list(on), "left").withColumn(s, F.when(F.col(h), F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")).otherwise(0)).drop(h)
    b = small.join(marked, list(on), "left").withColumn(s, F.explode(F.when(F.col(h), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(h)
    return a.join(b, [*on, s], how).drop(s)


def _word_bitmaps(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, word, bits): one bit for each distinct position, 64 positions a word. The word is the salt of the first stage."""
    p = F.col(pos).cast("bigint")
    return (
        df.where(F.col(key).isNotNull() & p.isNotNull())
        .groupBy(F.col(key).alias("key"), F.shiftright(p, _WORD).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{pos}` & 63 as int))")).alias("bits"))
    )


def _word_runs(words: DataFrame, *extra: str) -> DataFrame:
    """(key, lo, hi): the runs of consecutive positions inside each word."""
    starts = F.expr("bits & ~shiftleft(bits, 1)")
    ends = F.expr("bits & ~shiftrightunsigned(bits, 1)")
    on = lambda m: F.expr(f"filter(sequence(0, 63), i -> shiftright({m}, i) & 1 = 1)")
    r = words.withColumns({"__starts": starts, "__ends": ends})
    r = r.withColumn("__run", F.explode(F.arrays_zip(on("__starts").alias("s"), on("__ends").alias("e"))))
    base = F.shiftleft("word", _WORD)
    return r.select("key", *extra, (base + F.col("__run.s")).alias("lo"), (base + F.col("__run.e")).alias("hi"))


def _stitch(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs that follow each other without a gap become one, within each group of `by`."""
    w = Window.partitionBy(*by).orderBy("lo")
    r = runs.withColumn("__new", F.coalesce((F.col("lo") > F.lag("hi").over(w) + 1).cast("int"), F.lit(1)))
    r = r.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*by, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__run")


def consecutive_runs(df: DataFrame, key: str, pos: str, min_length: int, *, block_bits: int = 20) -> DataFrame:
    """Maximal runs of at least `min_length` consecutive distinct positions of each key: columns `key`, `lo`, `hi`.

    Rows with a null key or position don't count, repeated positions count once; an empty table gives no row; positions are
    integers and may be negative. The two stages: bitmaps of 64 positions by (key, word), which the map side already combines, then
    runs stitched first by (key, block of 2^block_bits positions) and at last by key, where only runs arrive that touch their
    block's edge. A word whose bits touch neither edge and hold no long run is dropped at once, as no run of the
    wanted length can pass through it.
    """
    if min_length < 1:
        raise ValueError("min_length must be at least 1")
    if block_bits < _WORD:
        raise ValueError("block_bits must be at least 6")
    words = _word_bitmaps(df, key, pos)
    words = words.where(F.expr(f"bits & 1 = 1 or bits < 0 or bit_count(bits) >= {int(min_length)}"))
    runs = _word_runs(words)
    runs = runs.where((F.pmod(F.col("lo"), F.lit(64)) == 0) | (F.pmod(F.col("hi"), F.lit(64)) == 63) | (F.col("hi") - F.col("lo") + 1 >= min_length))
    runs = runs.withColumn("blk", F.shiftright("lo", block_bits))
    part = _stitch(runs, ["key", "blk"])
    size = 1 << block_bits
    edge = (F.pmod(F.col("lo"), F.lit(size)) == 0) | (F.pmod(F.col("hi"), F.lit(size)) == size - 1)
    long = F.col("hi") - F.col("lo") + 1 >= min_length
    # only runs at a block's edge, at most two a block of a key, can go on: the others are whole already
    whole = part.where(~edge & long).select("key", "lo", "hi").unionByName(_stitch(part.where(edge).drop("blk"), ["key"]))
    return whole.where(long).select(F.col("key").alias(key), "lo", "hi")


def position_profile(df: DataFrame, key: str, pos: str) -> DataFrame:
    """For each key over its ordered positions: rows, distinct positions, first, last and number of runs of consecutive ones.

    Columns `key`, `n_rows`, `n_positions`, `first_pos`, `last_pos`, `n_runs`. Rows with a null key or position don't count. A run
    starts at a set bit whose lower neighbour is clear, which a word shows for all its bits but the lowest; for that one the
    neighbouring word's highest bit is fetched by a second aggregation on (key, word), never by a sort of a key's whole list.
    """
    p = F.col(pos).cast("bigint")
    words = (
        df.where(F.col(key).isNotNull() & p.isNotNull())
        .groupBy(F.col(key).alias("key"), F.shiftright(p, _WORD).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{pos}` & 63 as int))")).alias("bits"), F.count(F.lit(1)).alias("n_rows"), F.min(p).alias("lo"), F.max(p).alias("hi"))
    )
    words = materialize(words)  # read three times, 64 positions a row
    own = words.select(
        "key", "word", "n_rows", F.bit_count("bits").cast("bigint").alias("n_positions"), "lo", "hi",
        F.expr("bit_count(bits & ~shiftleft(bits, 1))").cast("bigint").alias("starts"),
        F.expr("bits & 1").alias("low"), F.lit(0).cast("bigint").alias("carry"),
    )
    none = F.lit(None).cast("bigint")
    # only words with their highest bit set tell the next word of it
    carried = words.where(F.col("bits") < 0).select(
        "key", (F.col("word") + 1).alias("word"), F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("n_positions"),
        none.alias("lo"), none.alias("hi"), F.lit(0).cast("bigint").alias("starts"), F.lit(0).cast("bigint").alias("low"), F.lit(1).cast("bigint").alias("carry"),
    )
    near = (
        own.where("low = 1").select("key", "word", "low", "carry").unionByName(carried.select("key", "word", "low", "carry"))
        .groupBy("key", "word").agg(F.max("low").alias("low"), F.max("carry").alias("carry"))
        .where("low = 1 and carry = 1").groupBy("key").agg(F.count(F.lit(1)).alias("joined"))
    )
    total = own.groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_positions").alias("n_positions"), F.min("lo").alias("first_pos"), F.max("hi").alias("last_pos"), F.sum("starts").alias("starts"))
    return total.join(near, "key", "left").select(
        F.col("key").alias(key), "n_rows", "n_positions", "first_pos", "last_pos",
        (F.col("starts") - F.coalesce("joined", F.lit(0))).cast("bigint").alias("n_runs"),
    )

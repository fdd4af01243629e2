"""Column functions: unsigned 32-bit arithmetic, bits, sorted arrays and ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
#: The 32-bit finalizer's multipliers.
_MULTIPLIERS = (0x85EBCA6B, 0xC2B2AE35)


def is_u32(c: Column) -> Column:
    """True for 0..2^32-1, false beyond, null for null."""
    return (c >= 0) & (c <= F.lit(_MASK))


def _times(h: Column, m: int) -> Column:
    """h * m modulo 2^32 in 64-bit arithmetic that never overflows."""
    high = (h * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)
    return (high + h * F.lit(m & 0xFFFF)).bitwiseAND(F.lit(_MASK))


def finalize32(c: Column) -> Column:
    """The 32-bit avalanche finalizer of an unsigned 32-bit integer held as BIGINT: a bijection of 0..2^32-1."""
    h = c.cast("bigint").bitwiseAND(F.lit(_MASK))
    h = h.bitwiseXOR(F.shiftright(h, 16))
    h = _times(h, _MULTIPLIERS[0])
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = _times(h, _MULTIPLIERS[1])
    return h.bitwiseXOR(F.shiftright(h, 16))


def slot(c: Column, n: int) -> Column:
    """The hash slot of a value in a table for n entries: a power of two at a load of at most 0.6."""
    size = 1
    while size * 0.6 < n:
        size *= 2
    return finalize32(c).bitwiseAND(F.lit(size - 1))


def jaccard(inter: Column, union: Column) -> Column:
    """inter / union, 0 where the union is empty; null for null."""
    return F.when(union > 0, inter / union).when(union.isNotNull() & inter.isNotNull(), F.lit(0.0))


def _bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), c computed once a row: a lambda's body would compute it again for every element."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _runs(a: Column, side: int) -> Column:
    """(v, side, n) structs: the distinct elements of a cell with their copies."""

    def of(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda at: F.transform(at, lambda p, i: F.struct(F.get(s, p).alias("v"), F.lit(side).alias("side"), (F.coalesce(F.get(at, i + 1), F.size(s)) - p).alias("n")))
        return _bound(first, run)

    filled = _bound(F.array_sort(F.filter(a, lambda x: x.isNotNull())), lambda s: F.when(F.size(s) > 0, of(s)))
    return F.coalesce(filled, F.array())


def array_multiset_op(a: Column, b: Column, op: str) -> Column:
    """The multiset operation of two array cells, sorted; null elements don't count, a null array gives null.

    Unlike array_intersect and array_except, copies count. Both cells are sorted, cut into runs of equal elements and merged by one
    more sort, so the work is that of sorting, whatever the number of distinct elements.
    """
    if op not in ("intersection", "difference", "union", "sym_difference"):
        raise ValueError(f"op={op!r}")

    def times(m: Column, n: Column) -> Column:
        if op == "intersection":
            return F.least(m, n)
        if op == "difference":
            return F.greatest(m - n, F.lit(0))
        return F.greatest(m, n) if op == "union" else F.abs(m - n)

    def merged(runs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            met = lambda y: F.when(y["v"] == x["v"], y["n"])
            after, before = met(F.get(runs, i + 1)), met(F.get(runs, i - 1))
            mine = F.when(x["side"] == 0, times(x["n"], F.coalesce(after, F.lit(0)))).otherwise(F.when(before.isNull(), times(F.lit(0), x["n"])).otherwise(0))
            return F.array_repeat(x["v"], mine)

        return F.flatten(F.transform(runs, one))

    return F.when(a.isNotNull() & b.isNotNull(), _bound(F.array_sort(F.concat(_runs(a, 0), _runs(b, 1))), merged))


def array_slice(a: Column, start: int, length: int) -> Column:
    """`length` elements from place `start`, counted from 0; fewer where the cell ends, null for a null cell."""
    if start < 0 or length < 0:
        raise ValueError("start and length must not be negative")
    return F.slice(a, start + 1, length)


def array_overlap(a: Column, b: Column) -> Column:
    """Distinct non-null elements that both cells hold; null for a null cell."""
    return F.size(F.filter(F.array_intersect(a, b), lambda x: x.isNotNull()))


def pack_pairs(keys: Column, values: Column) -> Column:
    """Two arrays of one length as one array of (k, v) structs; null where the lengths differ."""
    z = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    return F.when(F.size(keys) == F.size(values), z)


def interleave(keys: Column, values: Column) -> Column:
    """[k0, v0, k1, v1, ...]."""
    return F.flatten(F.zip_with(keys, values, lambda k, v: F.array(k, v)))


def split_interleaved(a: Column, key_index: int = 0) -> Column:
    """(k, v) structs of an interleaved array; `key_index` 1 swaps the two. Null for an odd length."""
    if key_index not in (0, 1):
        raise ValueError("key_index must be 0 or 1")
    at = lambda i: F.get(a, i)
    n = (F.size(a) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(2 * i + key_index).alias("k"), at(2 * i + 1 - key_index).alias("v")))
    return F.when(F.size(a) == 0, F.filter(F.transform(F.sequence(F.lit(0), F.lit(0)), lambda i: F.struct(at(i).alias("k"), at(i).alias("v"))), lambda x: F.lit(False))).when(F.size(a) % 2 == 0, pairs)

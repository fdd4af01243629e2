"""Small numpy and Arrow helpers that the operators' Python stages share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def column(batch: pa.RecordBatch, name: str, dtype=np.int64) -> np.ndarray:
    """A column without nulls as an array."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def pack(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Two 32-bit integers in one sortable 64-bit key: order by (hi, lo), signs kept."""
    return (hi.astype(np.int64) << 32) | (lo.astype(np.int64) + 2**31)


def unpack(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> 32).astype(np.int32), ((key & 0xFFFFFFFF) - 2**31).astype(np.int32)


def changes(*cols: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it; the first is True."""
    new = np.zeros(len(cols[0]), bool)
    if len(new):
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new


def lists(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, flat values) of a list column without nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    off = array.offsets.to_numpy().astype(np.int64)
    values = array.values.slice(off[0], off[-1] - off[0]) if len(off) else array.values
    return off - (off[0] if len(off) else 0), values.to_numpy(zero_copy_only=False)


def sum_by_key(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of n over each."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(changes(key))
    return key[at], np.add.reduceat(n, at)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def slices(batches, rows: int = 256):
    """Batches cut to pieces of a few rows, for stages that turn long texts into Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)

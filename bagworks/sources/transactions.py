"""Transaction files: text with one transaction a line, and vertical tidsets in compressed sparse rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from bagworks.session import checked_broadcast, materialize
from bagworks.sources import files
from bagworks.sources.binary import count_of

#: Values of one file of tids.
FILE_VALUES = 1 << 30


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... in the order in which df's partitions and their rows come."""
    held = materialize(df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    return _numbered(held, ["__p"], name)


def _numbered(held: DataFrame, part: list[str], name: str) -> DataFrame:
    """Numbers rows over parts, in the order of the columns `part`; in a part `__i` counts up without gaps from anywhere."""
    size = held.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))  # a row a part
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    off = checked_broadcast(materialize(size.select(*part, (before - F.col("__first")).alias("__off"))))
    return held.join(off, part).withColumn(name, F.col("__off") + F.col("__i")).drop(*part, "__i", "__off")


def read_transactions(spark: SparkSession, path: str, *, count_empty: bool = False) -> DataFrame:
    """(tid, items ARRAY<BIGINT>) of text files with integers separated by white space.

    Blank lines and lines that begin with # or // are skipped. A token counts by the integer that it begins with; tokens that begin
    with none are dropped, and so are rows without any number. tid numbers the rows that are left, from 0, by file name and line;
    with `count_empty` rows whose tokens are all dropped take a number too.
    """
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    where = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b")]
    rows = spark.read.text(path).select(line.alias("line"), *where).where("line <> '' and not startswith(line, '#') and not startswith(line, '//')")
    number = F.transform(F.split("line", " "), lambda x: F.regexp_extract(x, r"^[+-]?\d+", 0).try_cast("bigint"))
    rows = rows.select(F.filter(number, lambda x: x.isNotNull()).alias("items"), "__f", "__b")
    if not count_empty:
        rows = rows.where(F.size("items") > 0)
    held = materialize(rows.withColumn("__i", F.monotonically_increasing_id()))
    return _numbered(held, ["__f", "__b"], "tid").where(F.size("items") > 0).select("tid", "items")


def write_tidsets(long: DataFrame, prefix: str, *, file_values: int = FILE_VALUES) -> None:
    """(item, tid) rows as <prefix>/part-*.{items,offsets,tidsets}.bin, headerless arrays of unsigned 32-bit integers, and meta.json.

    Rows are range-partitioned by item and tid, so a hot item's list goes on over several files; each task writes its rows in that
    order, repeats kept, and begins new files after `file_values` values, so offsets always fit in 32 bits.
    """
    if not 0 < file_values <= 0xFFFFFFFF:
        raise ValueError("file_values must lie in 1..2^32-1")
    out, job = prefix.rstrip("/"), uuid.uuid4().hex[:8]
    files.make_folder(out)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        rest: list[tuple[np.ndarray, np.ndarray]] = []  # rows that were read but go to the next file

        def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            while rest:
                yield rest.pop()
            for b in batches:
                i, t = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                if len(t) and (min(i.min(), t.min()) < 0 or max(i.max(), t.max()) > 0xFFFFFFFF):
                    raise ValueError("items and tids must lie in 0..2^32-1")
                if len(t):
                    yield i, t

        number = 0
        while True:
            items, sizes, total = [], [], 0
            base = f"{out}/.{job}-{ctx.partitionId():05d}-{number:05d}-{ctx.taskAttemptId()}"

            def tids() -> Iterator[bytes]:
                nonlocal total
                for i, t in rows():
                    if len(t) > file_values - total:
                        cut = file_values - total
                        rest.append((i[cut:], t[cut:]))
                        i, t = i[:cut], t[:cut]
                    for item, n in zip(*np.unique(i, return_counts=True)):
                        if items and items[-1] == item:
                            sizes[-1] += int(n)
                        else:
                            items.append(int(item)), sizes.append(int(n))
                    total += len(t)
                    yield t.astype("<u4").tobytes()
                    if total >= file_values:
                        return

            files.write_bytes(base + ".tidsets.bin", tids())
            files.write_bytes(base + ".items.bin", iter([np.array(items, "<u4").tobytes()]))
            files.write_bytes(base + ".offsets.bin", iter([np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype("<u4").tobytes()]))
            ends = (items[0], items[-1]) if items else (None, None)
            yield pa.record_batch([pa.array([x], t) for x, t in zip((base, len(items), total, *ends), (pa.string(), *[pa.int64()] * 4))], names=["base", "items", "total", "first", "last"])
            number += 1
            if total < file_values:
                return

    rows = long.select(F.col("item").cast("bigint"), F.col("tid").cast("bigint")).where("item is not null and tid is not null")
    placed = rows.repartitionByRange("item", "tid").sortWithinPartitions("item", "tid")
    parts = sorted(placed.mapInArrow(write, "base string, items bigint, total bigint, first bigint, last bigint").collect())  # a row a file
    transactions = rows.select("tid").distinct().count()
    for i, p in enumerate(parts):
        for kind in ("items", "offsets", "tidsets"):
            files.move(f"{p['base']}.{kind}.bin", f"{out}/part-{i:05d}.{kind}.bin")
    some = [p for p in parts if p["items"]]
    again = sum(a["last"] == b["first"] for a, b in zip(some, some[1:]))  # items that go on in the next file
    meta = {"numTransactions": transactions, "numItems": sum(p["items"] for p in parts) - again, "totalTidsetElements": sum(p["total"] for p in parts)}
    files.write_bytes(f"{out}/meta.json", iter([json.dumps(meta).encode()]))


class _Slice(InputPartition):
    def __init__(self, base: str, lo: int, hi: int):
        self.base, self.lo, self.hi = base, lo, hi


class TidsetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per = options["path"].rstrip("/"), int(options.get("items_per_partition", 4096))

    def partitions(self) -> list[_Slice]:
        bases = [f[: -len(".items.bin")] for f in files.files_of(self.path, ".items.bin")] if files.is_folder(self.path) else [self.path]
        out = []
        for b in bases:
            n = count_of(b + ".items.bin", False)
            if count_of(b + ".offsets.bin", False) != n + 1:
                raise ValueError(f"{b}: offsets must be one more than items")
            out += [_Slice(b, i, min(n, i + self.per)) for i in range(0, n, self.per)]
        return out

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        n = partition.hi - partition.lo
        values = lambda kind, at, k: np.frombuffer(b"".join(files.read_at(f"{partition.base}.{kind}.bin", 4 * at, 4 * k)), "<u4").astype(np.int64)
        items, off = values("items", partition.lo, n), values("offsets", partition.lo, n + 1)
        at = int(off[0])  # the slice's lists lie one after another; they are read in pieces, so a hot item's list is never one cell
        for got in files.read_at(f"{partition.base}.tidsets.bin", 4 * at, 4 * int(off[-1] - off[0]), 4 << 16):
            t = np.frombuffer(got, "<u4").astype(np.int64)
            item = items[np.searchsorted(off, np.arange(at, at + len(t)), side="right") - 1]
            yield pa.record_batch([pa.array(item), pa.array(t)], names=["item", "tid"])
            at += len(t)


class TidsetSource(DataSource):
    """Format "tidsets": (item, tid) rows of a folder that `write_tidsets` made, or of one prefix of three files."""

    @classmethod
    def name(cls) -> str:
        return "tidsets"

    def schema(self) -> str:
        return "item bigint, tid bigint"

    def reader(self, schema) -> TidsetReader:
        return TidsetReader(self.options)


def read_tidsets(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(TidsetSource)
    return spark.read.format("tidsets").load(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document, possibly over several lines, as one row."""
    return spark.read.json(path, multiLine=True)


def write_results(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)

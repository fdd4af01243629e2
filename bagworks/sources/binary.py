"""Binary arrays of unsigned 32-bit integers as a Spark data source, format name "u32bin".

A file holds, little-endian, optionally its count as an unsigned 64-bit integer, then the values. Reading cuts files into byte
ranges, one a task; writing gives one such file a task. Options:

* header: true (default) if files begin with their count; a count that doesn't fit the file is an error;
* values_per_partition: values that a read task takes, 4,194,304 by default.

Read columns: k BIGINT, and ordinal BIGINT, the value's place in its file, and file STRING. Written rows need one integer column k in
0..2^32-1; nulls and other values are an error. Files are on a file system that every executor sees (see `files`).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from bagworks.sources import files

_BATCH = 1 << 16


def _truth(s: str | None, default: bool) -> bool:
    return default if s is None else s.strip().lower() in ("true", "1", "yes")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    first: int
    count: int


def count_of(file: str, header: bool) -> int:
    """Values in a file."""
    size = files.size_of(file)
    body = size - 8 * header
    if body < 0 or body % 4:
        raise ValueError(f"{file}: {size} bytes are no array of 32-bit values" + " behind a count" * header)
    if header:
        (n,) = struct.unpack("<Q", b"".join(files.read_at(file, 0, 8)))
        if n * 4 != body:
            raise ValueError(f"{file}: its count is {n}, it holds {body // 4} values")
    return body // 4


class U32Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.header = options["path"], _truth(options.get("header"), True)
        self.per = int(options.get("values_per_partition", 1 << 22))

    def partitions(self) -> list[Range]:
        out = []
        for f in files.files_of(self.path, ".bin"):
            n = count_of(f, self.header)
            out += [Range(f, 8 * self.header + 4 * i, i, min(self.per, n - i)) for i in range(0, n, self.per)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.count:
            return
        first = partition.first
        for got in files.read_at(partition.file, partition.start, 4 * partition.count, 4 * _BATCH):
            v = np.frombuffer(got, "<u4").astype(np.int64)
            yield pa.record_batch([pa.array(v), pa.array(np.arange(first, first + len(v))), pa.array([partition.file] * len(v))], names=["k", "ordinal", "file"])
            first += len(v)


@dataclass
class Written(WriterCommitMessage):
    file: str
    count: int


class U32Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.overwrite, self.job = options["path"].rstrip("/"), _truth(options.get("header"), True), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files.make_folder(self.path)
        ctx = TaskContext.get()
        tmp = f"{self.path}/.{self.job}-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.bin"

        def chunks() -> Iterator[bytes]:
            if self.header:
                yield bytes(8)
            for b in iterator:
                c = b.column(b.schema.get_field_index("k"))
                if c.null_count:
                    raise ValueError("k is null")
                v = c.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(v) and (v.min() < 0 or v.max() > 0xFFFFFFFF):
                    raise ValueError("k must lie in 0..2^32-1")
                yield v.astype("<u4").tobytes()

        n = (files.write_bytes(tmp, chunks()) - 8 * self.header) // 4
        if self.header:
            files.put_count(tmp, n)
        return Written(tmp, n)

    def commit(self, messages: list) -> None:
        """Only committed attempts get their final names, so a task that ran twice leaves one file."""
        if self.overwrite and files.is_folder(self.path):
            for f in files.files_of(self.path, ".bin"):
                files.delete(f)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.file)
        for i, m in enumerate(done):
            files.move(m.file, f"{self.path}/part-{i:05d}-{self.job[:8]}.bin")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                files.delete(m.file)


class U32Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "u32bin"

    def schema(self) -> str:
        return "k bigint, ordinal bigint, file string"

    def reader(self, schema) -> U32Reader:
        return U32Reader(self.options)

    def writer(self, schema, overwrite: bool) -> U32Writer:
        return U32Writer(self.options, overwrite)


def read_u32(spark: SparkSession, path: str, *, header: bool = True, values_per_partition: int | None = None) -> DataFrame:
    spark.dataSource.register(U32Source)
    r = spark.read.format("u32bin").option("header", str(header).lower())
    return (r.option("values_per_partition", values_per_partition) if values_per_partition else r).load(path)


def write_u32(df: DataFrame, path: str, *, header: bool = True, overwrite: bool = True) -> None:
    """Writes column k, one file a partition, in the order of the partitions' rows."""
    df.sparkSession.dataSource.register(U32Source)
    df.select("k").write.format("u32bin").option("header", str(header).lower()).mode("overwrite" if overwrite else "append").save(path)


def read_u32_pairs(spark: SparkSession, keys: str, values: str, *, header: bool = True) -> DataFrame:
    """(k, v, ordinal): the i-th value of file `keys` with the i-th of file `values`, two single files of one length."""
    if count_of(keys, header) != count_of(values, header):
        raise ValueError("the two files differ in length")
    a = read_u32(spark, keys, header=header).select("ordinal", "k")
    b = read_u32(spark, values, header=header).select("ordinal", "k").withColumnRenamed("k", "v")
    return a.join(b, "ordinal").select("k", "v", "ordinal")


def _random(spark: SparkSession, n: int, high: int, seed: int) -> DataFrame:
    """(id, k): k in 1..high from a hash of the seed and the place in the stream, so the values depend on nothing else."""
    if n < 0 or high < 1:
        raise ValueError("n must not be negative, high at least 1")
    return spark.range(n).select("id", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(high)) + 1).cast("bigint").alias("k"))


def random_multiset(spark: SparkSession, n: int, high: int, seed: int = 123456) -> DataFrame:
    """n integers of 1..high, evenly distributed, repeatable for a seed."""
    return _random(spark, n, high, seed).select("k")


def random_sides(spark: SparkSession, n_a: int, n_b: int, high: int, seed: int = 123456) -> tuple[DataFrame, DataFrame]:
    """Two sorted columns k of one stream: A holds its first n_a values, B the n_b that follow."""
    stream = _random(spark, n_a + n_b, high, seed)
    side = lambda c: stream.where(c).select("k").orderBy("k")
    return side(F.col("id") < n_a), side(F.col("id") >= n_a)

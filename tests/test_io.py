import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagworks.functions.scalar import array_multiset_op, array_overlap, finalize32, interleave, is_u32, jaccard, pack_pairs, slot, split_interleaved
from bagworks.functions.stats import summarize_runs
from bagworks.sources import binary, transactions


def test_bin_roundtrip_and_ranges(spark, tmp_path):
    v = [0, 4294967295, *range(1000)]
    for header in (True, False):
        path = str(tmp_path / f"h{header}")
        binary.write_u32(spark.createDataFrame([(x,) for x in v], "k bigint").repartition(3), path, header=header)
        back = binary.read_u32(spark, path, header=header, values_per_partition=7)
        assert sorted(r.k for r in back.collect()) == sorted(v)
    f = tmp_path / "one.bin"
    f.write_bytes(struct.pack("<Q", 3) + np.array([5, 6, 7], "<u4").tobytes())
    assert [(r.k, r.ordinal) for r in binary.read_u32(spark, str(f)).orderBy("ordinal").collect()] == [(5, 0), (6, 1), (7, 2)]
    g = tmp_path / "v.bin"
    g.write_bytes(struct.pack("<Q", 3) + np.array([50, 60, 70], "<u4").tobytes())
    assert sorted(tuple(r) for r in binary.read_u32_pairs(spark, str(f), str(g)).collect()) == [(5, 50, 0), (6, 60, 1), (7, 70, 2)]


def test_bin_errors(spark, tmp_path):
    f = tmp_path / "bad.bin"
    f.write_bytes(struct.pack("<Q", 9) + b"\0" * 8)
    with pytest.raises(Exception, match="its count is 9"):
        binary.read_u32(spark, str(f)).count()
    with pytest.raises(Exception, match="must lie"):
        binary.write_u32(spark.createDataFrame([(-1,)], "k bigint"), str(tmp_path / "neg"))
    (tmp_path / "empty").mkdir()
    assert binary.read_u32(spark, str(tmp_path / "empty")).count() == 0


def test_random_multiset(spark):
    a = [r.k for r in binary.random_multiset(spark, 500, 10).collect()]
    assert len(a) == 500 and set(a) == set(range(1, 11)) and a == [r.k for r in binary.random_multiset(spark, 500, 10).collect()]


def test_text_transactions(spark, tmp_path):
    f = tmp_path / "t.dat"
    f.write_text("# c\n1 2  3\n\n// x\nabc\n4x -5 +6 y7\n   \n9\t9\n99999999999999999999 1\n")
    got = [(r.tid, r["items"]) for r in transactions.read_transactions(spark, str(f)).orderBy("tid").collect()]
    assert got == [(0, [1, 2, 3]), (1, [4, -5, 6]), (2, [9, 9]), (3, [1])]
    counted = [r.tid for r in transactions.read_transactions(spark, str(f), count_empty=True).orderBy("tid").collect()]
    assert counted == [0, 2, 3, 4]


def test_tidsets_roundtrip(spark, tmp_path):
    rows = [(i % 7, t) for t in range(50) for i in range(t % 5)] + [(3, 3), (3, 3)]
    df = spark.createDataFrame([*rows, (None, 1)], "item bigint, tid bigint")
    transactions.write_tidsets(df, str(tmp_path / "v"))
    assert sorted(map(tuple, transactions.read_tidsets(spark, str(tmp_path / "v")).collect())) == sorted(rows)
    meta = transactions.read_meta(spark, str(tmp_path / "v" / "meta.json")).first()
    assert (meta.numItems, meta.totalTidsetElements, meta.numTransactions) == (len({i for i, _ in rows}), len(rows), len({t for _, t in rows}))


def test_results(spark, tmp_path):
    transactions.write_results(spark.createDataFrame([("a", 1)], "name string, n int"), str(tmp_path / "r"))
    lines = [json.loads(x) for p in (tmp_path / "r").glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"name": "a", "n": 1}]


def finalizer(h):
    h ^= h >> 16
    h = h * 0x85EBCA6B % 2**32
    h ^= h >> 13
    h = h * 0xC2B2AE35 % 2**32
    return h ^ h >> 16


def test_scalars(spark):
    v = [0, 1, 2, 12345, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(x,) for x in [*v, None]], "k bigint")
    got = {r.k: (r.h, r.s) for r in df.select("k", finalize32(F.col("k")).alias("h"), slot(F.col("k"), 100).alias("s")).collect()}
    assert all(got[x] == (finalizer(x), finalizer(x) & 255) for x in v) and got[None] == (None, None)
    assert [r[0] for r in spark.createDataFrame([(-1,), (0,), (2**32,)], "k bigint").select(is_u32(F.col("k"))).collect()] == [False, True, False]
    assert spark.range(1).select(jaccard(F.lit(1), F.lit(2)), jaccard(F.lit(0), F.lit(0))).first()[:] == (0.5, 0.0)


def test_arrays(spark):
    df = spark.createDataFrame([([1, 1, 2, None], [1, 1, 1, 3]), ([], []), (None, [1])], "a array<int>, b array<int>")
    op = lambda o: [r[0] for r in df.select(array_multiset_op(F.col("a"), F.col("b"), o)).collect()]
    assert op("intersection") == [[1, 1], [], None]
    assert op("union") == [[1, 1, 1, 2, 3], [], None]
    assert op("difference") == [[2], [], None]
    assert op("sym_difference") == [[1, 2, 3], [], None]
    assert [r[0] for r in df.select(array_overlap(F.col("a"), F.col("b"))).collect()] == [1, 0, None]
    kv = spark.createDataFrame([([1, 2], [3, 4]), ([], []), ([1], [2, 3])], "k array<int>, v array<int>")
    got = kv.select(interleave(F.col("k"), F.col("v")).alias("i"), pack_pairs(F.col("k"), F.col("v")).alias("p"), "k", "v").collect()
    assert got[0].i == [1, 3, 2, 4] and [tuple(x) for x in got[0].p] == [(1, 3), (2, 4)] and got[1].p == [] and got[2].p is None
    il = spark.createDataFrame([([1, 3, 2, 4],), ([],), ([1],)], "i array<int>")
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in il.select(split_interleaved(F.col("i"), 1)).collect()] == [[(3, 1), (4, 2)], [], None]


def test_stats(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 5.0), ("b", None), ("c", None)], "k string, v double")
    got = {r.k: r for r in summarize_runs(df, ["k"], "v").collect()}
    assert (got["a"].n, got["a"]["mean"], got["a"].median, got["a"].least, got["a"].most) == (4, 2.5, 2.5, 1.0, 4.0)
    assert got["b"].sd is None and got["c"].n == 0 and got["c"]["mean"] is None


def test_streams(spark, tmp_path):
    from bagworks.streaming.incremental import each_batch, running_multiplicities, windowed_counts

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "x")], "k int, side string").write.parquet(src)
    stream = lambda: spark.readStream.schema("k int, side string").parquet(src)
    q = running_multiplicities(stream(), ["k"], "side").writeStream.outputMode("complete").format("memory").queryName("mult").start()
    q.processAllAvailable(), q.stop()
    assert sorted(map(tuple, spark.sql("select k, m, n from mult").collect())) == [(1, 2, 1), (2, 0, 1)]
    q = each_batch(stream(), lambda b: b.groupBy("k").count(), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable(), q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    src2 = str(tmp_path / "ts")
    spark.sql("select timestamp'2024-01-01 00:00:10' as ts, 1 as k union all select timestamp'2024-01-01 00:20:00', 1").write.parquet(src2)
    s = spark.readStream.schema("ts timestamp, k int").parquet(src2)
    q = windowed_counts(s, "ts", ["k"], width="1 minute", late="5 minutes").writeStream.outputMode("append").format("memory").queryName("win").start()
    q.processAllAvailable(), q.stop()
    assert [r.n for r in spark.sql("select * from win").collect()] == [1]


def test_random_sides_are_sorted_and_repeatable(spark):
    a, b = binary.random_sides(spark, 300, 200, 50, seed=7)
    va, vb = [r.k for r in a.collect()], [r.k for r in b.collect()]
    assert len(va) == 300 and len(vb) == 200 and va == sorted(va) and vb == sorted(vb)
    again = binary.random_sides(spark.range(1).sparkSession, 300, 200, 50, seed=7)
    assert [r.k for r in again[0].collect()] == va and [r.k for r in again[1].repartition(5).orderBy("k").collect()] == vb


def test_a_hot_item_goes_over_several_files(spark, tmp_path):
    rows = [(1, t) for t in range(4000)] + [(2, 5), (3, 6)]
    df = spark.createDataFrame(rows, "item bigint, tid bigint")
    transactions.write_tidsets(df, str(tmp_path / "v"), file_values=700)
    assert len(list((tmp_path / "v").glob("*.items.bin"))) >= 6
    assert sorted(map(tuple, transactions.read_tidsets(spark, str(tmp_path / "v")).collect())) == sorted(rows)
    meta = transactions.read_meta(spark, str(tmp_path / "v" / "meta.json")).first()
    assert (meta.numItems, meta.totalTidsetElements, meta.numTransactions) == (3, 4002, 4000)
    transactions.write_tidsets(df.limit(0), str(tmp_path / "none"))
    assert transactions.read_tidsets(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        transactions.write_tidsets(df, str(tmp_path / "w"), file_values=0)


def test_lines_are_numbered_over_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("1\n\n2 3\n")
    (tmp_path / "b.dat").write_text("4\n" * 500)
    (tmp_path / "c.dat").write_text("# none\n5\n")
    got = [(r.tid, r["items"]) for r in transactions.read_transactions(spark, str(tmp_path)).orderBy("tid").collect()]
    assert got == [(0, [1]), (1, [2, 3]), *[(i, [4]) for i in range(2, 502)], (502, [5])]


def test_files_of_a_store(tmp_path):
    from bagworks.sources import files

    p = f"file:{tmp_path}/x.bin"
    assert files.write_bytes(p, iter([bytes(8), b"abcd"])) == 12
    files.put_count(p, 1)
    assert b"".join(files.read_at(str(tmp_path / "x.bin"), 0, 12, piece=5)) == struct.pack("<Q", 1) + b"abcd"
    assert files.files_of(f"file://{tmp_path}", ".bin") == [f"file://{tmp_path}/x.bin"] and files.size_of(p) == 12
    files.move(p, f"{tmp_path}/y.bin")
    files.delete(p)
    assert files.files_of(str(tmp_path), ".bin") == [f"{tmp_path}/y.bin"]
    with pytest.raises(EOFError):
        list(files.read_at(str(tmp_path / "y.bin"), 8, 9))
    with pytest.raises(FileNotFoundError):
        files.files_of(str(tmp_path / "none"), ".bin")


def test_array_slice_and_wide_cells(spark):
    from bagworks.functions.scalar import array_slice

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 3000).tolist(), rng.integers(100, 500, 2500).tolist()
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    from collections import Counter

    x, y = Counter(a), Counter(b)
    want = {"intersection": x & y, "difference": x - y, "union": x | y, "sym_difference": (x - y) + (y - x)}
    for op, w in want.items():
        assert df.select(array_multiset_op(F.col("a"), F.col("b"), op)).first()[0] == sorted(w.elements())
    assert df.select(array_slice(F.col("a"), 2, 3)).first()[0] == a[2:5] and df.select(array_slice(F.col("a"), 2999, 3)).first()[0] == a[2999:]
    with pytest.raises(ValueError):
        array_multiset_op(F.col("a"), F.col("b"), "none")

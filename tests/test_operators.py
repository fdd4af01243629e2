import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bagworks.operators import batched, graph, joins, mining, scan, skew


def test_scan_matches_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(5)])) for i in range(500)]
    rng.shuffle(rows)
    got = {r.i: r.prefix for r in scan.exclusive_scan(spark.createDataFrame(rows, "i bigint, x bigint"), "x", ["i"], partitions=7).collect()}
    total = 0
    for i, x in sorted(rows):
        assert got[i] == total
        total += x or 0


def test_scan_of_empty_and_clashing_names(spark):
    assert scan.exclusive_scan(spark.createDataFrame([], "i bigint, x bigint"), "x", ["i"]).count() == 0
    df = spark.createDataFrame([(1, 2, 3, 4)], "i bigint, x bigint, __v bigint, __bucket bigint")
    assert scan.exclusive_scan(df, "x", ["i"]).columns == [*df.columns, "prefix"]


def test_bucket_scan_by_key_with_nulls(spark):
    rows = [(k, i // 4, i, i % 3) for k in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, b int, i int, x int")
    got = {(r.k, r.i): r.s for r in scan.bucket_scan(df, F.col("x"), ["k"], ["i"], "b", "s").collect()}
    assert all(got[k, i] == sum(j % 3 for j in range(i)) for k, _, i, _ in rows)


def test_merge_keeps_a_first(spark):
    a, b = spark.createDataFrame([(3,), (1,), (1,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert [tuple(r) for r in scan.sorted_merge(a, b, ["k"]).collect()] == [(1, 0), (1, 0), (1, 1), (2, 1), (3, 0)]


def test_gather(spark):
    values = spark.createDataFrame([(i, i * 10) for i in range(50)], "pos bigint, v bigint")
    seg = spark.createDataFrame([(1, 3, 5), (2, 48, 9), (3, 0, 0), (4, 4, 2), (5, None, 3)], "seg int, off bigint, len bigint")
    got = sorted(map(tuple, scan.segment_gather(values, seg, span=4).collect()))
    want = sorted((s, i, (o + i) * 10) for s, o, n in [(1, 3, 5), (2, 48, 9), (4, 4, 2)] for i in range(n) if o + i < 50)
    assert got == want


@pytest.mark.parametrize("block_bits", [6, 8, 20])
def test_runs(spark, block_bits):
    rng = random.Random(block_bits)
    rows = [(k, p) for k in (1, 2, None) for p in range(-300, 900) if rng.random() < 0.93] + [(7, 63), (7, 64), (7, 64), (7, None)]
    rng.shuffle(rows)
    got = sorted(map(tuple, skew.consecutive_runs(spark.createDataFrame(rows, "item int, tid bigint"), "item", "tid", 2, block_bits=block_bits).collect()))
    want = []
    for k in (1, 2, 7):
        ps = sorted({p for q, p in rows if q == k and p is not None})
        for _, g in itertools.groupby(enumerate(ps), lambda x: x[1] - x[0]):
            g = [p for _, p in g]
            if len(g) >= 2:
                want.append((k, g[0], g[-1]))
    assert got == sorted(want)


def test_runs_longer_than_blocks_and_empty(spark):
    df = spark.range(1, 1000).select(F.lit(5).alias("item"), F.col("id").alias("tid"))
    for least in (48, 64, 200, 999):
        assert [tuple(r) for r in skew.consecutive_runs(df, "item", "tid", least, block_bits=6).collect()] == [(5, 1, 999)]
    assert skew.consecutive_runs(df.where("tid < 0"), "item", "tid", 1).count() == 0
    with pytest.raises(ValueError):
        skew.consecutive_runs(df, "item", "tid", 0)


def test_profile(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(-100, 400)) for k in (1, 2) for _ in range(400)] + [(None, 3), (1, None)]
    got = {r.item: tuple(r)[1:] for r in skew.position_profile(spark.createDataFrame(rows, "item int, tid bigint"), "item", "tid").collect()}
    for k in (1, 2):
        ps = [p for q, p in rows if q == k and p is not None]
        own = set(ps)
        assert got[k] == (len(ps), len(own), min(own), max(own), sum(p - 1 not in own for p in own))


def test_salted_aggregate_and_hot_keys(spark):
    rows = [(1, i) for i in range(300)] + [(None, i) for i in range(50)] + [(i, i) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "k int, salt int")
    got = {r.k: (r.n, r.s) for r in skew.salted_aggregate(df, ["k"], {"c": F.count(F.lit(1)), "t": F.sum("salt")}, {"n": F.sum("c"), "s": F.sum("t")}, salt_on=["salt"], salts=7).collect()}
    want = {k: (sum(1 for q, _ in rows if q == k), sum(v for q, v in rows if q == k)) for k in {k for k, _ in rows}}
    assert got == want
    assert [tuple(r) for r in skew.hot_keys(df, ["k"], share=0.1).collect()] == [(1, 300), (None, 50)]
    assert skew.hot_keys(df.where("k = -1"), ["k"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join(spark, how):
    a = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 99), (3, 98), (None, 97)], "k int, x int")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (None, "s")], "k int, y string")
    got = skew.salted_join(a, b, ["k"], hot=spark.createDataFrame([(1,)], "k int"), salts=4, how=how)
    want = a.join(b, ["k"], how)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_joins(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "w")], "k int, v string")
    assert joins.equi_join(a, b, ["k"]).columns == ["k", "v", "b_v"] and joins.equi_join(a, b, ["k"]).count() == 4
    assert sorted(r.v for r in joins.semi_join(a, b, ["k"]).collect()) == ["a", "b"]
    assert sorted(r.v for r in joins.anti_join(a, b, ["k"]).collect()) == ["c", "d"]
    c = spark.createDataFrame([("x", 1)], "b_v string, z int")
    assert joins.chain_join(a, (b, ["k"]), (c, ["b_v"])).count() == 2


def test_batched(spark):
    sets_ = {"a": [1, 1, 2, 3], "b": [1, 1, 1, 3, 4], "c": [9]}
    rows = [(s, v) for s, vs in sets_.items() for v in vs] + [(None, 1), ("c", None)]
    df = spark.createDataFrame(rows, "set_id string, k bigint")
    pairs = spark.createDataFrame([(0, "a", "b"), (1, "a", "c"), (2, "a", "none"), (3, "none", "none")], "pair_id bigint, a_id string, b_id string")
    got = {r.pair_id: r for r in batched.batched_counts(pairs, df).collect()}
    for i, x, y in [(0, "a", "b"), (1, "a", "c"), (2, "a", "none"), (3, "none", "none")]:
        ca, cb = Counter(sets_.get(x, [])), Counter(sets_.get(y, []))
        inter, union = sum((ca & cb).values()), sum((ca | cb).values())
        assert (got[i]["intersection"], got[i]["union"], got[i].difference, got[i].sym_difference) == (inter, union, sum((ca - cb).values()), union - inter)
        assert got[i].jaccard == (inter / union if union else 0)
    cells = {r.pair_id: (r["keys"], r.n) for r in batched.batched_intersections(pairs, df, arrays=True).collect()}
    assert cells == {0: ([1, 1, 3], 3), 1: ([], 0), 2: ([], 0), 3: ([], 0)}
    assert batched.all_pairs(df).count() == 3


def brute_itemsets(db, least):
    out = Counter()
    for items in db:
        for k in range(1, len(set(items)) + 1):
            out.update(itertools.combinations(sorted(set(items)), k))
    return {k: v for k, v in out.items() if v >= least}


def test_eclat(spark):
    rng = random.Random(5)
    db = [[rng.randint(0, 7) for _ in range(rng.randint(0, 6))] for _ in range(60)]
    df = spark.createDataFrame([(i, [*x, None]) for i, x in enumerate(db)] + [(99, None)], "tid bigint, items array<int>")
    long = mining.vertical(df)
    assert {tuple(r.itemset): r.support for r in mining.eclat(long, 4).collect()} == brute_itemsets(db, 4)
    assert max(r["size"] for r in mining.eclat(long, 4, max_size=2).collect()) == 2
    assert mining.eclat(long.where("tid < 0"), 1).count() == 0
    assert {r.item: r.tids for r in mining.tidsets(long).collect()} == {x: [i for i, b in enumerate(db) if x in b] for x in range(8)}


def test_eclat_multiset(spark):
    df = spark.createDataFrame([(1, [1, 1, 2]), (2, [1, 2, 2])], "tid bigint, items array<int>")
    got = {tuple(r.itemset): r.support for r in mining.eclat(mining.vertical(df, multiset=True), 1).collect()}
    assert got == {(1,): 3, (2,): 3, (1, 2): 2}


def test_triangles(spark):
    rng = random.Random(7)
    e = [(0, i) for i in range(1, 30)] + [(rng.randint(0, 29), rng.randint(0, 29)) for _ in range(120)] + [(3, 3), (None, 1)]
    own = {frozenset(x) for x in e if None not in x and x[0] != x[1]}
    want = sum(all(frozenset(p) in own for p in itertools.combinations(t, 2)) for t in itertools.combinations(range(30), 3))
    assert graph.triangle_count(spark.createDataFrame(e, "src int, dst int")).first()[0] == want
    assert graph.triangle_count(spark.createDataFrame([], "src int, dst int")).first()[0] == 0


def test_pairs_by_element_and_by_list_are_the_same(spark):
    rng = random.Random(5)
    sets = {s: Counter(rng.choice([rng.randint(0, 5), rng.randint(0, 60)]) for _ in range(rng.randint(0, 40))) for s in range(30)}
    df = spark.createDataFrame([(s, k) for s, c in sets.items() for k in c.elements()] + [(None, 1), (1, None)], "set_id int, k int")
    for n in (3, 40):  # few pairs: elements in many sets go by the list
        pairs = [(i, rng.randrange(31), rng.randrange(31)) for i in range(n)] + [(n, 4, 4), (n + 1, 2, 3), (n + 2, 3, 2), (n + 3, None, 1)]
        got = {r.pair_id: r.intersection for r in batched.batched_counts(spark.createDataFrame(pairs, "pair_id int, a_id int, b_id int"), df).collect()}
        assert got == {i: sum((sets.get(a, Counter()) & sets.get(b, Counter())).values()) for i, a, b in pairs}


def test_all_pairs_and_clashing_ids(spark):
    df = spark.createDataFrame([(s, 1) for s in "abcde"] + [("a", 2), (None, 3)], "set_id string, k int")
    got = batched.all_pairs(df, blocks=3).collect()
    assert {(r.a_id, r.b_id) for r in got} == set(itertools.combinations("abcde", 2)) and len({r.pair_id for r in got}) == len(got) == 10
    assert batched.all_pairs(df.limit(0)).count() == 0


def test_places_and_a_sorted_beginning(spark):
    values = [5, 3, None, 9, 1, 1, 7]
    df = spark.createDataFrame(list(enumerate(values)), "pos int, v int")
    got = {r.pos: r.v for r in scan.sort_first(df, "pos", ["v"], 5).collect()}
    assert [got[i] for i in range(7)] == [None, 1, 3, 5, 9, 1, 7]
    assert sorted((r.place, r.v) for r in scan.place(df.dropna(), ["v"]).collect()) == list(enumerate(sorted(v for v in values if v is not None)))
    assert scan.sort_first(df.limit(0), "pos", ["v"], 5).count() == 0


def test_more_hot_keys_than_are_sent(spark, monkeypatch):
    big = spark.createDataFrame([(i % 7, i) for i in range(200)] + [(None, 0)], "k int, x int")
    small = spark.createDataFrame([(k, k * 10) for k in range(5)], "k int, y int")
    want = sorted(map(tuple, big.join(small, "k").collect()))
    for limit in (10_000, 2):
        monkeypatch.setattr(skew, "HOT_KEYS", limit)
        assert sorted(map(tuple, skew.salted_join(big, small, ["k"], hot=big.select("k").distinct()).collect())) == want


def test_long_runs_inside_and_across_blocks(spark):
    tids = [*range(10, 40), *range(60, 70), *range(100, 300), 500]
    df = spark.createDataFrame([(1, t) for t in tids] * 2 + [(None, 5), (1, None)], "item int, tid bigint")
    got = sorted((r.lo, r.hi) for r in skew.consecutive_runs(df, "item", "tid", 10, block_bits=6).collect())
    assert got == [(10, 39), (60, 69), (100, 299)]


def test_a_shared_folder_is_asked_for_off_local_masters(spark, monkeypatch):
    from types import SimpleNamespace

    from bagworks.session import shared_dir

    none = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, getCheckpointDir=lambda: None, master="spark://x:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(fake)

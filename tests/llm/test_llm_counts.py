import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagworks.llm.frequencies import heavy_terms, term_frequencies
from bagworks.llm.leaders import leading_terms
from bagworks.llm.occurrences import basket_occurrences, baskets, long_occurrences
from bagworks.llm.overlap import PairCounter, build, descend, descent_report, mix32, set_overlaps
from bagworks.llm.pairs import pair_counts

TX = "db_id int, tid bigint, items array<int>, extra int, owner string"


def transactions(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], TX)


def random_baskets(seed, n=300):
    rng = random.Random(seed)
    out = []
    for t in range(n):
        items = [rng.choice([1, 1, 2, 3, -2147483648, 2147483647, rng.randint(4, 40)]) for _ in range(rng.randint(1, 8))]
        out.append((rng.choice([1, 1, 1, 2]), t, items))
    return out


def brute_pairs(rows, least, lift):
    by = {}
    for db, t, items in rows:
        by.setdefault(db, {}).setdefault(t, set()).update(x for x in items or [] if x is not None)
    out = {}
    for db, ts in by.items():
        ts = [s for s in ts.values() if s]
        c = Counter(x for s in ts for x in s)
        for (a, b), k in Counter(p for s in ts for p in itertools.combinations(sorted(s), 2)).items():
            if k >= least and k * len(ts) >= lift * c[a] * c[b]:
                out[db, a, b] = (k, c[a], c[b], len(ts))
    return out


@pytest.mark.parametrize("least, lift, few", [(1, 0, True), (3, 0, False), (3, 1.2, True), (2, 1.5, False)])
def test_pairs(spark, monkeypatch, least, lift, few):
    import bagworks.llm.pairs as p

    monkeypatch.setattr(p, "ITEM_BLOCK", 5)
    monkeypatch.setattr(p, "RECORD_BLOCK", 60)
    rows = random_baskets(least)
    again = [(db, t, random.Random(t).sample(x, len(x))) for db, t, x in rows[::5]]  # delivered again, in another order
    odd = [(1, 9001, None), (1, 9002, []), (1, 9003, [None]), (None, 9004, [1, 2]), (1, None, [1, 2])]
    base = baskets(transactions(spark, rows + again + odd), "db_id", "tid", "items")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in pair_counts(base, least, lift, dictionary_rows=10**6 if few else 0).collect()}
    assert got == brute_pairs(rows, least, lift)


def test_pairs_of_nothing(spark):
    base = baskets(transactions(spark, [(1, 1, None)]), "db_id", "tid", "items")
    assert pair_counts(base, 1).count() == 0 and pair_counts(base, 1, dictionary_rows=0).count() == 0
    with pytest.raises(ValueError):
        pair_counts(base, 0)


def long_rows(seed, n=800):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 2]), 10 ** 12 + (t := rng.randint(0, 90)), rng.choice([5, 5, 5, 6, 7, rng.randint(-50, 50)]), rng.randint(0, 3)) for _ in range(n)]
    rows += rows[::7] + [(1, None, 5, 0), (1, 3, None, 0), (None, 3, 5, 0), (1, 10 ** 12, 5, None), (1, 10 ** 12, 5, None)]
    return rows


def occurrences(rows):
    return {(o, t, x, -1 if p is None else p) for o, t, x, p in rows if None not in (o, t, x)}


@pytest.mark.parametrize("heavy", [None, [], [5, 6]])
def test_frequencies(spark, heavy):
    rows = long_rows(4)
    df = spark.createDataFrame([(*r, 1) for r in rows], "file_id int, tid bigint, item int, pos int, slot int")
    keys = None if heavy is None else np.array([(o << 32) + x + 2**31 for o in (1, 2) for x in heavy], np.int64)
    got = {(r.owner, r.term): (r.occurrences, r.records) for r in term_frequencies(long_occurrences(df, "file_id", "tid", "item", "pos"), keys).collect()}
    occ = occurrences(rows)
    want = {(o, x): (sum(1 for q in occ if (q[0], q[2]) == (o, x)), len({q[1] for q in occ if (q[0], q[2]) == (o, x)})) for o, _, x, _ in occ}
    assert {k: v for k, v in got.items() if k[1] is not None} == want
    assert {k[0]: v[1] for k, v in got.items() if k[1] is None} == {o: len({q[1] for q in occ if q[0] == o}) for o in (1, 2)}


def test_frequencies_of_baskets_and_nothing(spark):
    df = transactions(spark, [(1, 1, [3, 3, None]), (1, 1, [3, None, 3]), (1, 2, []), (1, 3, None)])
    occ = basket_occurrences(baskets(df, "db_id", "tid", "items"))
    assert sorted(map(tuple, term_frequencies(occ).where("term is not null").collect())) == [(1, 3, 2, 1)]
    assert term_frequencies(occ.where("owner = 9")).count() == 0
    assert len(heavy_terms(occ)) == 0


@pytest.mark.parametrize("share", [0.01, 0.05, 0.3, 1.0])
def test_leaders(spark, share):
    rows = long_rows(9, 3000)
    df = spark.createDataFrame(rows, "file_id int, tid bigint, item int, pos int")
    got = {(r.owner, r.term): (r.occurrences, r.owner_occurrences) for r in leading_terms(long_occurrences(df, "file_id", "tid", "item", "pos"), share).collect()}
    occ = occurrences(rows)
    n, per = Counter(q[0] for q in occ), Counter((q[0], q[2]) for q in occ)
    assert got == {k: (c, n[k[0]]) for k, c in per.items() if c >= share * n[k[0]] - 1e-9}


def test_leaders_of_many_owners(spark, monkeypatch):
    occ = spark.range(60000).select((F.col("id") % 30000).cast("int").alias("owner"), F.col("id").alias("record"), (F.col("id") % 2).cast("int").alias("term"), F.lit(0).alias("slot"))
    assert leading_terms(occ, 0.5).count() == 30000
    assert leading_terms(occ.where("owner < 0"), 0.5).count() == 0


def brute_overlaps(rows):
    sets = {}
    for s, k in rows:
        if s is not None and k is not None:
            sets.setdefault(s.strip().upper(), set()).add(k)
    return {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}


@pytest.mark.parametrize("chunk", [50, 10**6])
def test_overlaps(spark, monkeypatch, chunk):
    import bagworks.llm.overlap as o

    monkeypatch.setattr(o, "_CHUNK", chunk)
    rng = random.Random(chunk)
    common = [rng.randrange(2**32) for _ in range(40)]
    rows = [(rng.choice([f"s{i}", f" S{i} ", f"S{i}\t"]), rng.choice([*common, rng.randrange(2**32), 0, 2**32 - 1])) for i in range(90) for _ in range(rng.randint(1, 60))]
    rows += rows[::3] + [(None, 1), ("s1", None), ("empty", None)]
    got = {tuple(r)[:2]: tuple(r)[2:] for r in set_overlaps(spark.createDataFrame(rows, "set_id string, k bigint"), "set_id", "k").collect()}
    assert got == brute_overlaps(rows)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6])
@pytest.mark.parametrize("entries", [40, 10**6])
def test_overlaps_of_hot_values(spark, monkeypatch, share, entries):
    """Blocks of few sets and pieces of few entries: every pair meets once, whether hot values, others or both carry it."""
    import bagworks.llm.overlap as o

    for name, n in (("_HOT", 6), ("_SETS", 5), ("_ENTRIES", entries)):
        monkeypatch.setattr(o, name, n)
    rng = random.Random(entries)
    hot, some = ([rng.randrange(2**32) for _ in range(n)] for n in (12, 60))
    rows = []
    for i in range(40):
        mine = rng.sample(hot, rng.randint(0, 12)) + rng.sample(some, rng.randint(0, 6)) + [rng.randrange(2**32) for _ in range(rng.choice([0, 3, 40]))]
        rows += [(f"s{i}", k) for k in mine]
    want = {p: x for p, x in brute_overlaps(rows).items() if x[0] >= share * min(x[1:]) - 1e-9}
    got = [tuple(r) for r in set_overlaps(spark.createDataFrame(rows, "set_id string, k bigint"), "set_id", "k", min_share=share).collect()]
    assert len(got) == len(want) and {r[:2]: r[2:] for r in got} == want


def test_hot_values_send_no_pair_from_every_range(spark):
    """Their sets are sent, a row an entry, instead of each range's pairs of sets."""
    from bagworks.llm.overlap import _overlaps

    rows = [(f"s{i}", k * 7919) for i in range(100) for k in range(30)]
    sums, _ = _overlaps(spark.createDataFrame(rows, "set_id string, k bigint"), "set_id", "k", None)
    assert sums.where("kind = 0").count() == 0 and sums.where("kind not in (0, 1, 2)").count() == len(rows)


def test_overlap_edges(spark):
    e = spark.createDataFrame([], "set_id string, k bigint")
    assert set_overlaps(e, "set_id", "k").count() == 0
    with pytest.raises(Exception, match="must lie"):
        set_overlaps(spark.createDataFrame([("a", -1)], "set_id string, k bigint"), "set_id", "k").count()


def descended(sets, start=8):
    rows = sorted((m, i) for i, s in enumerate(sets) for m in s)
    c = PairCounter(len(sets))
    m, i = (np.array(x) for x in zip(*rows))
    descend(build(m.astype(np.uint64), i, len(sets), start), c)
    return {(a, b): n for a, b, n in zip(*(x.tolist() for x in c.result()))}, c


def test_complete_subtrees_end_the_descent():
    """Two sets of which one fills a whole range, or both are the same in it, are counted from subtree counts."""
    full = set(range(1 << 18))
    part = {x for x in full if x % 1000 == 0}
    got, c = descended([full, part])
    assert got == {(0, 1): len(part)} and c.leaves == 0 and 0 < c.subtrees < 50
    rng = random.Random(3)
    same = {rng.randrange(2**32) for _ in range(3000)}
    got, c = descended([same, set(same)])
    assert got == {(0, 1): len(same)} and c.leaves == 0


@pytest.mark.parametrize("seed", range(6))
def test_descent(seed, monkeypatch):
    import bagworks.llm.overlap as o

    monkeypatch.setattr(o, "_WIDE", 4)
    monkeypatch.setattr(o, "_BLOCK", 3)
    rng = random.Random(seed)
    close = [rng.randrange(2**32) for _ in range(30)]
    near = [x ^ rng.randrange(8) for x in close]  # settled at the leaves only
    sets = [{rng.choice([*close, *near, rng.randrange(2**32)]) for _ in range(rng.randint(1, 80))} for _ in range(12)]
    if seed > 3:
        sets.append(set(range(5 << 20, (5 << 20) + (1 << 12))))
        sets[0] |= {(5 << 20) + 7, (5 << 20) + 9}
    got, c = descended(sets)
    assert got == {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] & sets[b]}
    assert c.subtrees and c.skipped


def test_most_entries_are_settled_above_the_leaves(spark, data):
    from bagworks.plans.tables import table

    got = {r.outcome: r.entries for r in descent_report(table(spark, data, "kmer_sets"), "set_id", "k").collect()}
    assert got["subtree"] > 10 * got["leaf"] and got["skipped"] > 0


def test_mix_is_a_bijection():
    x = np.concatenate((np.arange(200_000), 2**32 - 1 - np.arange(200_000)))
    assert len(np.unique(mix32(x))) == len(x) and mix32(x).max() < 2**32


def test_one_record_of_many_items_is_taken_in_pieces(monkeypatch):
    import bagworks.llm.pairs as p

    monkeypatch.setattr(p, "FOLD", 1000)
    items = np.arange(300)
    off = np.array([0, 300])
    parts = list(p._products(off, items, np.ones(300, bool)))
    assert max(len(a) for a, _ in parts) < 1400 and sum(len(a) for a, _ in parts) == 300 * 299 // 2
    assert {(a, b) for x, y in parts for a, b in zip(x.tolist(), y.tolist())} == set(itertools.combinations(range(300), 2))

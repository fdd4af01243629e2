import itertools
import math
import random

import numpy as np
import pytest

from bagworks.llm.quantiles import Summary, collapse, exact_quantiles, merge_summaries, quantiles_of, summarize
from bagworks.llm.similar import classes, pivot_cells, similar_classes, similar_pairs


def exact(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v) - 1e-9)) - 1]


@pytest.mark.parametrize("size, fan", [(64, 4), (257, 8)])
def test_rank_error_is_bounded(size, fan):
    rng = np.random.default_rng(size)
    values = np.concatenate([rng.lognormal(size=40_000), np.full(20_000, 1.5)])
    rng.shuffle(values)
    s = Summary(size, fan)
    for part in np.array_split(values, 37):
        s.add(part)
    buffers = s.buffers()
    assert sum(w * len(v) for _, w, _, v in buffers) == len(values)
    bound = sum(e for _, _, e, _ in buffers)
    assert bound < 0.12 * len(values)
    v = np.concatenate([v for *_, v in buffers])
    w = np.concatenate([np.full(len(v), w) for _, w, _, v in buffers])
    order = np.argsort(v, kind="stable")
    cum = np.cumsum(w[order])
    for p in (0.01, 0.25, 0.5, 0.9, 0.99):
        q = v[order][np.searchsorted(cum, p * len(values))]
        lo, hi = (values < q).sum(), (values <= q).sum()
        assert lo - bound <= p * len(values) <= hi + bound


def test_collapse_doesnt_depend_on_order():
    rng = np.random.default_rng(1)
    b = [(k + 1, 0, np.sort(rng.normal(size=50))) for k in range(4)]
    one, two = collapse(b, 50), collapse(b[::-1], 50)
    assert one[:2] == two[:2] and (one[2] == two[2]).all()


def test_quantiles_by_group_and_merged_days(spark):
    rng = random.Random(2)
    rows = [(k, d, rng.choice([rng.expovariate(1), 0.5])) for k in ("a", "b", None) for d in range(5) for _ in range(rng.randint(5, 400))]
    odd = [("a", 0, None), ("a", 0, float("nan")), ("b", 0, float("inf"))]
    df = spark.createDataFrame(rows + odd, "k string, d int, v double")
    probs = [0.0, 0.5, 0.95, 1.0]
    q = quantiles_of(summarize(df, ["k"], "v"), ["k"], probs)
    whole = {r.k: r for r in exact_quantiles(df, ["k"], "v", q, probs).collect()}
    days = merge_summaries(summarize(df, ["k", "d"], "v"), ["k", "d"])
    p = quantiles_of(days.drop("d"), ["k"], probs)
    parts = {r.k: r for r in exact_quantiles(df, ["k"], "v", p, probs).collect()}
    errors = [r.rank_error for r in q.collect() + p.collect()]
    assert len(errors) == 6 and max(errors) > 0
    for k in ("a", "b", None):
        own = [v for q, _, v in rows if q == k]
        assert whole[k].n == parts[k].n == len(own)
        assert whole[k].quantiles == parts[k].quantiles == [exact(own, p) for p in probs]


@pytest.mark.parametrize("held", [1_000_000, 3000])
def test_large_groups_stay_within_the_error(spark, held):
    """With few values held, summaries are handed on often and merged by several rounds of lanes."""
    df = spark.range(0, 300_000, numPartitions=6).selectExpr("cast(id % 2 as int) as k", "cast((id * 7919) % 300007 as double) as v")
    for r in quantiles_of(summarize(df, ["k"], "v", held_values=held), ["k"], [0.5, 0.95], held_values=held).collect():
        assert r.n == 150_000 and 0 < r.rank_error < 0.02 * r.n
        for p, q, lo, hi in zip((0.5, 0.95), r.quantiles, r.above, r.upto):
            assert abs(q / 300007 - p) < 0.001 + r.rank_error / r.n and lo < q <= hi


def test_buffers_collapse_on_the_tables(spark, data):
    from bagworks.llm.queries import QUERIES

    rows = QUERIES["p5_summaries"](spark, data.replace("sf0.001", "sf0.01")).collect()
    assert sum(r.rank_error > 0 for r in rows) >= 3 and all(r.rank_error < 0.02 * r.n_values for r in rows)


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert quantiles_of(summarize(df, ["k"], "v"), ["k"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles_of(summarize(df, ["k"], "v"), ["k"], [1.5])


def records(seed, n=120):
    rng = random.Random(seed)
    out, i = [], 0
    for _ in range(n):
        s = {rng.choice([rng.randint(0, 30), rng.randint(0, 5000)]) for _ in range(rng.randint(1, 14))}
        out.append((i := i + 1, list(s)))
        for _ in range(rng.choice([0, 0, 1, 3])):  # copies, changed a little
            t = set(s)
            if t and rng.random() < 0.7:
                t.pop()
            if rng.random() < 0.5:
                t.add(rng.randint(0, 5000))
            out.append((i := i + 1, list(t) * rng.choice([1, 2])))
    # a cell of hot values only, larger than a task's share
    hot = [list(range(k, k + 9)) for k in range(20)]
    out += [(i + 1 + j, [*hot[j % 20], 10_000 + j % 3]) for j in range(90)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("cell_rows, num, den", [(20_000, 7, 10), (30, 7, 10), (5, 5, 10), (20_000, 1, 1)])
def test_similar(spark, cell_rows, num, den):
    rows = records(cell_rows + num)
    odd = [(9001, None), (9002, []), (9003, [None]), (None, [1, 2, 3])]
    m = classes(spark.createDataFrame([(i, None if v is None else [*v, None]) for i, v in rows + odd], "id bigint, v array<bigint>"), "id", "v", 3).cache()
    links = similar_classes(m, num, den, cell_rows=cell_rows)
    got = {tuple(r) for r in similar_pairs(m, links).collect()}
    own = {i: set(v) for i, v in rows if len(set(v)) >= 3}
    want = {(a, b) for a, b in itertools.combinations(sorted(own), 2) if den * len(own[a] & own[b]) >= num * len(own[a] | own[b])}
    assert got == want and len(want) > 30
    found = links.collect()
    assert len({r[:4] for r in found}) == len(found) and all(r.shared * (den + num) >= num * (r.n_a + r.n_b) for r in found)


def test_similar_nothing(spark):
    m = classes(spark.createDataFrame([], "id bigint, v array<bigint>"), "id", "v", 3)
    assert similar_pairs(m, similar_classes(m)).count() == 0
    with pytest.raises(ValueError):
        similar_classes(m, 0, 10)


@pytest.mark.parametrize("cell_rows", [20_000, 20])
def test_pivots_hold_large_groups_of_near_copies(spark, cell_rows):
    """A third of all records around one set: few pivots, each record once at home, guests within the triangle inequality."""
    rng = random.Random(cell_rows)
    centres = [rng.sample(range(400), 30) for _ in range(6)]
    sets = []
    for i in range(300):
        c = set(centres[0] if i < 100 else rng.choice(centres) if rng.random() < 0.5 else rng.sample(range(400), rng.randint(3, 25)))
        for _ in range(rng.randint(0, 3)):
            c ^= {rng.randrange(400)}
        sets.append(sorted(c))
    m = classes(spark.createDataFrame(list(enumerate(sets)), "id bigint, v array<bigint>"), "id", "v", 1).cache()
    key = {(r.h1, r.h2): set(r.v) for r in m.collect()}
    dist = lambda x, y: 1 - len(x & y) / len(x | y)
    own, guests = (d.collect() for d in pivot_cells(m, cell_rows=cell_rows))
    home = {(r.h1, r.h2): (r.p1, r.p2) for r in own}
    assert len(home) == len(own) and len(set(home.values())) < len(own) * 0.8
    for r in own + guests:
        assert r.d == pytest.approx(dist(key[r.h1, r.h2], key[r.p1, r.p2]))
    assert all(r.d <= 0.15 + 1e-9 for r in own) and all(0 < r.d <= 0.45 + 1e-9 for r in guests) and guests
    got = {tuple(r) for r in similar_pairs(m, similar_classes(m, cell_rows=cell_rows)).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(300), 2) if 10 * len(set(sets[a]) & set(sets[b])) >= 7 * len(set(sets[a]) | set(sets[b]))}
    assert got == want and len(want) > 1000

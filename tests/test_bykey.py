import random

import pytest

from bagworks.operators import bykey


def merged(a, b, op):
    """The rule of a merge of two sorted inputs: equal keys advance together."""
    a, b, out, i, j = sorted(a), sorted(b), [], 0, 0
    while i < len(a) or j < len(b):
        if j == len(b) or i < len(a) and a[i][0] < b[j][0]:
            if op != "intersection":
                out.append(a[i])
            i += 1
        elif i == len(a) or b[j][0] < a[i][0]:
            if op in ("union", "sym_difference"):
                out.append(b[j])
            j += 1
        else:
            if op in ("intersection", "union"):
                out.append(a[i])
            i, j = i + 1, j + 1
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v bigint")


OPS = ["intersection", "difference", "union", "sym_difference"]


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("hot", [None, 5])
def test_random(spark, op, hot):
    rng = random.Random(f"{op}{hot}")
    a = [(rng.randint(0, 8) * rng.randint(0, 1), i) for i in range(60)]
    b = [(rng.randint(0, 8), 100 + i) for i in range(50)]
    got = bykey.by_key(frame(spark, a), frame(spark, b), ["k"], ["v"], op, hot_rows=hot)
    assert sorted(map(tuple, got.collect())) == merged(a, b, op)


def test_union_takes_the_last_extra_copies(spark):
    a = list(zip([1, 1, 2, 2, 3, 3], [10, 11, 20, 21, 30, 31]))
    b = list(zip([1, 2, 2, 2, 3], [12, 22, 23, 24, 32]))
    got = sorted(map(tuple, bykey.by_key(frame(spark, a), frame(spark, b), ["k"], ["v"], "union").collect()))
    assert got == sorted([*a, (2, 24)])


@pytest.mark.parametrize("op", OPS)
def test_empty_null_and_ties(spark, op):
    e, a = frame(spark, []), frame(spark, [(1, 1), (1, 1), (None, 2), (2, None)])
    n = lambda x, y: bykey.by_key(x, y, ["k"], ["v"], op).count()
    assert n(e, e) == 0
    assert n(a, e) == (0 if op == "intersection" else 3)
    assert n(e, a) == (3 if op in ("union", "sym_difference") else 0)
    assert n(a, a) == (3 if op in ("intersection", "union") else 0)


def test_clashing_column(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k bigint, v bigint, __r string")
    b = spark.createDataFrame([(1, 5, "z")], "k bigint, v bigint, __r string")
    got = bykey.by_key(a, b, ["k"], ["v"], "difference")
    assert got.columns == ["k", "v", "__r"] and [tuple(r) for r in got.collect()] == [(1, 2, "y")]


def test_first_match(spark):
    a, b = frame(spark, [(1, 9), (1, 3), (2, 4), (None, 1)]), frame(spark, [(1, 100), (1, 101), (3, 5), (None, 7)])
    got = sorted(map(tuple, bykey.first_match_join(a, b, ["k"], ["v"]).collect()))
    assert got == [(1, 3, 100), (1, 3, 101)]

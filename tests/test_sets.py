from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from bagworks.operators import sets

WANT = {
    "intersection": lambda m, n: min(m, n),
    "difference": lambda m, n: max(m - n, 0),
    "union": max,
    "sym_difference": lambda m, n: abs(m - n),
}


def frame(spark, values, extra=False):
    if extra:
        return spark.createDataFrame([(v, 7) for v in values], "k bigint, __m int")
    return spark.createDataFrame([(v,) for v in values], "k bigint")


def expected(a, b, op):
    ca, cb = Counter(a), Counter(b)
    return Counter({k: c for k in ca | cb if (c := WANT[op](ca[k], cb[k]))})


CASES = [
    ([1, 3, 3, 5, 7, 9], [2, 3, 3, 6, 7, 8]),
    ([1, 1, 1, 2, 2, 3], [1, 1, 2, 2, 2, 3]),
    ([5] * 100, [5] * 100),
    ([], [1, 1]),
    ([1, 1], []),
    ([], []),
    ([0, 4294967295, 4294967295], [4294967295, 0, 0]),
    ([None, None, 1], [None, 1, 1]),
    (list(range(1000)), list(range(1, 1001))),
    ([i * 3 // 2 for i in range(2999)], [2 * i for i in range(3001)]),
]


@pytest.mark.parametrize("op", sets.OPS)
@pytest.mark.parametrize("case", range(len(CASES)))
def test_cases(spark, op, case):
    a, b = CASES[case]
    got = Counter(r[0] for r in sets.multiset_op(frame(spark, a), frame(spark, b), op).collect())
    assert got == expected(a, b, op)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(st.integers(0, 6), max_size=40), b=st.lists(st.integers(0, 6), max_size=40))
def test_random_counts(spark, a, b):
    r = sets.op_counts(frame(spark, a), frame(spark, b)).first()
    for op in sets.OPS:
        assert r[op] == sum(expected(a, b, op).values())
    assert r["intersection"] + r["union"] == len(a) + len(b)
    assert r["difference"] + r["intersection"] == len(a)
    assert r["sym_difference"] == r["union"] - r["intersection"]


def test_large_multiplicity_and_clashing_names(spark):
    a, b = frame(spark, [1] * 70000 + [2], extra=True), frame(spark, [1], extra=True)
    got = Counter(r[0] for r in sets.difference(a, b).collect())
    assert got == {1: 69999, 2: 1}
    assert sets.difference(a, b).columns == ["k", "__m"]


def test_distinct(spark):
    a, b = frame(spark, [1, 1, 2, 3]), frame(spark, [2, 2, 4])
    get = lambda op: sorted(r[0] for r in sets.distinct_op(a, b, op).collect())
    assert [get(op) for op in sets.OPS] == [[2], [1, 3], [1, 2, 3, 4], [1, 3, 4]]


def test_bad_op(spark):
    with pytest.raises(ValueError):
        sets.multiset_op(frame(spark, [1]), frame(spark, [1]), "xor")


def test_copies_of_few_rows_leave_in_many_tasks(spark):
    from bagworks.operators.sets import unfold

    df = spark.createDataFrame([("a", 400_000), ("b", 400_000), (None, 9), ("c", 8), ("d", 0), ("e", None)], "k string, n bigint")
    out = unfold(df, "n", 8)
    assert {r.k: r["count"] for r in out.groupBy("k").count().collect()} == {"a": 400_000, "b": 400_000, None: 9, "c": 8}
    per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per) < 0.4 * 800_017

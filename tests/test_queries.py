"""Every query of the core beside its SQL, over the smallest tables."""

import pytest
from compare import check_query

from bagworks.plans import catalog, skewed

QUERIES = catalog.QUERIES | skewed.QUERIES
ORACLE = catalog.ORACLE | skewed.ORACLE


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, data, name):
    check_query(spark, duck, data, QUERIES[name], ORACLE.get(name))


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_pairs_come_out_with_their_arrays(spark, data):
    rows = QUERIES["batched_intersect_arrays"](spark, data).select("a_id", "b_id").collect()
    ids = {i for r in rows for i in r}
    assert len({r.a_id for r in rows}) > 1 and len(rows) == len(set(rows)) == len(ids) * (len(ids) - 1) // 2

"""Queries beside their SQL over the smallest tables; those without SQL only run, their operators are tested on their own."""

import pytest
from compare import check_query

from bagworks.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, data, name):
    check_query(spark, duck, data, QUERIES[name], ORACLE.get(name))


def test_every_problem_has_queries():
    assert {n.split("_")[0] for n in QUERIES} == {"p1", "p2", "p3", "p5", "p6", "p7", "p8", "p9", "p10"} and ORACLE.keys() <= QUERIES.keys()


def test_rare_pairs_are_counted(spark, duck, data):
    rare = {tuple(r) for r in QUERIES["p1_counts"](spark, data).where("c_ab < 15").select("db_id", "item_a", "item_b", "c_ab").collect()}
    sql = """with o as (select distinct db_id, tid, unnest(items) as item from transactions where db_id is not null and tid is not null)
     select x.db_id, x.item, y.item, count(*) from o x join o y on x.db_id = y.db_id and x.tid = y.tid and x.item < y.item group by all having count(*) < 15"""
    assert rare and rare == set(duck.execute(sql).fetchall())

"""Problem 4: results over the ordered tids of every single item, though a few items hold most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagworks.operators.skew import consecutive_runs, position_profile, salted_aggregate
from bagworks.plans.tables import table

RUN = 48


def p4_found(spark, d):
    runs = consecutive_runs(table(spark, d, "tidset_entries").select("item", "tid"), "item", "tid", RUN)
    return runs.select("item", F.col("lo").alias("first_tid"))


def p4_item_profile(spark, d):
    return position_profile(table(spark, d, "tidset_entries").select("item", "tid"), "item", "tid")


def p4_item_totals(spark, d):
    e = table(spark, d, "tidset_entries").select("item", "file_id", "tid", "pos").where("item is not null and tid is not null")
    return salted_aggregate(
        e, ["item"],
        {"n": F.count(F.lit(1)), "hi": F.max("pos"), "lo": F.min("tid"), "s": F.sum(F.col("pos").cast("bigint"))},
        {"n_rows": F.sum("n"), "max_pos": F.max("hi"), "first_tid": F.min("lo"), "sum_pos": F.sum("s")},
        salt_on=["tid"],
    )


QUERIES = {"p4_found": p4_found, "p4_item_profile": p4_item_profile, "p4_item_totals": p4_item_totals}

_ISLANDS = """with t as (select distinct item, tid from tidset_entries where item is not null and tid is not null),
 g as (select item, tid, tid - row_number() over (partition by item order by tid) as grp from t),
 r as (select item, min(tid) as lo, count(*) as len from g group by item, grp)"""

ORACLE = {
    "p4_found": f"{_ISLANDS} select item, lo as first_tid from r where len >= {RUN}",
    "p4_item_profile": f"""{_ISLANDS},
 n as (select item, count(*) as n_rows from tidset_entries where item is not null and tid is not null group by item),
 s as (select item, sum(len)::bigint as n_positions, min(lo) as first_pos, max(lo + len - 1) as last_pos, count(*) as n_runs from r group by item)
 select item, n_rows, n_positions, first_pos, last_pos, n_runs from s join n using (item)""",
    "p4_item_totals": """select item, count(*) as n_rows, max(pos) as max_pos, min(tid) as first_tid, sum(pos)::bigint as sum_pos
 from tidset_entries where item is not null and tid is not null group by item""",
}

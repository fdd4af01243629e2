"""Queries over the operators of multiset algebra, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagworks.functions.scalar import array_multiset_op, array_overlap, array_slice, finalize32, interleave, pack_pairs, slot, split_interleaved
from bagworks.functions.stats import summarize_runs
from bagworks.operators import batched, bykey, graph, joins, mining, scan, sets
from bagworks.plans.tables import table
from bagworks.session import materialize, scratch_path
from bagworks.sources.binary import read_u32, write_u32
from bagworks.sources.transactions import number_rows, read_meta, read_tidsets, read_transactions, write_results, write_tidsets

ORDINAL = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


# the filter, join and group-by query
def q12_shaped(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    j = line.select("l_orderkey", "l_returnflag", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderdate < l_shipdate")
    high = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)
    return j.groupBy("l_returnflag").agg(F.sum(high).cast("bigint").alias("high_line_count"), F.sum(1 - high).cast("bigint").alias("low_line_count"))


def q12_filter_count(spark, d):
    """Passing rows of the filter, counted in the scan."""
    ok = F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return table(spark, d, "lineitem").agg(F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("rows_in"))


def q12_compaction(spark, d):
    """The filter's passing rows and projected columns."""
    return table(spark, d, "lineitem").where("l_returnflag in ('A', 'R') and l_quantity >= 10 and l_quantity < 20").select("l_orderkey", "l_returnflag")


# keys-only sets: part keys of returned (A) and of accepted (B) lines
def _sides(spark, d, *cols: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, d, "lineitem")
    keep = ["l_partkey", *cols]
    return line.where("l_returnflag = 'R'").select(*keep), line.where("l_returnflag = 'A'").select(*keep)


def _set_query(op):
    return lambda spark, d: sets.multiset_op(*_sides(spark, d), op)


def _hot_query(op):
    """The same where 50 values hold all rows."""

    def query(spark, d):
        qty = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("qty"))
        return sets.multiset_op(qty.where("l_returnflag = 'R'").select("qty"), qty.where("l_returnflag = 'A'").select("qty"), op)

    return query


def _distinct_query(op):
    return lambda spark, d: sets.distinct_op(*_sides(spark, d), op)


def set_op_counts(spark, d):
    return sets.op_counts(*_sides(spark, d))


def _by_key_query(op):
    return lambda spark, d: bykey.by_key(*_sides(spark, d, *ORDINAL), ["l_partkey"], ORDINAL, op)


def hash_intersect_by_key(spark, d):
    a, b = _sides(spark, d, *ORDINAL)
    a = a.select("l_partkey", *ORDINAL)
    return bykey.first_match_join(a.select("l_partkey", *ORDINAL), b.select("l_partkey", F.col("l_orderkey").alias("b_orderkey"), F.col("l_linenumber").alias("b_linenumber")), ["l_partkey"], ORDINAL)


# joins
def equi_join(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_partkey", "l_linenumber")
    return joins.equi_join(line, table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_custkey", "o_orderpriority"), ["orderkey"])


def equi_join_part(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey"), "l_orderkey", "l_quantity")
    return joins.equi_join(line, table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_brand"), ["partkey"]).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"))


def semi_join(spark, d):
    return joins.semi_join(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), ["k"])


def anti_join(spark, d):
    return joins.anti_join(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


def chain_join(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_quantity")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment", "c_nationkey")
    j = joins.chain_join(line, (orders, ["orderkey"]), (customer, ["custkey"]))
    return j.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"))


# many sets: distinct parts by nation of the supplier
def _nation_parts(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    line = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("set_id"), F.col("l_partkey").alias("k"))


def jaccard_pairs(spark, d):
    rows = _nation_parts(spark, d)
    c = batched.batched_counts(batched.all_pairs(rows), rows, distinct=True)
    return c.select("a_id", "b_id", "intersection", "union", F.round("jaccard", 9).alias("jaccard"))


def batched_multiset_counts(spark, d):
    rows = _nation_parts(spark, d)
    return batched.batched_counts(batched.all_pairs(rows), rows).select("a_id", "b_id", "size_a", "size_b", "intersection", "union", "difference", "sym_difference")


def batched_intersect_output(spark, d):
    """All pairs, with their copies."""
    return _intersect_arrays(spark, d, False)


def batched_intersect_arrays(spark, d):
    return _intersect_arrays(spark, d, True)


def _intersect_arrays(spark, d, distinct: bool) -> DataFrame:
    rows = _nation_parts(spark, d)
    pairs = batched.all_pairs(rows)
    out = batched.batched_intersections(pairs, rows, distinct=distinct, arrays=True).join(pairs, "pair_id")
    return out.select("a_id", "b_id", "n", F.array_join("keys", ",").alias("keys"))


def batched_intersect_long(spark, d):
    rows = _nation_parts(spark, d)
    pairs = batched.all_pairs(rows)
    return batched.batched_intersections(pairs, rows).join(pairs, "pair_id").select("a_id", "b_id", "k", "n")


# mining
def _baskets(spark, d, dense: bool) -> DataFrame:
    if dense:
        e = table(spark, d, "events").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("tid"), F.col("event_type").alias("item"))
        return e.distinct()
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tid"), F.col("l_suppkey").alias("item")).distinct()


def _itemsets(df: DataFrame) -> DataFrame:
    return df.select(F.array_join(F.col("itemset").cast("array<string>"), ",").alias("itemset"), "size", "support")


def eclat_dense(spark, d):
    return _itemsets(mining.eclat(_baskets(spark, d, True), 30))


def eclat_sparse(spark, d):
    return _itemsets(mining.eclat(_baskets(spark, d, False), 4))


def vertical_format(spark, d):
    return mining.tidsets(_baskets(spark, d, True)).select("item", "support", F.md5(F.array_join("tids", ",")).alias("tids_md5"))


def mined_supports(spark, d):
    """Supports of the sets of one and two items beside what `frequent_itemsets` recorded last for them."""
    t = table(spark, d, "transactions").where("db_id is not null and tid is not null")
    o = materialize(t.select("db_id", "tid", F.explode("items").alias("item")).where("item is not null").distinct())
    one = o.groupBy("db_id", "item").agg(F.count(F.lit(1)).alias("support"))
    r = table(spark, d, "frequent_itemsets").where("db_id is not null").select("db_id", F.array_sort(F.array_distinct(F.array_compact("itemset"))).alias("s"), F.struct("mined_at", "support").alias("x"))
    r = r.where("size(s) in (1, 2)").groupBy("db_id", F.col("s")[0].alias("item_a"), F.col("s")[F.size("s") - 1].alias("item_b")).agg(F.max("x").alias("x"))
    r = materialize(r.select("db_id", "item_a", "item_b", F.col("x.support").alias("recorded")))
    # a pair is looked up by its rarer item's transactions
    two = r.where("item_a <> item_b").select("db_id", "item_a", "item_b")
    side = lambda c, n: one.select("db_id", F.col("item").alias(c), F.col("support").alias(n))
    two = two.join(side("item_a", "na"), ["db_id", "item_a"]).join(side("item_b", "nb"), ["db_id", "item_b"])
    low = F.col("na") <= F.col("nb")
    two = two.select("db_id", "item_a", "item_b", F.when(low, F.col("item_a")).otherwise(F.col("item_b")).alias("item"), F.when(low, F.col("item_b")).otherwise(F.col("item_a")).alias("other"))
    both = two.join(o, ["db_id", "item"]).drop("item").join(o.withColumnRenamed("item", "other"), ["db_id", "tid", "other"])
    s = both.groupBy("db_id", "item_a", "item_b").agg(F.count(F.lit(1)).alias("support")).unionByName(one.select("db_id", F.col("item").alias("item_a"), F.col("item").alias("item_b"), "support"))
    return r.join(s, ["db_id", "item_a", "item_b"], "left").select("db_id", "item_a", "item_b", "recorded", F.coalesce("support", F.lit(0)).cast("bigint").alias("support"))


def _graph(spark, d) -> DataFrame:
    p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    q = p.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return p.select("l_orderkey", F.col("l_partkey").alias("src")).join(q, "l_orderkey").where("src < dst").select("src", "dst")


def triangle_count(spark, d):
    return graph.triangle_count(_graph(spark, d))


# ordered primitives
def exclusive_scan(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("qty"))
    return scan.exclusive_scan(line, "qty", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "prefix").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "prefix")


def local_rank(spark, d):
    line = table(spark, d, "lineitem").select("l_partkey", *ORDINAL)
    return bykey.ranked(line, ["l_partkey"], ORDINAL, "r")


def run_lengths(spark, d):
    return scan.run_length(table(spark, d, "lineitem").select("l_partkey"), ["l_partkey"])


def rank_flags(spark, d):
    """Every row of A with the flags of intersection and difference, before any compaction."""
    a, b = _sides(spark, d, *ORDINAL)
    n = scan.run_length(b.select("l_partkey"), ["l_partkey"])
    r = bykey.ranked(a, ["l_partkey"], ORDINAL, "r").join(n, "l_partkey", "left")
    hit = (F.col("r") < F.coalesce("n", F.lit(0))).cast("int")
    return r.select("l_partkey", "r", hit.alias("in_intersection"), (1 - hit).alias("in_difference"))


def sorted_merge(spark, d):
    """All rows of both sides by key, with the place that each has in the result's partitions."""
    a, b = _sides(spark, d, *ORDINAL)
    return number_rows(scan.sorted_merge(a, b, ["l_partkey", *ORDINAL]), "place").select("l_partkey", "l_orderkey", "side", "place")


def sorted_merge_by_key_value(spark, d):
    a, b = _sides(spark, d, "l_orderkey")
    return number_rows(scan.sorted_merge(a, b, ["l_partkey", "l_orderkey"]), "place")


def sort_pairs(spark, d):
    """Lexicographic sort of (key, payload), with the place that each row has in the result's partitions."""
    return number_rows(table(spark, d, "lineitem").select("l_partkey", "l_orderkey").orderBy("l_partkey", "l_orderkey"), "place")


def sort_by_payload(spark, d):
    """Pairs by their payload alone, keys and payloads changing places; `place` is that of the first row with the same payload."""
    rows = number_rows(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("y"), F.col("l_partkey").alias("x")).orderBy("y"), "place")
    first = rows.groupBy("y").agg(F.min("place").alias("place"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
    return rows.drop("place").join(first, "y").select("y", "x", "place", (F.col("last") - F.col("place") + 1 == F.col("n")).alias("together"))


def sort_first_half(spark, d):
    """The orders as an array by their key; its first half is sorted by price, the rest stays."""
    o = scan.place(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    o = materialize(o)
    return scan.sort_first(o, "place", ["o_totalprice", "o_orderkey"], o.count() // 2)


def segment_gather(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_custkey")
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("seg"), (F.col("c_custkey") * 7).alias("off"), (F.col("c_custkey") % 13).alias("len"))
    return scan.segment_gather(orders, seg)


# functions
def hash_slots(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    return p.select("p_partkey", finalize32(F.col("p_partkey")).alias("h"), slot(F.col("p_partkey"), 1000).alias("slot"), F.bit_count("p_partkey").alias("bits"))


def array_ops(spark, d):
    p = table(spark, d, "set_pairs").select("pair_id", "loaded_at", "a", "b")
    out = {op: F.array_join(array_multiset_op(F.col("a"), F.col("b"), op), ",").alias(op) for op in OPS}
    part = F.array_join(array_slice(F.col("a"), 1, 3), ",", "-").alias("part")
    return p.select("pair_id", "loaded_at", *out.values(), array_overlap(F.col("a"), F.col("b")).cast("bigint").alias("overlap"), part)


def pair_layouts(spark, d):
    p = table(spark, d, "benchmark_timings").select("bench_id", "loaded_at", "kernel", "lookback").where("kernel is not null and size(kernel) = size(lookback)")
    again = split_interleaved(interleave(F.col("kernel"), F.col("lookback")), 1)
    return p.select("bench_id", "loaded_at", F.size(pack_pairs(F.col("kernel"), F.col("lookback"))).cast("bigint").alias("n"), F.size(again).cast("bigint").alias("again"), F.nanvl(F.get(again, F.lit(0))["k"], F.lit(None).cast("double")).alias("first_lookback"))


def run_stats(spark, d):
    r = table(spark, d, "run_records").where("run_id is not null").groupBy("run_id").agg(F.max(F.struct("loaded_at", "config_id", "kernel_ms")).alias("x")).select("x.config_id", "x.kernel_ms")
    s = summarize_runs(r.where("kernel_ms is not null and not isnan(kernel_ms)"), ["config_id"], "kernel_ms")
    return s.select("config_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "least", "most", "median", "p95", "cv", "sem")])


# sources: round trips through files in the shared folder
def bin_roundtrip(spark, d):
    path = scratch_path(spark)
    write_u32(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), path)
    return read_u32(spark, path).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def bin_headerless(spark, d):
    path = scratch_path(spark)
    write_u32(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), path, header=False)
    return read_u32(spark, path, header=False).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def set_from_fimi_text(spark, d):
    """Transactions written as lines in an order, and read again with their line's number."""
    path = scratch_path(spark)
    line = F.array_join(F.filter("items", lambda x: x.isNotNull()), " ").alias("value")
    t = table(spark, d, "transactions").select("db_id", "tid", "loaded_at", line).where("value is not null").orderBy("db_id", "tid", "loaded_at", "value")
    t.select("value").write.text(path)
    return read_transactions(spark, path).select("tid", F.array_join("items", " ").alias("items"))


def csr_roundtrip(spark, d):
    path = scratch_path(spark)
    write_tidsets(_baskets(spark, d, False), path)
    return read_tidsets(spark, path)


def csr_meta(spark, d):
    """The metadata document of the same files."""
    path = scratch_path(spark)
    write_tidsets(_baskets(spark, d, False), path)
    return read_meta(spark, f"{path}/meta.json").select(F.col("numTransactions").alias("n_transactions"), F.col("numItems").alias("n_items"), F.col("totalTidsetElements").alias("n_elements"))


def result_lines(spark, d):
    """A result written as JSON lines and read again."""
    path = scratch_path(spark)
    write_results(q12_shaped(spark, d), path)
    return spark.read.schema("l_returnflag string, high_line_count bigint, low_line_count bigint").json(path)


OPS = sets.OPS
QUERIES = {
    "q12_shaped": q12_shaped, "q12_filter_count": q12_filter_count, "q12_compaction": q12_compaction,
    **{f"set_{op}": _set_query(op) for op in OPS}, **{f"distinct_{op}": _distinct_query(op) for op in OPS}, **{f"hot_set_{op}": _hot_query(op) for op in OPS},
    "set_op_counts": set_op_counts, **{f"{op}_by_key": _by_key_query(op) for op in OPS}, "hash_intersect_by_key": hash_intersect_by_key,
    "equi_join": equi_join, "equi_join_part": equi_join_part, "semi_join": semi_join, "anti_join": anti_join, "chain_join": chain_join,
    "jaccard_pairs": jaccard_pairs, "batched_multiset_counts": batched_multiset_counts, "batched_intersect_output": batched_intersect_output,
    "batched_intersect_arrays": batched_intersect_arrays, "batched_intersect_long": batched_intersect_long, "eclat_dense": eclat_dense, "eclat_sparse": eclat_sparse, "vertical_format": vertical_format,
    "mined_supports": mined_supports, "triangle_count": triangle_count, "exclusive_scan": exclusive_scan, "local_rank": local_rank,
    "run_lengths": run_lengths, "rank_flags": rank_flags, "sorted_merge": sorted_merge, "sorted_merge_by_key_value": sorted_merge_by_key_value,
    "sort_pairs": sort_pairs, "sort_by_payload": sort_by_payload, "sort_first_half": sort_first_half, "segment_gather": segment_gather, "hash_slots": hash_slots, "array_ops": array_ops, "pair_layouts": pair_layouts,
    "run_stats": run_stats, "bin_roundtrip": bin_roundtrip, "bin_headerless": bin_headerless, "set_from_fimi_text": set_from_fimi_text,
    "csr_roundtrip": csr_roundtrip, "csr_meta": csr_meta, "result_lines": result_lines,
}

_A, _B = ("(select l_partkey from lineitem where l_returnflag = 'R')", "(select l_partkey from lineitem where l_returnflag = 'A')")
_HA, _HB = ("(select l_quantity::bigint as qty from lineitem where l_returnflag = 'R')", "(select l_quantity::bigint as qty from lineitem where l_returnflag = 'A')")
_COUNTS = """with c as (select l_partkey, count(*) filter (l_returnflag = 'R') as m, count(*) filter (l_returnflag = 'A') as n
 from lineitem where l_returnflag in ('R', 'A') group by l_partkey)"""
_COPIES = {"intersection": "least(m, n)", "difference": "greatest(m - n, 0)", "union": "greatest(m, n)", "sym_difference": "abs(m - n)"}
_MEMBERS = {"intersection": "m > 0 and n > 0", "difference": "m > 0 and n = 0", "union": "true", "sym_difference": "(m > 0) <> (n > 0)"}
_O = ", ".join(ORDINAL)
_RANKED = f"""with a as (select l_partkey, {_O}, row_number() over (partition by l_partkey order by {_O}) - 1 as r from lineitem where l_returnflag = 'R'),
 b as (select l_partkey, {_O}, row_number() over (partition by l_partkey order by {_O}) - 1 as r from lineitem where l_returnflag = 'A'),
 only_a as (select l_partkey, {_O} from a where not exists (select 1 from b where b.l_partkey = a.l_partkey and b.r = a.r)),
 only_b as (select l_partkey, {_O} from b where not exists (select 1 from a where a.l_partkey = b.l_partkey and a.r = b.r))"""
_NATIONS = """with e as (select s_nationkey as set_id, l_partkey as k, count(*) as m from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2),
 p as (select a.set_id as a_id, b.set_id as b_id from (select distinct set_id from e) a join (select distinct set_id from e) b on a.set_id < b.set_id)"""
_EVENTS = "(select distinct user_id || '/' || ts::date as tid, event_type as item from events)"
_DENSE = f"""with t as materialized {_EVENTS},
 l1 as (select item as i1, tid from t),
 l2 as (select a.i1, b.item as i2, a.tid from l1 a join t b on a.tid = b.tid and a.i1 < b.item),
 l3 as (select a.i1, a.i2, b.item as i3, a.tid from l2 a join t b on a.tid = b.tid and a.i2 < b.item),
 l4 as (select a.i1, a.i2, a.i3, b.item as i4, a.tid from l3 a join t b on a.tid = b.tid and a.i3 < b.item),
 l5 as (select a.i1, a.i2, a.i3, a.i4, b.item as i5, a.tid from l4 a join t b on a.tid = b.tid and a.i4 < b.item)
 select * from (select i1 as itemset, 1 as size, count(*) as support from l1 group by i1
 union all select i1 || ',' || i2, 2, count(*) from l2 group by i1, i2
 union all select i1 || ',' || i2 || ',' || i3, 3, count(*) from l3 group by i1, i2, i3
 union all select i1 || ',' || i2 || ',' || i3 || ',' || i4, 4, count(*) from l4 group by i1, i2, i3, i4
 union all select i1 || ',' || i2 || ',' || i3 || ',' || i4 || ',' || i5, 5, count(*) from l5 group by i1, i2, i3, i4, i5) where support >= 30"""


def _sparse_sql(levels: int) -> str:
    """Frequent itemsets level by level, with one more level than any of the test tables has."""
    ctes = ["t as materialized (select distinct l_orderkey as tid, l_suppkey as item from lineitem)", "f1 as (select item as i1 from t group by item having count(*) >= 4)",
        "u as (select t.* from t join f1 on item = i1)", "s1 as (select item as i1, tid from u)"]
    out = ["select item::varchar as itemset, 1 as size, count(*) as support from t group by item having count(*) >= 4"]
    for n in range(2, levels + 1):
        old, new = ", ".join(f"i{i}" for i in range(1, n)), ", ".join(f"i{i}" for i in range(1, n + 1))
        ctes.append(f"s{n} as materialized (select {old}, c.item as i{n}, c.tid from s{n - 1} join f{n - 1} using ({old}) join u c on c.tid = s{n - 1}.tid and c.item > i{n - 1})")
        ctes.append(f"f{n} as (select {new} from s{n} group by {new} having count(*) >= 4)")
        out.append(f"select concat_ws(',', {new}), {n}, count(*) from s{n} group by {new} having count(*) >= 4")
    return f"with {', '.join(ctes)} {' union all '.join(out)}"


_SPARSE = _sparse_sql(9)
_GRAPH = """with p as (select distinct l_orderkey, l_partkey from lineitem),
 e as materialized (select distinct a.l_partkey as src, b.l_partkey as dst from p a join p b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)"""

ORACLE = {
    "q12_shaped": """select l_returnflag, count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) as high_line_count,
 count(*) filter (o_orderpriority not in ('1-URGENT', '2-HIGH')) as low_line_count from lineitem join orders on l_orderkey = o_orderkey
 where l_returnflag in ('A', 'R') and o_orderdate < l_shipdate and l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' group by l_returnflag""",
    "q12_filter_count": """select count(*) filter (l_returnflag in ('A', 'R') and l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01') as passed,
 count(*) as rows_in from lineitem""",
    "q12_compaction": "select l_orderkey, l_returnflag from lineitem where l_returnflag in ('A', 'R') and l_quantity >= 10 and l_quantity < 20",
    "set_intersection": f"{_A} intersect all {_B}",
    "set_difference": f"{_A} except all {_B}",
    "set_union": f"{_A} union all ({_B} except all {_A})",
    "set_sym_difference": f"({_A} except all {_B}) union all ({_B} except all {_A})",
    "hot_set_intersection": f"{_HA} intersect all {_HB}",
    "hot_set_difference": f"{_HA} except all {_HB}",
    "hot_set_union": f"{_HA} union all ({_HB} except all {_HA})",
    "hot_set_sym_difference": f"({_HA} except all {_HB}) union all ({_HB} except all {_HA})",
    **{f"distinct_{op}": f"{_COUNTS} select l_partkey from c where {c}" for op, c in _MEMBERS.items()},
    "set_op_counts": f"{_COUNTS} select sum(m)::bigint as size_a, sum(n)::bigint as size_b, " + ", ".join(f"sum({e})::bigint as {op}" for op, e in _COPIES.items()) + " from c",
    "intersection_by_key": f"{_RANKED} select a.l_partkey, {', '.join('a.' + o for o in ORDINAL)} from a join b on a.l_partkey = b.l_partkey and a.r = b.r",
    "difference_by_key": f"{_RANKED} select * from only_a",
    "union_by_key": f"{_RANKED} select l_partkey, {_O} from a union all select * from only_b",
    "sym_difference_by_key": f"{_RANKED} select * from only_a union all select * from only_b",
    "hash_intersect_by_key": f"""with a as (select *, row_number() over (partition by l_partkey order by {_O}) as r from lineitem where l_returnflag = 'R')
 select a.l_partkey, {', '.join(f'a.{o} as a_{o}' for o in ORDINAL)}, b.l_orderkey as b_orderkey, b.l_linenumber as b_linenumber
 from lineitem b join a on a.l_partkey = b.l_partkey and a.r = 1 where b.l_returnflag = 'A'""",
    "equi_join": "select l_orderkey as orderkey, l_partkey, l_linenumber, o_custkey, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey",
    "equi_join_part": "select p_brand, count(*) as n_lines, sum(l_quantity::bigint)::bigint as sum_qty from lineitem join part on l_partkey = p_partkey group by p_brand",
    "semi_join": "select o_orderkey as k, o_custkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')",
    "anti_join": "select o_orderkey as k, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "chain_join": """select c_mktsegment, c_nationkey, count(*) as n_lines, sum(l_quantity::bigint)::bigint as sum_qty from lineitem
 join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by c_mktsegment, c_nationkey""",
    "jaccard_pairs": f"""{_NATIONS}, z as (select set_id, count(*) as n from e group by set_id),
 i as (select a.set_id as a_id, b.set_id as b_id, count(*) as c from e a join e b on a.k = b.k and a.set_id < b.set_id group by 1, 2)
 select p.a_id, p.b_id, coalesce(c, 0)::bigint as intersection, (x.n + y.n - coalesce(c, 0))::bigint as "union",
 round(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0)), 9) as jaccard from p join z x on x.set_id = p.a_id join z y on y.set_id = p.b_id
 left join i on i.a_id = p.a_id and i.b_id = p.b_id""",
    "batched_multiset_counts": f"""{_NATIONS}, z as (select set_id, sum(m)::bigint as n from e group by set_id),
 i as (select a.set_id as a_id, b.set_id as b_id, sum(least(a.m, b.m))::bigint as c from e a join e b on a.k = b.k and a.set_id < b.set_id group by 1, 2),
 w as (select p.a_id, p.b_id, x.n as size_a, y.n as size_b, coalesce(c, 0)::bigint as c from p join z x on x.set_id = p.a_id join z y on y.set_id = p.b_id
  left join i on i.a_id = p.a_id and i.b_id = p.b_id)
 select a_id, b_id, size_a, size_b, c as intersection, size_a + size_b - c as "union", size_a - c as difference, size_a + size_b - 2 * c as sym_difference from w""",
    "batched_intersect_output": f"""{_NATIONS}, i as (select a.set_id as a_id, b.set_id as b_id, sum(least(a.m, b.m))::bigint as n,
  rtrim(string_agg(repeat(a.k::varchar || ',', least(a.m, b.m)::int), '' order by a.k), ',') as keys from e a join e b on a.k = b.k and a.set_id < b.set_id group by 1, 2)
 select p.a_id, p.b_id, coalesce(n, 0)::bigint as n, coalesce(keys, '') as keys from p left join i on i.a_id = p.a_id and i.b_id = p.b_id""",
    "batched_intersect_arrays": f"""{_NATIONS}, i as (select a.set_id as a_id, b.set_id as b_id, count(*) as n, string_agg(a.k::varchar, ',' order by a.k) as keys
  from e a join e b on a.k = b.k and a.set_id < b.set_id group by 1, 2)
 select p.a_id, p.b_id, coalesce(n, 0)::bigint as n, coalesce(keys, '') as keys from p left join i on i.a_id = p.a_id and i.b_id = p.b_id""",
    "batched_intersect_long": f"{_NATIONS} select a.set_id as a_id, b.set_id as b_id, a.k, least(a.m, b.m) as n from e a join e b on a.k = b.k and a.set_id < b.set_id",
    "eclat_dense": _DENSE,
    "eclat_sparse": _SPARSE,
    "vertical_format": f"select item, count(*) as support, md5(string_agg(tid, ',' order by tid)) as tids_md5 from {_EVENTS} group by item",
    "mined_supports": """with o as (select distinct db_id, tid, item from (select db_id, tid, unnest(items) as item from transactions) where item is not null and db_id is not null and tid is not null),
 f as (select db_id, list_sort(list_distinct(list_filter(itemset, lambda x: x is not null))) as s, support, mined_at from frequent_itemsets where db_id is not null),
 g as (select db_id, s[1] as item_a, s[len(s)] as item_b, support, row_number() over (partition by db_id, s order by mined_at desc, support desc nulls last) as r from f where len(s) in (1, 2)),
 c as (select g.db_id, item_a, item_b, count(*) as n from g join o x on x.db_id = g.db_id and x.item = item_a join o y on y.db_id = g.db_id and y.item = item_b and y.tid = x.tid where r = 1 group by 1, 2, 3)
 select g.db_id, g.item_a, g.item_b, g.support as recorded, coalesce(c.n, 0)::bigint as support from g left join c using (db_id, item_a, item_b) where r = 1""",
    "triangle_count": f"{_GRAPH} select count(*) as triangles from e a join e b on a.dst = b.src join e c on c.src = a.src and c.dst = b.dst",
    "exclusive_scan": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, coalesce(sum(l_quantity::bigint) over
 (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0)::bigint as prefix from lineitem""",
    "local_rank": f"select l_partkey, {_O}, row_number() over (partition by l_partkey order by {_O}) - 1 as r from lineitem",
    "run_lengths": "select l_partkey, count(*) as n from lineitem group by l_partkey",
    "rank_flags": """with a as (select l_partkey, row_number() over (partition by l_partkey order by l_orderkey) - 1 as r from lineitem where l_returnflag = 'R'),
 b as (select l_partkey, count(*) as n from lineitem where l_returnflag = 'A' group by l_partkey)
 select l_partkey, r, (r < coalesce(n, 0))::int as in_intersection, (r >= coalesce(n, 0))::int as in_difference from a left join b using (l_partkey)""",
    "sorted_merge": f"""select l_partkey, l_orderkey, (l_returnflag = 'A')::int as side, row_number() over (order by l_partkey, {_O}, l_returnflag = 'A') - 1 as place
 from lineitem where l_returnflag in ('R', 'A')""",
    "sorted_merge_by_key_value": """select l_partkey, l_orderkey, (l_returnflag = 'A')::int as side, row_number() over (order by l_partkey, l_orderkey, l_returnflag = 'A') - 1 as place
 from lineitem where l_returnflag in ('R', 'A')""",
    "sort_pairs": "select l_partkey, l_orderkey, row_number() over (order by l_partkey, l_orderkey) - 1 as place from lineitem",
    "sort_by_payload": "select l_orderkey as y, l_partkey as x, rank() over (order by l_orderkey) - 1 as place, true as together from lineitem",
    "sort_first_half": """with o as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as place from orders)
 select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 as place from o where place < (select count(*) // 2 from o)
 union all select o_orderkey, o_totalprice, place from o where place >= (select count(*) // 2 from o)""",
    "segment_gather": """select c_custkey as seg, o_orderkey - c_custkey * 7 as i, o_custkey from customer join orders
 on o_orderkey >= c_custkey * 7 and o_orderkey < c_custkey * 7 + c_custkey % 13""",
    "hash_slots": """with a as (select p_partkey, xor(p_partkey, p_partkey >> 16) as h from part),
 b as (select p_partkey, (h::hugeint * 2246822507 % 4294967296)::bigint as h from a), c as (select p_partkey, xor(h, h >> 13) as h from b),
 e as (select p_partkey, (h::hugeint * 3266489909 % 4294967296)::bigint as h from c), f as (select p_partkey, xor(h, h >> 16) as h from e)
 select p_partkey, h, h & 2047 as slot, bit_count(p_partkey)::int as bits from f""",
    "array_ops": """with x as (select pair_id, loaded_at, v, sum(m)::bigint as m, sum(n)::bigint as n from (
   select pair_id, loaded_at, unnest(a) as v, 1 as m, 0 as n from set_pairs where a is not null and b is not null
   union all select pair_id, loaded_at, unnest(b), 0, 1 from set_pairs where a is not null and b is not null) where v is not null group by all),
 y as (select pair_id, loaded_at, coalesce(string_agg(repeat(v::varchar || ',', least(m, n)::int), '' order by v), '') as i,
   coalesce(string_agg(repeat(v::varchar || ',', greatest(m - n, 0)::int), '' order by v), '') as d, coalesce(string_agg(repeat(v::varchar || ',', greatest(m, n)::int), '' order by v), '') as u,
   coalesce(string_agg(repeat(v::varchar || ',', abs(m - n)::int), '' order by v), '') as e, count(*) filter (m > 0 and n > 0) as o from x group by all)
 select s.pair_id, s.loaded_at, case when a is not null and b is not null then rtrim(coalesce(i, ''), ',') end as intersection,
 case when a is not null and b is not null then rtrim(coalesce(d, ''), ',') end as difference, case when a is not null and b is not null then rtrim(coalesce(u, ''), ',') end as "union",
 case when a is not null and b is not null then rtrim(coalesce(e, ''), ',') end as sym_difference, case when a is not null and b is not null then coalesce(o, 0)::bigint end as overlap,
 case when a is not null then coalesce(array_to_string(list_transform(a[2:4], lambda x: coalesce(x::varchar, '-')), ','), '') end as part
 from set_pairs s left join y on s.pair_id = y.pair_id and s.loaded_at = y.loaded_at""",
    "pair_layouts": """select bench_id, loaded_at, len(kernel)::bigint as n, len(kernel)::bigint as again, case when isnan(lookback[1]) then null else lookback[1] end as first_lookback from benchmark_timings
 where kernel is not null and len(kernel) = len(lookback)""",
    "run_stats": """with r as (select config_id, kernel_ms as v from (select *, row_number() over (partition by run_id order by loaded_at desc) as r from run_records where run_id is not null)
  where r = 1 and kernel_ms is not null and not isnan(kernel_ms))
 select config_id, count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(min(v), 6) as least, round(max(v), 6) as most,
 round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.95), 6) as p95, round(stddev_samp(v) / nullif(avg(v), 0), 6) as cv,
 round(stddev_samp(v) / sqrt(count(*)), 6) as sem from r group by config_id""",
    "bin_roundtrip": "select l_partkey as k, count(*) as n from lineitem group by l_partkey",
    "bin_headerless": "select l_orderkey as k, count(*) as n from lineitem group by l_orderkey",
    "set_from_fimi_text": """with t as (select db_id, tid, loaded_at, array_to_string(list_filter(items, lambda x: x is not null), ' ') as items from transactions)
 select row_number() over (order by db_id nulls first, tid nulls first, loaded_at nulls first, items) - 1 as tid, items from t where items <> ''""",
    "csr_roundtrip": "select distinct l_suppkey as item, l_orderkey as tid from lineitem",
    "csr_meta": """select count(distinct l_orderkey) as n_transactions, count(distinct l_suppkey) as n_items, count(distinct (l_suppkey, l_orderkey)) as n_elements from lineitem""",
}
ORACLE["result_lines"] = ORACLE["q12_shaped"]

"""Queries of the training-data operators, by problem, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagworks.llm.frequencies import term_frequencies
from bagworks.llm.leaders import leading_terms
from bagworks.llm.mixing import mix_sources, shares_report
from bagworks.llm.occurrences import basket_occurrences, baskets, long_occurrences
from bagworks.llm.overlap import descent_report, set_overlaps
from bagworks.llm.packing import Capacity, pack_documents
from bagworks.llm.pairs import pair_counts
from bagworks.llm.quantiles import exact_quantiles, quantiles_of, summarize
from bagworks.llm.similar import classes, pivot_cells, similar_classes, similar_pairs
from bagworks.llm.subjects import assign_subjects
from bagworks.llm.tokens import count_tokens
from bagworks.plans.tables import table
from bagworks.session import checked_broadcast, materialize


def _baskets(spark, d) -> DataFrame:
    """The transactions, each once; written for operators that read them more than once."""
    return materialize(baskets(table(spark, d, "transactions"), "db_id", "tid", "items"))


def _sources(spark, d, written: bool = True) -> dict[str, DataFrame]:
    """Without `written` the transactions keep the partitioning by record in which their copies met."""
    base = _baskets(spark, d) if written else baskets(table(spark, d, "transactions"), "db_id", "tid", "items")
    return {
        "transactions": basket_occurrences(base),
        "tidset_entries": long_occurrences(table(spark, d, "tidset_entries"), "file_id", "tid", "item", "pos"),
    }


# Problem 1
def p1_found(spark, d):
    base = _baskets(spark, d)
    return pair_counts(base, 15, 4.0).select(F.col("owner").alias("db_id"), "item_a", "item_b")


def p1_pairs(spark, d):
    """Pairs in at least 15 transactions, with their lift in thousandths (floor of 1000 c_ab n / (c_a c_b))."""
    base = _baskets(spark, d)
    lift = F.expr("(1000 * c_ab * n) div (c_a * c_b)").alias("lift_milli")
    return pair_counts(base, 15).select(F.col("owner").alias("db_id"), "item_a", "item_b", "c_ab", "c_a", "c_b", "n", lift)


def p1_counts(spark, d):
    """Every two items that stand together in a transaction, however rarely, with their lift in thousandths."""
    base = _baskets(spark, d)
    lift = F.expr("(1000 * c_ab * n) div (c_a * c_b)").alias("lift_milli")
    return pair_counts(base, 1).select(F.col("owner").alias("db_id"), "item_a", "item_b", "c_ab", "c_a", "c_b", "n", lift)


# Problem 2
def _frequencies(spark, d) -> DataFrame:
    both = [term_frequencies(occ).select(F.lit(src).alias("src"), "*") for src, occ in _sources(spark, d, written=False).items()]
    t = materialize(both[0].unionByName(both[1]))
    n = t.where("term is null").select("src", "owner", F.col("records").alias("n"))
    return t.where("term is not null").join(checked_broadcast(n), ["src", "owner"])


def p2_found(spark, d):
    marks = F.array_compact(F.array(F.when(F.expr("records <= 2"), "rare"), F.when(F.expr("2 * records >= n"), "common")))
    return _frequencies(spark, d).select("src", F.col("owner").alias("owner_id"), F.col("term").alias("item"), F.explode(marks).alias("mark"))


def p2_frequencies(spark, d):
    return _frequencies(spark, d).select("src", F.col("owner").alias("owner_id"), F.col("term").alias("item"), "occurrences", F.col("records").alias("support"), F.col("n").alias("owner_records"))


# Problem 3
def p3_found(spark, d):
    return set_overlaps(table(spark, d, "kmer_sets"), "set_id", "k", min_share=0.3).select("set_a", "set_b")


def p3_overlaps(spark, d):
    return set_overlaps(table(spark, d, "kmer_sets"), "set_id", "k")


def p3_descent(spark, d):
    return descent_report(table(spark, d, "kmer_sets"), "set_id", "k")


# Problem 5
_PROBS = [0.5, 0.9, 0.95, 0.99]


def _timings(spark, d) -> DataFrame:
    """(config_id, metric, day, ms): every value of each bench_id or run_id once, on the day of its first delivery."""
    b = table(spark, d, "benchmark_timings").where("bench_id is not null and config_id is not null")
    b = b.groupBy("bench_id").agg(F.min("loaded_at").alias("at"), F.max(F.struct("loaded_at", "config_id", "unit", "kernel", "lookback")).alias("x"))
    scale = F.when(F.col("x.unit") == "us", 1000.0).when(F.col("x.unit") == "ms", 1.0)
    b = b.select("at", F.col("x.config_id").alias("config_id"), scale.alias("scale"), F.explode(F.array(F.struct(F.lit("kernel").alias("metric"), F.col("x.kernel").alias("v")), F.struct(F.lit("lookback").alias("metric"), F.col("x.lookback").alias("v")))).alias("m"))
    b = b.select("config_id", F.col("m.metric").alias("metric"), F.to_date("at").alias("day"), "scale", F.explode("m.v").alias("v")).select("config_id", "metric", "day", (F.col("v") / F.col("scale")).alias("ms"))
    r = table(spark, d, "run_records").where("run_id is not null and config_id is not null")
    r = r.groupBy("run_id").agg(F.min("loaded_at").alias("at"), F.max(F.struct("loaded_at", "config_id", "e2e_ms")).alias("x"))
    r = r.select(F.col("x.config_id").alias("config_id"), F.lit("e2e_ms").alias("metric"), F.to_date("at").alias("day"), F.col("x.e2e_ms").alias("ms"))
    return materialize(b.unionByName(r).where("ms >= 0 and not isnan(ms)"))


_METRIC = ["config_id", "metric"]


def _quantile_columns(q: DataFrame, *more: str) -> DataFrame:
    return q.select(*_METRIC, F.col("n").alias("n_values"), *[F.col("quantiles")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(_PROBS)], *more)


def p5_found(spark, d):
    """By the summaries' bounds, and exact where these leave it open."""
    ms, probs = _timings(spark, d), [0.5, 0.95]
    q = quantiles_of(summarize(ms, _METRIC, "ms"), _METRIC, probs)
    return exact_quantiles(ms, _METRIC, "ms", q, probs).where("quantiles[1] >= 3 * quantiles[0]").select(*_METRIC)


def p5_quantiles(spark, d):
    ms = _timings(spark, d)
    return _quantile_columns(exact_quantiles(ms, _METRIC, "ms", quantiles_of(summarize(ms, _METRIC, "ms"), _METRIC, _PROBS), _PROBS))


def p5_days_added(spark, d):
    """The same from summaries that were made and kept day by day."""
    ms = _timings(spark, d)
    days = materialize(summarize(ms, [*_METRIC, "day"], "ms"))
    return _quantile_columns(exact_quantiles(ms, _METRIC, "ms", quantiles_of(days.drop("day"), _METRIC, _PROBS), _PROBS))


def p5_summaries(spark, d):
    """What the summaries alone say: percentiles and the rank error that collapsing can have made."""
    return _quantile_columns(quantiles_of(summarize(_timings(spark, d), _METRIC, "ms"), _METRIC, _PROBS), "rank_error")


def p5_rank_check(spark, d):
    """For each configuration, how many of its percentiles by summaries have a true rank beyond the error they name: none."""
    ms = _timings(spark, d)
    q = quantiles_of(summarize(ms, _METRIC, "ms"), _METRIC, _PROBS).select(*_METRIC, "n", "rank_error", F.posexplode("quantiles").alias("i", "q"))
    r = ms.join(checked_broadcast(materialize(q)), _METRIC).groupBy(*_METRIC, "i", "n", "rank_error").agg(F.count_if(F.col("ms") < F.col("q")).alias("less"), F.count_if(F.col("ms") <= F.col("q")).alias("upto"), F.count(F.lit(1)).alias("counted"))
    wanted = F.ceil(F.get(F.array(*[F.lit(p) for p in _PROBS]), F.col("i")) * F.col("n") - 1e-9)
    off = (F.col("less") - F.col("rank_error") >= wanted) | (F.col("upto") + F.col("rank_error") < wanted) | (F.col("counted") != F.col("n"))
    return r.groupBy(*_METRIC).agg(F.max("n").alias("n_values"), F.count_if(off).alias("beyond"))


# Problem 6
def _set_classes(spark, d) -> DataFrame:
    p = table(spark, d, "set_pairs").where("pair_id is not null")
    p = p.groupBy("pair_id").agg(F.max(F.struct("loaded_at", "a_id", "b_id", "a", "b")).alias("x"))
    sides = p.select(F.explode(F.array(F.struct(F.col("x.a_id").alias("id"), F.col("x.a").alias("v")), F.struct(F.col("x.b_id").alias("id"), F.col("x.b").alias("v")))).alias("s"))
    return materialize(classes(sides.select("s.id", "s.v"), "id", "v", 3))


def p6_found(spark, d):
    m = _set_classes(spark, d)
    return similar_pairs(m, similar_classes(m, 7, 10))


def p6_members(spark, d):
    """One row per record: its class (named by its least id), the class's size and its number of links to other classes."""
    m = _set_classes(spark, d)
    links = similar_classes(m, 7, 10)
    ends = links.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).unionAll(links.select("b1", "b2")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("links"))
    c = m.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")).join(ends, ["h1", "h2"], "left")
    return m.join(c, ["h1", "h2"]).select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def p6_cells(spark, d):
    """One row: how the pivots divide the records: cells of more than one record, the largest, records at home in them, and guests."""
    own, guests = pivot_cells(_set_classes(spark, d), 7, 10)
    per = own.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"), F.lit(0).alias("g"))
    per = per.unionByName(guests.groupBy("p1", "p2").agg(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("radius"), F.count(F.lit(1)).alias("g")))
    return per.agg(F.count_if(F.expr("n > 0")).alias("cells"), F.count_if(F.expr("n > 1")).alias("balls"), F.max("n").alias("largest"), F.sum("n").alias("members"), F.round(F.max("radius"), 4).alias("radius"), F.sum("g").alias("guests"))


# Problem 7
def p7_found(spark, d):
    return p7_leaders(spark, d).select("src", "owner_id", "item")


def p7_leaders(spark, d):
    parts = [leading_terms(occ, 0.01).select(F.lit(src).alias("src"), F.col("owner").alias("owner_id"), F.col("term").alias("item"), "occurrences", "owner_occurrences") for src, occ in _sources(spark, d).items()]
    return parts[0].unionByName(parts[1])


_OCC = """with o as (
 select 'transactions' as src, db_id as owner_id, tid, item, pos from (
  select db_id, tid, unnest(items) as item, generate_subscripts(items, 1) as pos from (
   select db_id, tid, items, row_number() over (partition by db_id, tid order by loaded_at) as r from transactions
   where db_id is not null and tid is not null and len(items) > 0) where r = 1) where item is not null
 union all
 select distinct 'tidset_entries', file_id, tid, item, pos from tidset_entries where file_id is not null and tid is not null and item is not null),
 c as (select src, owner_id, item, count(*) as occurrences, count(distinct tid) as support from o group by src, owner_id, item),
 n as (select src, owner_id, count(distinct tid) as n, count(*) as total from o group by src, owner_id)"""

# Problem 8
CAPACITY = Capacity(tokens=8192, items=64)


def p8_containers(spark, d):
    return pack_documents(count_tokens(table(spark, d, "documents")), CAPACITY)


def p8_fill(spark, d):
    """One row: containers, the fewest that the tokens could fill, and the filled share."""
    bins = p8_containers(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    full = F.ceil(F.sum("t") / CAPACITY.tokens).cast("bigint")
    return bins.agg(F.count(F.lit(1)).alias("containers"), full.alias("fewest"), F.sum("t").alias("tokens"), F.max("t").alias("most_tokens"), F.max("k").alias("most_items"), F.round(F.sum("t") / (F.count(F.lit(1)) * CAPACITY.tokens), 4).alias("fill"))


#: Fewer places, and a cost at which sixteen items of a sixteenth of the tokens, or one of a quarter and few others, are enough.
TIGHT = Capacity(tokens=8192, items=24, cost=8192.0**2 / 8)


def p8_tight(spark, d):
    """Containers in which places and attention cost bind too."""
    return pack_documents(count_tokens(table(spark, d, "documents")), TIGHT)


def _packing_faults(packed: DataFrame, docs: DataFrame, cap: Capacity) -> DataFrame:
    """One row: documents, and what breaks the rules of packing: containers over a capacity, places and starts that don't follow one
    another, documents that don't come out whole or whose pieces aren't full but for the last."""
    w = Window.partitionBy("container_id").orderBy("place")
    rows = packed.withColumns({"at": F.row_number().over(w) - 1, "before": F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    per = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("c"), F.count_if((F.col("at") != F.col("place")) | (F.col("before") != F.col("start"))).alias("gaps"))
    bins = per.agg(F.count_if(F.col("t") > cap.tokens).alias("over_tokens"), F.count_if(F.col("k") > cap.items).alias("over_places"), F.count_if((F.col("c") > cap.most_cost) & (F.col("k") > 1)).alias("over_cost"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"))
    last = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("distinct"), F.max("piece").alias("top"), F.count_if(F.col("n_tokens") == cap.tokens).alias("full"), F.sum("n_tokens").alias("t"))
    whole = (F.col("pieces") == F.col("distinct")) & (F.col("top") == F.col("pieces") - 1) & (F.col("full") >= F.col("pieces") - 1) & (F.col("t") == F.col("n_tokens"))
    met = docs.join(last, "doc_id", "left").agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("not_whole"))
    out = bins.select(*[F.col(c).cast("bigint").alias(c) for c in ("over_tokens", "over_places", "over_cost", "gaps")], F.lit(0).cast("bigint").alias("documents"), F.lit(0).cast("bigint").alias("not_whole"))
    out = out.unionByName(met.select(*[F.lit(0).cast("bigint").alias(c) for c in ("over_tokens", "over_places", "over_cost", "gaps")], "documents", "not_whole"))
    return out.agg(*[F.sum(c).alias(c) for c in out.columns])


def _packing_check(cap):
    def check(spark, d):
        sized = materialize(count_tokens(table(spark, d, "documents")))
        return _packing_faults(materialize(pack_documents(sized, cap)), sized, cap)

    return check


# Problem 9
def _sized(spark, d) -> DataFrame:
    return materialize(count_tokens(table(spark, d, "documents"), keep=("doc_id", "source")))


def p9_mixture(spark, d):
    return mix_sources(_sized(spark, d), table(spark, d, "source_targets"))


def p9_shares(spark, d):
    sized, targets = _sized(spark, d), table(spark, d, "source_targets")
    return shares_report(mix_sources(sized, targets), sized, targets)


def p9_check(spark, d):
    """For each source of `source_targets` whether the mixture keeps its rules: no more repeats than allowed, and the wanted share of the
    tokens, or else all that the source can give."""
    sized, targets = _sized(spark, d), table(spark, d, "source_targets")
    r = shares_report(mix_sources(sized, targets), sized, targets)
    most = F.col("available_tokens") * F.col("max_repeats")
    fits = (F.col("top_repeat") <= F.col("max_repeats")) & (F.col("used_tokens") <= most) & ((F.col("actual_share") >= F.col("target_share") - 0.02) | (F.col("used_tokens") >= 0.97 * most))
    return r.select("source", "target_share", "max_repeats", fits.alias("fits"))


# Problem 10
#: Most subject areas; each has a classifier of its own.
MAX_SUBJECTS = 1000


def _subjects(spark, d) -> DataFrame:
    names = [r[0] for r in table(spark, d, "subjects").where("subject is not null").select("subject").distinct().limit(MAX_SUBJECTS + 1).collect()]
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    return assign_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), names)


def p10_found(spark, d):
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark, d):
    """How many documents and characters each subject has; a document about two counts half for each."""
    s = _subjects(spark, d)
    s = s.join(s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")), "doc_id")
    n = table(spark, d, "documents").select("doc_id", "n_chars")
    return s.join(n, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum(1 / F.col("k")), 1).alias("docs_shared"), F.round(F.sum(F.col("n_chars") / F.col("k")), 1).alias("chars_shared"))


_BASKET_SQL = """with o as (select distinct db_id, tid, item from (select db_id, tid, unnest(items) as item from transactions
  where db_id is not null and tid is not null) where item is not null),
 n as (select db_id, count(distinct tid) as n from o group by db_id),
 c as (select db_id, item, count(*) as c from o group by db_id, item),
 k as (select o.* from o join c using (db_id, item) where c >= 15),
 ab as (select x.db_id, x.item as item_a, y.item as item_b, count(*) as c_ab from k x join k y on x.db_id = y.db_id and x.tid = y.tid and x.item < y.item
  group by x.db_id, x.item, y.item having count(*) >= 15),
 p as (select ab.*, a.c as c_a, b.c as c_b, n.n from ab join c a on a.db_id = ab.db_id and a.item = item_a
  join c b on b.db_id = ab.db_id and b.item = item_b join n on n.db_id = ab.db_id)"""

_TOGETHER = """with o as (select distinct db_id, tid, item from (select db_id, tid, unnest(items) as item from transactions
  where db_id is not null and tid is not null) where item is not null),
 n as (select db_id, count(distinct tid) as n from o group by db_id),
 c as (select db_id, item, count(*) as c from o group by db_id, item),
 ab as (select x.db_id, x.item as item_a, y.item as item_b, count(*) as c_ab from o x join o y on x.db_id = y.db_id and x.tid = y.tid and x.item < y.item
  group by x.db_id, x.item, y.item),
 p as (select ab.*, a.c as c_a, b.c as c_b, n.n from ab join c a on a.db_id = ab.db_id and a.item = item_a
  join c b on b.db_id = ab.db_id and b.item = item_b join n on n.db_id = ab.db_id)"""

_OVERLAPS = """with s as (select distinct upper(trim(set_id, ' ')) as s, k from kmer_sets where set_id is not null and k is not null),
 z as (select s, count(*) as n from s group by s),
 o as (select a.s as set_a, b.s as set_b, count(*) as shared from s a join s b on a.k = b.k and a.s < b.s group by a.s, b.s),
 p as (select o.*, za.n as size_a, zb.n as size_b from o join z za on za.s = set_a join z zb on zb.s = set_b)"""

_TIMES = """with b as (select config_id, unit, kernel, lookback from (select *, row_number() over (partition by bench_id order by loaded_at desc) as r
  from benchmark_timings where bench_id is not null and config_id is not null) where r = 1),
 v as (select config_id, 'kernel' as metric, unnest(kernel) / case unit when 'us' then 1000.0 when 'ms' then 1.0 end as ms from b
  union all select config_id, 'lookback', unnest(lookback) / case unit when 'us' then 1000.0 when 'ms' then 1.0 end from b
  union all select config_id, 'e2e_ms', e2e_ms from (select *, row_number() over (partition by run_id order by loaded_at desc) as r
   from run_records where run_id is not null and config_id is not null) where r = 1),
 o as (select config_id, metric, ms, row_number() over (partition by config_id, metric order by ms) as r, count(*) over (partition by config_id, metric) as n
  from v where ms >= 0 and not isnan(ms)),
 q as (select config_id, metric, max(n) as n_values, max(ms) filter (r = ceil(0.5 * n)) as p50, max(ms) filter (r = ceil(0.9 * n)) as p90,
  max(ms) filter (r = ceil(0.95 * n)) as p95, max(ms) filter (r = ceil(0.99 * n)) as p99 from o group by config_id, metric)"""

_SETS = """with l as (select * from (select *, row_number() over (partition by pair_id order by loaded_at desc) as r from set_pairs) where r = 1),
 s as (select a_id as id, unnest(a) as v from l union all select b_id, unnest(b) from l),
 t as (select distinct id, v from s where id is not null and v is not null),
 z as (select id, count(*) as n, list(v order by v) as vs from t group by id having count(*) >= 3),
 p as (select x.id as id_1, y.id as id_2, count(*) as c from t x join t y on x.v = y.v and x.id < y.id group by x.id, y.id),
 f as (select id_1, id_2 from p join z a on a.id = id_1 join z b on b.id = id_2 where 10 * c >= 7 * (a.n + b.n - c))"""

_PACKED = """select 0::bigint as over_tokens, 0::bigint as over_places, 0::bigint as over_cost, 0::bigint as gaps, count(*) as documents, 0::bigint as not_whole
 from documents where doc_id is not null"""

QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p1_counts": p1_counts, "p2_found": p2_found, "p2_frequencies": p2_frequencies, "p3_found": p3_found, "p3_overlaps": p3_overlaps, "p3_descent": p3_descent,
    "p5_found": p5_found, "p5_quantiles": p5_quantiles, "p5_days_added": p5_days_added, "p5_summaries": p5_summaries, "p5_rank_check": p5_rank_check, "p6_found": p6_found, "p6_members": p6_members, "p6_cells": p6_cells, "p7_found": p7_found, "p7_leaders": p7_leaders,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_tight": p8_tight, "p8_check": _packing_check(CAPACITY), "p8_tight_check": _packing_check(TIGHT),
    "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_check": p9_check,
    "p10_found": p10_found, "p10_composition": p10_composition,
}
ORACLE = {
    "p1_found": f"{_BASKET_SQL} select db_id, item_a, item_b from p where c_ab * n >= 4 * c_a * c_b",
    "p1_pairs": f"{_BASKET_SQL} select db_id, item_a, item_b, c_ab, c_a, c_b, n, ((1000 * c_ab * n) // (c_a * c_b))::bigint as lift_milli from p",
    "p1_counts": f"{_TOGETHER} select db_id, item_a, item_b, c_ab, c_a, c_b, n, ((1000 * c_ab * n) // (c_a * c_b))::bigint as lift_milli from p",
    "p3_found": f"{_OVERLAPS} select set_a, set_b from p where 10 * shared >= 3 * least(size_a, size_b)",
    "p3_overlaps": f"{_OVERLAPS} select set_a, set_b, shared, size_a, size_b from p",
    "p2_found": f"""{_OCC} select src, owner_id, item, 'rare' as mark from c where support <= 2
 union all select src, owner_id, item, 'common' from c join n using (src, owner_id) where 2 * support >= n""",
    "p2_frequencies": f"{_OCC} select src, owner_id, item, occurrences, support, n as owner_records from c join n using (src, owner_id)",
    "p5_found": f"{_TIMES} select config_id, metric from q where p95 >= 3 * p50",
    "p5_quantiles": f"{_TIMES} select * from q",
    "p5_days_added": f"{_TIMES} select * from q",
    "p5_rank_check": f"{_TIMES} select config_id, metric, n_values, 0::bigint as beyond from q",
    "p6_found": f"{_SETS} select id_1, id_2 from f",
    "p6_members": f"""{_SETS}, c as (select vs, min(id) as class_id, count(*) as copies from z group by vs),
 k as (select z.id, class_id, copies from z join c using (vs)),
 e as (select distinct a.class_id as x, b.class_id as y from f join k a on a.id = id_1 join k b on b.id = id_2 where a.class_id <> b.class_id),
 n as (select x, count(distinct y) as links from (select x, y from e union select y, x from e) group by x)
 select id, class_id, copies, coalesce(links, 0)::bigint as links from k left join n on x = class_id""",
    "p8_check": _PACKED,
    "p8_tight_check": _PACKED,
    "p9_check": r"select regexp_replace(lower(trim(source)), '[\s_\-]+', '-', 'g') as source, target_share, max_repeats, true as fits from source_targets where source is not null",
    "p7_found": f"{_OCC} select src, owner_id, item from c join n using (src, owner_id) where occurrences * 100 >= total",
    "p7_leaders": f"{_OCC} select src, owner_id, item, occurrences, total as owner_occurrences from c join n using (src, owner_id) where occurrences * 100 >= total",
}

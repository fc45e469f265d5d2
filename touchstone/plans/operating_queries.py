"""Operating points, coverage and selective-use queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchstone.operators import agreement as ag
from touchstone.operators import operating as op
from touchstone.plans.registry import arank, query, r, rounded, scorr, t_p

_DOCS = "d as (select doc_id, source, lang, n_chars, toxic, quality from documents join labels using (doc_id))"
_BUDGETS = "b as (select unnest([0.2, 0.1, 0.01]) as fpr_budget)"


def _points_sql(unit, score, label, source):
    return f"""neg as (select {unit}, {score} as v, row_number() over (partition by {unit} order by {score} desc) as rk,
      count(*) over (partition by {unit}) as n_neg from {source} where {label} = 0),
    thr as (select {unit}, fpr_budget, max(n_neg) as n_neg, floor(fpr_budget * max(n_neg)) as k,
      max(case when rk = floor(fpr_budget * n_neg) then v end) as kth, max(v) as top from neg, b group by 1, 2),
    cut as (select *, k = 0 as above_max, case when k = 0 then top else kth end as threshold from thr),
    pts as (select c.{unit}, c.fpr_budget, sum(case when {label} = 1 then 1 else 0 end) as n_pos, max(c.n_neg) as n_neg,
      max(c.threshold) as threshold, bool_or(c.above_max) as above_max,
      sum(case when {label} = 1 and (case when c.above_max then {score} > c.threshold else {score} >= c.threshold end) then 1.0 else 0 end) as fp,
      sum(case when {label} = 0 and (case when c.above_max then {score} > c.threshold else {score} >= c.threshold end) then 1.0 else 0 end) as fn
      from {source} s join cut c on s.{unit} = c.{unit} group by 1, 2)"""


_POINT_COLUMNS = f"""fpr_budget, cast(n_pos as bigint) as n_pos, cast(n_neg as bigint) as n_neg,
  cast(threshold as double) as threshold, above_max, {r('fp / nullif(n_pos, 0)')} as tpr, {r('fn / nullif(n_neg, 0)')} as realised_fpr,
  fpr_budget * n_neg >= 1 as estimable"""


@query("tpr_at_fpr", f"with {_DOCS}, {_BUDGETS}, {_points_sql('source', 'n_chars', 'toxic', 'd')} select source, {_POINT_COLUMNS} from pts")
def tpr_at_fpr(t):
    return rounded(op.operating_points(t.labelled_documents(), "n_chars", "toxic", [0.2, 0.1, 0.01], ["source"]))


_ORD = "o as (select o_orderpriority, o_orderkey, o_custkey, o_totalprice, case when o_orderstatus = 'F' then 1 else 0 end as y from orders)"


def _ordered(t):
    return t.orders.select("o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice",
                           F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))


@query("tpr_at_fpr_orders", f"with {_ORD}, {_BUDGETS}, {_points_sql('o_orderpriority', 'o_totalprice', 'y', 'o')} select o_orderpriority, {_POINT_COLUMNS} from pts")
def tpr_at_fpr_orders(t):
    return rounded(op.operating_points(_ordered(t), "o_totalprice", "y", [0.2, 0.1, 0.01], ["o_orderpriority"]))


@query("usable_units", f"""
with {_DOCS} select source, lang, cast(sum(1 - toxic) as bigint) as n_neg, cast(sum(toxic) as bigint) as n_pos,
  case when sum(1 - toxic) < 5 then 'too few negatives' when sum(toxic) = 0 then 'no positives' end as dropped_because from d group by 1, 2""")
def usable_units(t):
    return op.usable_units(t.labelled_documents(), "n_chars", "toxic", ["source", "lang"], 5)


@query("operating_report", f"""
with d as (select l_suppkey, l_extendedprice, l_quantity, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem), {_BUDGETS},
{_points_sql('l_suppkey', 'l_extendedprice', 'y', 'd')},
rk as (select l_suppkey, {arank('l_extendedprice', 'l_suppkey')} as rx, {arank('l_quantity', 'l_suppkey')} as ry from lineitem),
bulk as (select l_suppkey, {scorr('rx', 'ry')} as rho from rk group by 1),
j as (select fpr_budget, rho, fp / n_pos as tpr from pts join bulk using (l_suppkey) where fpr_budget * n_neg >= 1 and n_pos > 0),
jr as (select *, {arank('rho', 'fpr_budget')} as rx, {arank('tpr', 'fpr_budget')} as ry from j),
c as (select fpr_budget, count(*) as n, quantile_cont(tpr, 0.5) as med, {scorr('rx', 'ry')} as rho from jr group by 1),
w as (select *, rho * sqrt((n - 2.0) / (1 - rho * rho)) as tt, n - 2.0 as df from c)
select fpr_budget, cast(n as bigint) as n_estimable, {r('med')} as median_tpr, {r('rho')} as bulk_predicts_tpr,
  {r(t_p('tt', 'df'), 5)} as bulk_predicts_p from w""")
def operating_report(t):
    rows = t.lineitem.select("l_suppkey", "l_extendedprice", "l_quantity", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    points = op.operating_points(rows, "l_extendedprice", "y", [0.2, 0.1, 0.01], ["l_suppkey"])
    bulk = ag.spearman(rows, "l_extendedprice", "l_quantity", ["l_suppkey"])
    out = op.operating_report(points.filter("n_pos > 0"), bulk, ["l_suppkey"])
    return rounded(out.withColumn("bulk_predicts_p", F.round("bulk_predicts_p", 5)))


_FLAG10 = """thr as (select o_orderpriority, v as threshold from (select o_orderpriority, o_totalprice as v, row_number() over (
    partition by o_orderpriority order by o_totalprice desc) as rk, count(*) over (partition by o_orderpriority) as n from o where y = 0)
    where rk = floor(0.1 * n)),
  f as (select o.*, o_totalprice >= threshold as flagged from o join thr using (o_orderpriority) where y = 1)"""


@query("topk_coverage", f"""
with {_ORD}, {_FLAG10}, k as (select *, row_number() over (partition by o_orderpriority order by o_custkey desc, o_orderkey) as p from f)
select o_orderpriority, round(avg(case when p <= 10 then flagged::int end), 6) + 0.0 as coverage_top10,
  round(avg(case when p <= 50 then flagged::int end), 6) + 0.0 as coverage_top50,
  round(avg(case when p <= 100 then flagged::int end), 6) + 0.0 as coverage_top100 from k group by 1""")
def topk_coverage(t):
    return rounded(op.topk_coverage(_ordered(t), "o_totalprice", "y", "o_custkey", "o_orderkey", 0.1, group=["o_orderpriority"]))


@query("cluster_coverage", f"""
with {_ORD}, {_FLAG10}, c as (select o_orderpriority, o_custkey, bool_or(flagged) as hit from f group by 1, 2)
select o_orderpriority, cast(count(*) as bigint) as n_pos_clusters, round(avg(hit::int), 6) + 0.0 as cluster_coverage from c group by 1""")
def cluster_coverage(t):
    return rounded(op.cluster_coverage(_ordered(t), "o_totalprice", "y", "o_custkey", 0.1, ["o_orderpriority"]))


@query("longest_miss_run", f"""
with {_ORD}, {_FLAG10}, i as (select *, sum(flagged::int) over (partition by o_orderpriority order by o_orderkey) as island from f),
s as (select o_orderpriority, island, sum(1 - flagged::int) as size from i group by 1, 2)
select o_orderpriority, cast(max(size) as bigint) as longest_miss_run from s group by 1""")
def longest_miss_run(t):
    return op.longest_miss_run(_ordered(t), "o_totalprice", "y", ["o_orderkey"], 0.1, ["o_orderpriority"])


@query("risk_coverage", """
with cu as (select c_nationkey % 5 as region, c_custkey, c_acctbal, avg(o_totalprice) / 500000.0 as skill from customer
   join orders on o_custkey = c_custkey group by 1, 2, 3),
k as (select *, row_number() over (partition by region order by c_acctbal desc, c_custkey) as p, count(*) over (partition by region) as n from cu),
c as (select unnest([1.0, 0.8, 0.5]) as coverage), m as (select region, avg(skill) as rc from cu group by 1)
select k.region, coverage, cast(count(*) as bigint) as kept, round(avg(skill), 6) + 0.0 as mean_skill,
  round(avg(case when skill < 0.5 then 1.0 else 0 end), 6) + 0.0 as frac_unreliable, round(max(rc), 6) + 0.0 as random_control
from k join c on p <= round_even(coverage * n, 0) join m on m.region = k.region group by 1, 2""")
def risk_coverage(t):
    return rounded(op.risk_coverage(_customers(t), "c_acctbal", "skill", "c_custkey", [1.0, 0.8, 0.5], ["region"], 0.5))


def _customers(t):
    means = t.orders.groupBy("o_custkey").agg((F.avg("o_totalprice") / 500000.0).alias("skill"), F.max("o_totalprice").alias("best"))
    rows = t.customer.select("c_custkey", "c_acctbal", (F.col("c_nationkey") % 5).alias("region"))
    return rows.join(means, rows.c_custkey == means.o_custkey)


_CU = """cu as (select c_nationkey % 5 as region, c_custkey, c_acctbal, avg(o_totalprice) / 500000.0 as skill, max(o_totalprice) as best
   from customer join orders on o_custkey = c_custkey group by 1, 2, 3)"""


@query("low_tail_catch", f"""
with {_CU}, k as (select *, row_number() over (partition by region order by c_acctbal, c_custkey) as p, count(*) over (partition by region) as n from cu),
c as (select unnest([0.4, 0.5]) as cut), j as (select *, sum(case when skill < cut then 1 else 0 end) over (partition by region, cut) as bad from k, c)
select region, cast(max(n) as bigint) as n, cut, cast(max(bad) as bigint) as bad,
  cast(sum(case when skill < cut and p <= bad then 1 else 0 end) as bigint) as hits,
  round(max(bad) * max(bad) / max(n), 6) + 0.0 as chance,
  round(sum(case when skill < cut and p <= bad then 1.0 else 0 end) / max(bad), 6) + 0.0 as precision
from j group by region, cut having max(bad) > 0""")
def low_tail_catch(t):
    return rounded(op.low_tail_catch(_customers(t), "c_acctbal", "skill", "c_custkey", [0.4, 0.5], ["region"]))


@query("calibration_bins", f"""
with {_CU}, q as (select region, quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1.0]) as q from cu group by 1)
select cu.region, cast(b as int) as bin, cast(count(*) as bigint) as n, {r('avg(c_acctbal)')} as predicted, {r('avg(skill)')} as actual
from cu join q on q.region = cu.region, (select unnest([1, 2, 3, 4]) as b) where c_acctbal >= q[b] and c_acctbal <= q[b + 1] group by 1, 2""")
def calibration_bins(t):
    return rounded(op.calibration_bins(_customers(t), "c_acctbal", "skill", 4, ["region"]))


@query("routing_curve", f"""
with {_CU}, g as (select *, best - skill * 500000.0 as gain from cu),
k as (select *, row_number() over (partition by region order by c_acctbal, c_custkey) as pf,
  row_number() over (partition by region order by round(gain, 4) desc, c_custkey) as pg, count(*) over (partition by region) as n from g),
f as (select unnest([0.25, 0.5, 1.0]) as fraction)
select region, fraction, (1 + fraction * 3.0) / 4.0 as cost,
  {r('avg(case when pf <= round_even(fraction * n, 0) then gain else 0 end) / avg(gain)', 5)} as gain_forecast,
  {r('avg(case when pg <= round_even(fraction * n, 0) then gain else 0 end) / avg(gain)', 5)} as gain_oracle, fraction as gain_random
from k, f group by region, fraction""")
def routing_curve(t):
    rows = _customers(t).withColumn("cheap", F.lit(0.0)).withColumn("costly", F.col("best") - F.col("skill") * 500000.0)
    return rounded(op.routing_curve(rows, "c_acctbal", "cheap", "costly", "c_custkey", [0.25, 0.5, 1.0], 4.0, ["region"]), 5)


@query("crossover_budget", """
with m as (select l_shipmonth, l_suppkey % 5 as cell, avg(case when l_returnflag = 'A' then l_quantity end) as a,
   avg(case when l_returnflag = 'R' then l_quantity end) as b from (select *, cast(month(l_shipdate) as int) as l_shipmonth from lineitem) group by 1, 2),
l as (select cell, max(case when b < a then l_shipmonth end) as last from m group by 1)
select m.cell, cast(min(case when last is null or l_shipmonth > last then l_shipmonth end) as double) as crossover from m join l using (cell) group by 1""")
def crossover_budget(t):
    cells = t.lineitem.select("l_quantity", "l_returnflag", (F.col("l_suppkey") % 5).alias("cell"), F.month("l_shipdate").alias("month"))
    means = cells.groupBy("cell", "month").agg(
        F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"),
        F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("b"))
    return op.crossover_budget(means, "month", "a", "b", ["cell"]).withColumn("crossover", F.col("crossover").cast("double"))


_PARTNERS = """w as (select l_suppkey, sum(case when l_returnflag = 'A' then l_quantity else 0 end) as fa,
    sum(case when l_returnflag = 'N' then l_quantity else 0 end) as fn, sum(case when l_returnflag = 'R' then l_quantity else 0 end) as fr
    from lineitem group by 1),
  x as (select l_suppkey, (fa - min(fa) over ()) / (max(fa) over () - min(fa) over ()) as a, (fn - min(fn) over ()) / (max(fn) over () - min(fn) over ()) as n,
    (fr - min(fr) over ()) / (max(fr) over () - min(fr) over ()) as rr from w)"""


def partner_responses(t):
    """Supplier quantities per return flag, scaled 0..1 per flag: one wanted and two unwanted responses."""
    from touchstone.operators.groups import minmax_within

    long = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    scaled = minmax_within(long, "v", ["l_returnflag"], "s")
    return scaled.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("s")).withColumnsRenamed({"A": "a", "N": "n", "R": "rr"})


@query("two_sided_objectives", f"""
with {_PARTNERS} select l_suppkey, {r('a')} as affinity, {r('a - greatest(n, rr)')} as margin,
  {r('case when greatest(n, rr) <= 0.5 then a else -1 end')} as gated, {r('a - 5.0 * greatest(0, greatest(n, rr) - 0.5)')} as lagrangian,
  {r('ln(greatest(a, 0.001) + 0.001) - ln(greatest(greatest(n, rr), 0.001) + 0.001)')} as logratio,
  a >= 0.6 and greatest(n, rr) <= 0.5 as specific,
  case when a >= 0.6 and n <= 0.4 then 'specific' when a >= 0.6 and n >= 0.6 then 'promiscuous' when a <= 0.4 and n >= 0.6 then 'reverse'
    when a <= 0.4 and n <= 0.4 then 'dead' else 'other' end as quadrant from x""")
def two_sided_objectives(t):
    from touchstone.functions.numeric import is_specific, objective, quadrant

    rows = partner_responses(t)
    kinds = ("affinity", "margin", "gated", "lagrangian", "logratio")
    return rounded(rows.select(
        "l_suppkey", *[objective(k, "a", ["n", "rr"]).alias(k) for k in kinds],
        is_specific("a", ["n", "rr"], 0.5, 0.6).alias("specific"), quadrant("a", "n", 0.6, 0.4, 0.6).alias("quadrant")))


@query("nomination_eval", f"""
with {_PARTNERS} select cast(sum(case when l_suppkey % 3 = 0 then 1 else 0 end) as bigint) as n,
  {r('avg(case when l_suppkey % 3 = 0 then a - greatest(n, rr) end)')} as mean_score,
  {r('max(a - greatest(n, rr)) - avg(case when l_suppkey % 3 = 0 then a - greatest(n, rr) end)')} as regret,
  {r('avg(case when l_suppkey % 3 = 0 then (greatest(n, rr) > 0.5)::int end)')} as off_target_rate,
  {r('avg(case when l_suppkey % 3 = 0 then (a >= 0.8 and greatest(n, rr) <= 0.5)::int end)')} as success_rate,
  {r('avg(case when l_suppkey % 3 = 0 then a end)')} as mean_on, {r('avg(case when l_suppkey % 3 = 0 then greatest(n, rr) end)')} as mean_off from x""")
def nomination_eval(t):
    return rounded(op.nomination_eval(partner_responses(t), F.col("l_suppkey") % 3 == 0, "a", ["n", "rr"]))


@query("global_best", """
select p_brand, max(p_retailprice) as best_value, min(case when p_retailprice = m then p_partkey end) as best_key from
 (select *, max(p_retailprice) over (partition by p_brand) as m from part) group by 1""")
def global_best(t):
    return op.global_best(t.part, "p_retailprice", "p_partkey", ["p_brand"])


@query("hamming_ball_best", """
with k as (select lpad(cast(p_partkey as varchar), 6, '0') as code, p_retailprice as v from part),
d as (select v, len(list_filter(range(1, 7), lambda i: substr(code, cast(i as int), 1) <> substr('000500', cast(i as int), 1))) as dist from k),
h as (select unnest([1, 2, 3]) as radius)
select cast(radius as int) as radius, max(v) as best from d join h on dist <= radius group by 1""")
def hamming_ball_best(t):
    rows = t.part.select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code"), "p_retailprice")
    return op.hamming_ball_best(rows, "code", "p_retailprice", "000500", [1, 2, 3])

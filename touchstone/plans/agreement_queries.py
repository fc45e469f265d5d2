"""Rank, correlation and top-of-ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchstone.functions.tails import spearman_p
from touchstone.operators import agreement as ag
from touchstone.operators import ranks
from touchstone.plans.registry import arank, binom_p, query, r, rounded, scorr, t_p

_LO = """lo as (select o_orderpriority, l_extendedprice, l_quantity, l_linenumber, l_suppkey, o_totalprice
  from lineitem join orders on l_orderkey = o_orderkey)"""


@query("average_rank_ties", f"""
select event_id, event_type, {r(arank('round(value)', 'event_type'), 1)} as rank_v from events""")
def average_rank_ties(t):
    rows = t.events.select("event_id", "event_type", F.round("value").alias("v"))
    return rounded(ranks.average_ranks(rows, ["event_type"], ["v"]).select("event_id", "event_type", "rank_v"), 1)


@query("ranking_windows", """
select event_type, cast(v as double) as v, cast(count(*) as bigint) as n,
  cast(min(rk) - 1 as bigint) as rows_before, round(min(pr), 6) + 0.0 as pct_rank
from (select event_type, round(value) as v, rank() over (partition by event_type order by round(value)) as rk,
        percent_rank() over (partition by event_type order by round(value)) as pr from events)
group by 1, 2""")
def ranking_windows(t):
    rows = t.events.select("event_type", F.round("value").alias("v"))
    out = ranks.percent_rank(rows, ["event_type"], "v")
    return rounded(out.select("event_type", "v", "n", F.col("before").alias("rows_before"), "pct_rank"))


@query("within_group_rank", f"""
with {_LO}, long as (
  select o_orderpriority, 'l_extendedprice' as score_name, l_extendedprice as score, o_totalprice from lo
  union all select o_orderpriority, 'l_quantity', l_quantity, o_totalprice from lo),
ranked as (select *, {arank('score', 'o_orderpriority, score_name')} as rx,
  {arank('o_totalprice', 'o_orderpriority, score_name')} as ry from long)
select o_orderpriority, score_name, cast(count(*) as bigint) as n, cast(count(*) as bigint) as n_score,
  {r(scorr('rx', 'ry'))} as rho from ranked group by 1, 2""")
def within_group_rank(t):
    rows = t.order_lines("o_orderpriority", "l_extendedprice", "l_quantity", "o_totalprice")
    return rounded(ag.within_group_rank(rows, ["l_extendedprice", "l_quantity"], "o_totalprice", ["o_orderpriority"]))


@query("partial_rank", f"""
with {_LO}, ranked as (select o_orderpriority, {arank('l_extendedprice', 'o_orderpriority')} as x,
  {arank('o_totalprice', 'o_orderpriority')} as y, {arank('l_linenumber', 'o_orderpriority')} as z from lo),
c as (select o_orderpriority, cast(count(*) as bigint) as n, {scorr('x', 'y')} as xy, {scorr('x', 'z')} as xz,
  {scorr('y', 'z')} as yz from ranked group by 1)
select o_orderpriority, n, {r('xy')} as raw_rho, {r('xz')} as score_vs_nuisance, {r('yz')} as target_vs_nuisance,
  {r('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))')} as partial_rho from c""")
def partial_rank(t):
    rows = t.order_lines("o_orderpriority", "l_extendedprice", "l_linenumber", "o_totalprice")
    return rounded(ag.partial_rank(rows, "l_extendedprice", "o_totalprice", "l_linenumber", ["o_orderpriority"]))


_PER_SUPPLIER = f"""ranked as (select l_suppkey, s, score, {arank('score', 'l_suppkey, s')} as rx,
    {arank('l_tax', 'l_suppkey, s')} as ry from (
      select l_suppkey, 'l_extendedprice' as s, l_extendedprice as score, l_tax from lineitem
      union all select l_suppkey, 'l_quantity', l_quantity, l_tax from lineitem
      union all select l_suppkey, 'l_discount', l_discount, l_tax from lineitem)),
  per as (select l_suppkey, s as score_name, cast(count(*) as double) as n, {scorr('rx', 'ry')} as rho from ranked
    group by 1, 2 having count(*) >= 5)"""
_SUMMARY = f"""summary as (select score_name, cast(count(*) as bigint) as studies,
    sum(n * rho) / sum(n) as weighted_mean_rho, quantile_cont(rho, 0.5) as median_rho,
    cast(sum(case when rho > 0 then 1 else 0 end) as bigint) as studies_positive
    from per where rho is not null group by 1)"""


def _supplier_rho(t):
    rows = t.lineitem.select("l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return ag.within_group_rank(rows, ["l_extendedprice", "l_quantity", "l_discount"], "l_tax", ["l_suppkey"])


@query("pooled_summary", f"""
with {_PER_SUPPLIER}, {_SUMMARY}
select score_name, studies, {r('weighted_mean_rho')} as weighted_mean_rho, {r('median_rho')} as median_rho,
  studies_positive, {r(binom_p('studies_positive', 'studies'))} as sign_test_p from summary""")
def pooled_summary(t):
    return rounded(ag.pooled_summary(_supplier_rho(t)))


@query("baseline_margin", f"""
with {_PER_SUPPLIER}, {_SUMMARY},
best as (select score_name as b, weighted_mean_rho as v from summary where score_name <> 'l_extendedprice'
  order by abs(weighted_mean_rho) desc, score_name desc limit 1)
select score_name as learned, {r('weighted_mean_rho')} as learned_rho, b as best_baseline, {r('v')} as best_baseline_rho,
  {r('abs(weighted_mean_rho) - abs(v)')} as margin from summary, best where score_name = 'l_extendedprice'""")
def baseline_margin(t):
    summary = ag.pooled_summary(_supplier_rho(t))
    return rounded(ag.baseline_margin(summary, ["l_extendedprice"], ["l_quantity", "l_discount"]))


_STRATA = f"""long as (select l_returnflag, l_linenumber, 'l_quantity' as score_name, l_quantity as score, l_discount as y from lineitem
    union all select l_returnflag, l_linenumber, 'l_extendedprice', l_extendedprice, l_discount from lineitem),
  inner_ranked as (select *, {arank('score', 'l_returnflag, score_name, l_linenumber')} as rx,
    {arank('y', 'l_returnflag, score_name, l_linenumber')} as ry from long),
  inner_rho as (select l_returnflag, score_name, l_linenumber, count(*) as n, {scorr('rx', 'ry')} as rho
    from inner_ranked group by 1, 2, 3 having count(*) >= 5),
  means as (select l_returnflag, score_name, cast(count(*) as bigint) as strata, cast(sum(n) as bigint) as covered,
    avg(rho) as within_rho from inner_rho group by 1, 2),
  pool_ranked as (select *, {arank('score', 'l_returnflag, score_name')} as rx, {arank('y', 'l_returnflag, score_name')} as ry from long),
  pooled as (select l_returnflag, score_name, cast(count(*) as bigint) as n, {scorr('rx', 'ry')} as pooled_rho from pool_ranked group by 1, 2)"""


@query("stratified_view", f"""
with {_STRATA} select p.l_returnflag, p.score_name, n, {r('pooled_rho')} as pooled_rho, strata, covered,
  {r('within_rho')} as within_rho, sign(within_rho) <> sign(pooled_rho) as sign_flip
from pooled p join means m on p.l_returnflag = m.l_returnflag and p.score_name = m.score_name""")
def stratified_view(t):
    rows = t.lineitem.select("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    out = ag.stratified_view(rows, ["l_quantity", "l_extendedprice"], "l_discount", "l_linenumber", ["l_returnflag"])
    return rounded(out)


@query("readiness_survey", f"""
with {_STRATA}, nz as (select l_returnflag, {arank('l_linenumber', 'l_returnflag')} as rx, {arank('l_discount', 'l_returnflag')} as ry from lineitem),
nrho as (select l_returnflag, {scorr('rx', 'ry')} as nuisance_rho from nz group by 1),
mixed as (select l_returnflag, min(l_linenumber) < max(l_linenumber) as mixed_stratum from lineitem group by 1)
select p.l_returnflag, p.score_name, n, {r('pooled_rho')} as pooled_rho, strata, covered,
  {r('within_rho')} as within_rho, sign(within_rho) <> sign(pooled_rho) as sign_flip, mixed_stratum, {r('nuisance_rho')} as nuisance_rho
from pooled p join means m on p.l_returnflag = m.l_returnflag and p.score_name = m.score_name
  join nrho on nrho.l_returnflag = p.l_returnflag join mixed on mixed.l_returnflag = p.l_returnflag""")
def readiness_survey(t):
    rows = t.lineitem.select("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return rounded(ag.readiness_survey(rows, ["l_quantity", "l_extendedprice"], "l_discount", "l_linenumber", ["l_returnflag"]))


_DL = "d as (select documents.doc_id, lang, source, n_chars, quality, toxic from documents join labels using (doc_id))"


@query("roc_auc", f"""
with {_DL}, ranked as (select lang, quality, {arank('n_chars', 'lang')} as rk from d)
select lang, cast(sum(quality) as bigint) as n_pos, cast(sum(1 - quality) as bigint) as n_neg,
  {r('(sum(case when quality = 1 then rk end) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * sum(1 - quality), 0)')} as auc
from ranked group by 1""")
def roc_auc(t):
    return rounded(ag.roc_auc(t.labelled_documents(), "n_chars", "quality", ["lang"]))


@query("roc_auc_orders", f"""
with ranked as (select o_orderpriority, case when o_orderstatus = 'F' then 1 else 0 end as y, {arank('o_totalprice', 'o_orderpriority')} as rk from orders)
select o_orderpriority, cast(sum(y) as bigint) as n_pos, cast(sum(1 - y) as bigint) as n_neg,
  {r('(sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))')} as auc from ranked group by 1""")
def roc_auc_orders(t):
    rows = t.orders.select("o_orderpriority", "o_totalprice", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    return rounded(ag.roc_auc(rows, "o_totalprice", "y", ["o_orderpriority"]))


@query("macro_ovr_auc", f"""
with long as (select l_linestatus, c, case c when 'A' then l_quantity when 'N' then l_discount else l_tax end as s,
    case when l_returnflag = c then 1 else 0 end as y from lineitem, (values ('A'), ('N'), ('R')) v(c)),
ranked as (select l_linestatus, c, y, {arank('s', 'l_linestatus, c')} as rk from long),
per as (select l_linestatus, c, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) as auc
  from ranked group by 1, 2)
select l_linestatus, {r('avg(auc)')} as macro_auc, cast(count(auc) as bigint) as classes from per group by 1""")
def macro_ovr_auc(t):
    rows = t.lineitem.select("l_linestatus", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    scores = {"A": "l_quantity", "N": "l_discount", "R": "l_tax"}
    return rounded(ag.macro_ovr_auc(rows, scores, "l_returnflag", ["l_linestatus"]))


_SEGMENT = """seg as (select c_mktsegment, o_orderkey, c_acctbal, o_totalprice,
    row_number() over (partition by c_mktsegment order by c_acctbal desc, o_orderkey) as ps,
    row_number() over (partition by c_mktsegment order by o_totalprice desc, o_orderkey) as pt,
    count(*) over (partition by c_mktsegment) as n from orders join customer on o_custkey = c_custkey)"""


def _segments(t):
    customers = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


@query("elite_metrics", f"""
with {_SEGMENT}, k as (select *, greatest(5, cast(round_even(0.1 * n, 0) as bigint)) as k,
    {arank('c_acctbal', 'c_mktsegment')} as rk from seg)
select c_mktsegment, cast(max(n) as bigint) as n, cast(max(k) as bigint) as k,
  cast(sum(case when ps <= k and pt <= k then 1 else 0 end) as bigint) as hits,
  {r('(sum(case when pt <= k then rk end) - max(k) * (max(k) + 1) / 2.0) / (max(k) * (max(n) - max(k)))')} as elite_auroc,
  {r('sum(case when ps <= k and pt <= k then 1 else 0 end) * max(n) / (max(k) * max(k))')} as enrichment
from k group by 1""")
def elite_metrics(t):
    return rounded(ag.elite_metrics(_segments(t), "c_acctbal", "o_totalprice", "o_orderkey", ["c_mktsegment"]))


_UTIL = "(avg(case when ps <= {k} then o_totalprice end) - avg(o_totalprice)) / (avg(case when pt <= {k} then o_totalprice end) - avg(o_totalprice))"


@query("topk_utility", f"""
with {_SEGMENT}, k as (select *, greatest(1, cast(round_even(0.01 * n, 0) as bigint)) as k1,
  greatest(1, cast(round_even(0.1 * n, 0) as bigint)) as k10 from seg)
select c_mktsegment, cast(count(*) as bigint) as n, {r(_UTIL.format(k='k1'))} as utility_1pct,
  {r(_UTIL.format(k='k10'))} as utility_10pct from k group by 1""")
def topk_utility(t):
    return rounded(ag.topk_utility(_segments(t), "c_acctbal", "o_totalprice", "o_orderkey", ["c_mktsegment"]))


@query("bulk_vs_elite", f"""
with {_SEGMENT}, k as (select *, greatest(1, cast(round_even(0.01 * n, 0) as bigint)) as k1,
  greatest(1, cast(round_even(0.1 * n, 0) as bigint)) as k10,
  {arank('c_acctbal', 'c_mktsegment')} as rx, {arank('o_totalprice', 'c_mktsegment')} as ry from seg)
select c_mktsegment, cast(count(*) as bigint) as n, {r(_UTIL.format(k='k1'))} as utility_1pct,
  {r(_UTIL.format(k='k10'))} as utility_10pct, {r(scorr('rx', 'ry'))} as bulk from k group by 1""")
def bulk_vs_elite(t):
    return rounded(ag.bulk_vs_elite(_segments(t), "c_acctbal", "o_totalprice", "o_orderkey", ["c_mktsegment"]))


@query("ndcg_at_k", f"""
with {_SEGMENT}, rel as (select *, {arank('o_totalprice', 'c_mktsegment')} / n as rel from seg)
select c_mktsegment, cast(count(*) as bigint) as n,
  {r('sum(case when ps <= 50 then rel / log2(ps + 1.0) end) / sum(case when pt <= 50 then rel / log2(pt + 1.0) end)')} as ndcg
from rel group by 1""")
def ndcg_at_k(t):
    return rounded(ag.ndcg_at_k(_segments(t), "c_acctbal", "o_totalprice", "o_orderkey", 50, ["c_mktsegment"]))


@query("topk_recall", f"""
with {_SEGMENT}, k as (select *, greatest(1, cast(round_even(0.05 * n, 0) as bigint)) as k from seg)
select c_mktsegment, cast(max(n) as bigint) as n, cast(sum(case when pt <= k then 1 else 0 end) as bigint) as elite,
  {r('avg(case when pt <= k then (case when c_acctbal > 5000 then 1.0 else 0.0 end) end)')} as recall from k group by 1""")
def topk_recall(t):
    rows = _segments(t).withColumn("picked", F.col("c_acctbal") > 5000)
    return rounded(ag.topk_recall(rows, "picked", "o_totalprice", "o_orderkey", ["c_mktsegment"], 0.05))


@query("pick_disagreement", """
with p as (select p_brand, row_number() over (partition by p_brand order by p_size desc, p_partkey) as a,
  row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as b from part)
select p_brand, cast(sum(case when a <= 20 and b <= 20 then 1 else 0 end) as bigint) as shared,
  cast(sum(case when a <= 20 or b <= 20 then 1 else 0 end) as bigint) as picked,
  round(1 - sum(case when a <= 20 and b <= 20 then 1.0 else 0 end) / sum(case when a <= 20 or b <= 20 then 1 else 0 end), 6) + 0.0 as disagreement
from p group by 1""")
def pick_disagreement(t):
    return rounded(ag.pick_disagreement(t.part, "p_size", "p_retailprice", "p_partkey", 20, ["p_brand"]))


@query("decision_flips", f"""
with c as (select p_brand, p_size, p_retailprice, quantile_cont(p_size, 0.5) over (partition by p_brand) as ca,
   quantile_cont(p_retailprice, 0.5) over (partition by p_brand) as cb,
   {arank('p_size', 'p_brand')} as rx, {arank('p_retailprice', 'p_brand')} as ry from part)
select p_brand, {r(scorr('p_size', 'p_retailprice'))} as pearson, {r('max(abs(p_size - p_retailprice))')} as max_abs_diff,
  cast(sum(case when (p_size >= ca) <> (p_retailprice >= cb) then 1 else 0 end) as bigint) as flips,
  cast(count(*) as bigint) as n, case when count(*) >= 5 then {r(scorr('rx', 'ry'))} end as spearman from c group by 1""")
def decision_flips(t):
    part = t.part.select("p_brand", "p_size", "p_retailprice")
    cuts = ranks.group_quantiles(part, ["p_brand"], "p_size", {"ca": 0.5}).join(
        ranks.group_quantiles(part, ["p_brand"], "p_retailprice", {"cb": 0.5}), "p_brand")
    return rounded(ag.decision_flips(part.join(cuts, "p_brand"), "p_size", "p_retailprice", "ca", "cb", ["p_brand"]))


@query("trend_rho", f"""
with m as (select l_returnflag, l_linestatus, l_linenumber, avg(l_extendedprice) as metric from lineitem group by 1, 2, 3),
k as (select l_returnflag, l_linestatus, {arank('l_linenumber', 'l_returnflag, l_linestatus')} as rx,
  {arank('metric', 'l_returnflag, l_linestatus')} as ry from m)
select l_returnflag, l_linestatus, cast(count(*) as bigint) as n, {r(scorr('rx', 'ry'))} as trend from k group by 1, 2""")
def trend_rho(t):
    metric = t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_extendedprice").alias("metric"))
    return rounded(ag.trend_rho(metric, "l_linenumber", "metric", ["l_returnflag", "l_linestatus"]))


@query("topk_accuracy_mrr", """
with s as (select l_suppkey, l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) as q from lineitem group by 1, 2, 3, 4),
tot as (select l_suppkey, l_linenumber, sum(q) as score from s group by 1, 2),
truth as (select l_suppkey, l_linenumber as truth from (select l_suppkey, l_linenumber, row_number() over (
   partition by l_suppkey order by count(*) desc, l_linenumber) as rn from lineitem group by 1, 2) where rn = 1),
ranked as (select l_suppkey, l_linenumber, row_number() over (partition by l_suppkey order by score desc, l_linenumber) as place from tot),
hit as (select t.l_suppkey, min(case when l_linenumber = truth then place end) as pos from ranked join truth t on t.l_suppkey = ranked.l_suppkey group by 1)
select cast(count(*) as bigint) as n, round(avg(case when pos <= 1 then 1.0 else 0 end), 6) + 0.0 as top1,
  round(avg(case when pos <= 3 then 1.0 else 0 end), 6) + 0.0 as top3, round(avg(case when pos <= 5 then 1.0 else 0 end), 6) + 0.0 as top5,
  round(avg(coalesce(1.0 / pos, 0)), 6) + 0.0 as mrr from hit""")
def topk_accuracy_mrr(t):
    lines = t.lineitem.select("l_suppkey", "l_linenumber", "l_quantity")
    scored = lines.groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("score"), F.count(F.lit(1)).alias("seen"))
    truth = scored.groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("seen", -F.col("l_linenumber"))).alias("truth"))
    return rounded(ag.topk_accuracy(scored.join(truth, "l_suppkey"), "l_suppkey", "truth", "l_linenumber", "score"))


@query("median_cut_mcc", f"""
with {_DL}, c as (select lang, quality, n_chars >= quantile_cont(n_chars, 0.5) over (partition by lang) as f from d),
k as (select lang, sum(case when f and quality = 1 then 1.0 else 0 end) as tp, sum(case when f and quality <> 1 then 1.0 else 0 end) as fp,
  sum(case when not f and quality = 1 then 1.0 else 0 end) as fn, sum(case when not f and quality <> 1 then 1.0 else 0 end) as tn from c group by 1)
select lang, cast(tp as double) as tp, cast(fp as double) as fp, cast(fn as double) as fn, cast(tn as double) as tn,
 {r('coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)')} as mcc from k""")
def median_cut_mcc(t):
    return rounded(ag.median_cut_mcc(t.labelled_documents(), "quality", "n_chars", ["lang"]))


@query("spearman_with_p", f"""
with k as (select o_orderstatus, {arank('o_totalprice', 'o_orderstatus')} as rx, {arank('o_orderkey', 'o_orderstatus')} as ry from orders),
c as (select o_orderstatus, cast(count(*) as bigint) as n, {scorr('rx', 'ry')} as rho from k group by 1),
w as (select *, rho * sqrt((n - 2.0) / (1 - rho * rho)) as tt, n - 2.0 as df from c)
select o_orderstatus, n, {r('rho')} as rho, {r(t_p('tt', 'df'), 5)} as p from w""")
def spearman_with_p(t):
    out = ag.spearman(t.orders, "o_totalprice", "o_orderkey", ["o_orderstatus"])
    return rounded(out).join(out.select("o_orderstatus", F.round(spearman_p("rho", "n"), 5).alias("p")), "o_orderstatus")


@query("quantile_warp", f"""
with k as (select o_orderkey, o_orderpriority, {arank('o_totalprice', 'o_orderpriority')} / (count(*) over (partition by o_orderpriority) + 1) as u,
   o_totalprice from orders)
select o_orderpriority, cast(count(*) as bigint) as n, {r('avg(u)')} as mean_u from k group by 1""")
def quantile_warp(t):
    # The normal distribution function undoes the warp, which leaves rank / (n + 1) to compare.
    from touchstone.functions.tails import normal_upper

    rows = ranks.quantile_warp(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice")
    back = rows.withColumn("u", 1 - normal_upper("warped"))
    return rounded(back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("mean_u")))


@query("grouped_top_k", """
select c_nationkey, c_custkey, c_acctbal, cast(place as int) as place from (select c_nationkey, c_custkey, c_acctbal,
  row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as place from customer) where place <= 3""")
def grouped_top_k(t):
    rows = t.customer.select("c_nationkey", "c_custkey", "c_acctbal")
    return ranks.top_k(rows, ["c_nationkey"], "c_custkey", "c_acctbal", 3).withColumn("place", F.col("place").cast("int"))


@query("group_quantiles", """
select l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 3) + 0.0 as q025, round(quantile_cont(l_extendedprice, 0.5), 3) + 0.0 as q50,
  round(quantile_cont(l_extendedprice, 0.975), 3) + 0.0 as q975 from lineitem group by 1""")
def group_quantiles(t):
    return rounded(ranks.group_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"q025": 0.025, "q50": 0.5, "q975": 0.975}), 3)

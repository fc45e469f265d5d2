"""Group statistics, duplicates, hypothesis tests and adjustment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchstone.functions.numeric import condition_key, ddg, log_enrichment
from touchstone.operators import groups as gr
from touchstone.operators import hypothesis as hy
from touchstone.plans.registry import arank, binom_p, normal_sf, query, r, rounded, scorr, t_p, t_quantile


@query("minmax_per_partner", """
select l_returnflag, l_suppkey, round((v - min(v) over (partition by l_returnflag)) / (max(v) over (partition by l_returnflag) - min(v) over (partition by l_returnflag)), 6) + 0.0 as scaled,
  round(sd / (max(v) over (partition by l_returnflag) - min(v) over (partition by l_returnflag)), 6) + 0.0 as sd
from (select l_returnflag, l_suppkey, sum(l_quantity) as v, stddev_samp(l_quantity) as sd from lineitem group by 1, 2)""")
def minmax_per_partner(t):
    cells = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("v"), F.stddev_samp("l_quantity").alias("sd"))
    return rounded(gr.minmax_within(cells, "v", ["l_returnflag"], "scaled", "sd").select("l_returnflag", "l_suppkey", "scaled", "sd"))


@query("zscore_within", """
select event_id, round((value - avg(value) over (partition by event_type)) / stddev_pop(value) over (partition by event_type), 6) + 0.0 as z from events""")
def zscore_within(t):
    return rounded(gr.zscore_within(t.events, "value", ["event_type"], "z").select("event_id", "z"))


@query("condition_levels", """
with n as (select count(*) as n, count(distinct o_orderstatus) as a, count(distinct o_orderpriority) as b, count(distinct o_custkey) as c,
  count(distinct o_orderkey) as d from orders),
l as (select 'o_orderstatus' as "column", a as levels, n from n union all select 'o_orderpriority', b, n from n
  union all select 'o_custkey', c, n from n union all select 'o_orderkey', d, n from n)
select "column", cast(levels as bigint) as levels, case when levels <= 1 then 'constant' when levels > 12 or levels > 0.5 * n then 'ignored' else 'condition' end as role from l""")
def condition_levels(t):
    return gr.condition_levels(t.orders, "o_totalprice", ["o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey"])


@query("select_stratum", """
with k as (select o_orderkey, o_orderstatus || ' | ' || o_orderpriority as label from orders where o_orderkey % 10 <> 0),
top as (select label from k group by 1 order by count(*) desc, label limit 1)
select label, cast(count(*) as bigint) as n, cast(sum(o_orderkey) as bigint) as keys from k where label = (select label from top) group by 1
union all select 'candidate', cast(count(*) as bigint), cast(sum(o_orderkey) as bigint) from orders where o_orderkey % 10 = 0""")
def select_stratum(t):
    # Every tenth order plays a candidate: no target and no declared condition.
    candidate = F.col("o_orderkey") % 10 == 0
    rows = t.orders.select("o_orderkey", F.when(~candidate, F.col("o_totalprice")).alias("target"),
                           F.when(~candidate, condition_key(["o_orderstatus", "o_orderpriority"])).otherwise("candidate").alias("label"))
    kept = gr.select_stratum(rows, "target", "label", F.col("label") != "candidate")
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("condition_key", """
select case when l_quantity > 25 then 'nan' else l_returnflag end || ' | ' || l_linestatus as label, cast(count(*) as bigint) as n from lineitem group by 1""")
def condition_key_query(t):
    rows = t.lineitem.select(F.when(F.col("l_quantity") <= 25, F.col("l_returnflag")).alias("flag"), "l_linestatus")
    return rows.groupBy(condition_key(["flag", "l_linestatus"]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("dedup_units", """
select md5(text) as content, min(doc_id) as doc_id, cast(count(*) as bigint) as copies from documents group by 1""")
def dedup_units(t):
    return gr.dedup_units(t.documents, "doc_id", gr.content_key("text"))


@query("dedup_effect", """
with k as (select min(doc_id) as doc_id from documents group by md5(text))
select lang, cast(count(*) as bigint) as units, round(avg(n_chars), 6) + 0.0 as mean_chars, 'before' as stage from documents group by 1
union all select lang, cast(count(*) as bigint), round(avg(n_chars), 6) + 0.0, 'after' from documents where doc_id in (select doc_id from k) group by 1""")
def dedup_effect(t):
    return rounded(gr.dedup_effect(t.documents, "doc_id", gr.content_key("text"), {"mean_chars": F.avg("n_chars")}, ["lang"]))


@query("dedup_conflicts", """
with d as (select documents.doc_id, md5(text) as content, quality from documents join labels using (doc_id))
select content, min(doc_id) as doc_id, min(quality) as quality, cast(count(*) as bigint) as copies from d group by 1 having count(distinct quality) = 1""")
def dedup_conflicts(t):
    rows = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    return gr.dedup_conflicts(rows, "doc_id", gr.content_key("text"), "quality")


@query("conflict_counts", """
with d as (select p_name as content, p_type as label from part), c as (select content, count(*) as n, count(distinct label) as k from d group by 1)
select cast(sum(n) as bigint) as rows, cast(count(*) as bigint) as contents, cast(sum(case when k > 1 then 1 else 0 end) as bigint) as conflicting,
  cast(sum(case when k = 1 then 1 else 0 end) as bigint) as kept from c""")
def conflict_counts(t):
    return gr.conflict_counts(t.part, F.col("p_name"), "p_type")


@query("collapse_duplicates", """
select l_orderkey, l_linenumber, cast(count(*) as bigint) as copies, round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 as l_extendedprice from lineitem group by 1, 2""")
def collapse_duplicates(t):
    return rounded(gr.collapse_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_extendedprice"]), 4)


@query("keep_first", """
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn = 1""")
def keep_first(t):
    return gr.keep_first(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("result_self_audit", """
with k as (select l_suppkey % 10 as a, l_partkey % 10 as b, l_returnflag as profile, l_discount >= 0.08 as sig,
   l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as ord from lineitem),
p as (select a || ':' || b as pair, profile, a = b as self, count(*) as n, sum(sig::int) as hits, arg_min(sig, ord) as sig from k group by 1, 2, 3),
tot as (select sum(n) as n_rows, sum(n - 1) as n_dup, sum(self::int) as n_self, sum(hits) as hits_raw, sum((not self)::int) as ec,
   sum((not self and sig)::int) as hc from p),
bp as (select pair, count(*) as n from p where not self and sig group by 1), bq as (select profile, count(*) as n from p where not self and sig group by 1)
select cast(n_rows as bigint) as n_rows, cast(n_dup as bigint) as n_duplicate_rows, cast(n_self as bigint) as n_self_rows, cast(hits_raw as bigint) as hits_raw,
  cast(ec as bigint) as experiments_clean, cast(hc as bigint) as hits_clean, round(100.0 * hits_raw / n_rows, 6) + 0.0 as hit_rate_raw,
  round(100.0 * hc / ec, 6) + 0.0 as hit_rate_clean, (select pair from bp order by n desc, pair limit 1) as top_pair,
  (select cast(max(n) as bigint) from bp) as top_pair_hits, (select profile from bq order by n desc, profile limit 1) as top_profile from tot""")
def result_self_audit(t):
    rows = t.lineitem.select(
        (F.col("l_suppkey") % 10).alias("a"), (F.col("l_partkey") % 10).alias("b"), F.col("l_returnflag").alias("profile"),
        (F.col("l_discount") >= 0.08).alias("sig"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return rounded(gr.result_self_audit(rows, "a", "b", "profile", "sig", "ord"))


_SIG = "s as (select l_returnflag, l_linestatus, l_suppkey % 25 as target, l_discount from lineitem)"


def _signatures(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 25).alias("target"), "l_discount")


@query("modal_target", f"""
with {_SIG}, c as (select l_returnflag, l_linestatus, target, count(*) as n, sum(l_discount) as d from s group by 1, 2, 3),
m as (select *, row_number() over (partition by l_returnflag, l_linestatus order by n desc, target) as rn from c)
select l_returnflag, l_linestatus, cast(sum(n) as bigint) as n, max(case when rn = 1 then target end) as modal_target,
  round(max(n) / sum(n), 6) + 0.0 as modal_share, round(sum(case when target = 7 then n else 0 end) / sum(n), 6) + 0.0 as target_share,
  round(sum(d) / sum(n), 6) + 0.0 as mean_delta from m group by 1, 2""")
def modal_target(t):
    return rounded(gr.modal_target(_signatures(t), ["l_returnflag", "l_linestatus"], "target", 7, "l_discount"))


@query("hub_enrichment", f"""
with {_SIG}, c as (select l_returnflag, l_linestatus, target, count(*) as n from s group by 1, 2, 3),
h as (select target, sum(n) as hub from c group by 1), tot as (select sum(n) as alln from c),
m as (select *, row_number() over (partition by l_returnflag, l_linestatus order by n desc, target) as rn, sum(n) over (partition by l_returnflag, l_linestatus) as tn from c),
e as (select l_returnflag, l_linestatus, m.target as modal_target, tn, n / tn as conc, hub / alln as hubn, (n / tn) / (hub / alln) as enr from m join h on h.target = m.target, tot where rn = 1)
select l_returnflag, l_linestatus, modal_target, cast(tn as bigint) as n, round(conc, 6) + 0.0 as concentration, round(hubn, 6) + 0.0 as hubness,
  round(enr, 6) + 0.0 as enrichment, cast(rank() over (order by enr desc) as bigint) as rank_enrichment, cast(rank() over (order by conc desc) as bigint) as rank_concentration from e""")
def hub_enrichment(t):
    return rounded(gr.hub_enrichment(_signatures(t), ["l_returnflag", "l_linestatus"], "target"))


@query("category_gap", """
with m as (select l_suppkey, l_returnflag, avg(l_quantity) as m from lineitem group by 1, 2)
select l_suppkey, round(avg(case when l_returnflag = 'R' then m end), 6) + 0.0 as focus_mean, round(avg(case when l_returnflag <> 'R' then m end), 6) + 0.0 as others_mean,
  round(avg(case when l_returnflag = 'R' then m end) - avg(case when l_returnflag <> 'R' then m end), 6) + 0.0 as gap from m group by 1""")
def category_gap(t):
    return rounded(gr.category_gap(t.lineitem, ["l_suppkey"], "l_returnflag", "l_quantity", "R"))


@query("score_geometry", f"""
with z as (select event_type, value as z from events), k as (select *, count(*) over (partition by event_type) as n,
   row_number() over (partition by event_type order by z desc) as rn, count(*) over (partition by event_type, round(z, 9)) as ties, avg(z) over (partition by event_type) as m from z)
select event_type, cast(max(n) as bigint) as n,
  {r('(avg(case when rn <= greatest(1, floor(n / 100)) then z end) - quantile_cont(z, 0.5)) / (quantile_cont(z, 0.75) - quantile_cont(z, 0.25))')} as top_separation,
  {r('sum(case when ties > 1 then 1.0 else 0 end) / max(n)')} as tie_share, {r('avg(pow(z - m, 3)) / pow(avg(pow(z - m, 2)), 1.5)')} as skew,
  {r('avg(pow(z - m, 4)) / pow(avg(pow(z - m, 2)), 2) - 3')} as excess_kurtosis,
  {r('(quantile_cont(z, 0.75) - quantile_cont(z, 0.25)) / (max(z) - min(z))')} as iqr_over_range from k group by 1""")
def score_geometry(t):
    return rounded(gr.score_geometry(t.events, "value", ["event_type"]))


@query("otsu_split", """
with e as (select event_type, min(value) as lo, max(value) as hi, count(*) as n from events group by 1),
b as (select v.event_type, lo, hi, n, value, least(floor((value - lo) / ((hi - lo) / 256)) + 1, 256) as b from events v join e on e.event_type = v.event_type),
h as (select event_type, b, lo + (b - 0.5) * ((hi - lo) / 256) as c, count(*) / max(n) as w from b group by event_type, b, lo, hi),
u as (select event_type, b, c, sum(w) over (partition by event_type order by b) as w0, sum(w * c) over (partition by event_type order by b) as m0,
  sum(w * c) over (partition by event_type) as mt from h),
v as (select *, case when w0 * (1 - w0) > 1e-12 then pow(mt * w0 - m0, 2) / (w0 * (1 - w0)) else -1 end as v from u),
p as (select event_type, c as threshold from (select *, row_number() over (partition by event_type order by round(v, 12) desc, b) as rn from v) where rn = 1)
select events.event_type, round(max(threshold), 6) + 0.0 as threshold, cast(count(*) as bigint) as n, round(avg(case when value < threshold then 1.0 else 0 end), 6) + 0.0 as share_below
from events join p on p.event_type = events.event_type group by 1""")
def otsu_split(t):
    return rounded(gr.otsu_split(t.events, "value", ["event_type"]))


_NATION = """u as (select c_nationkey, avg(c_acctbal) as bulk, avg(o_totalprice) / 1000 as util, count(*) as n, stddev_pop(o_totalprice) / 1000 as cand,
   max(case when n_regionkey in (0, 1) then 1 else 0 end) as side from customer join orders on o_custkey = c_custkey join nation on n_nationkey = c_nationkey group by 1)"""


def _nations(t):
    rows = t.orders.select("o_custkey", "o_totalprice").join(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.nation.select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("c_nationkey").agg(
        F.avg("c_acctbal").alias("bulk"), (F.avg("o_totalprice") / 1000).alias("util"), F.count(F.lit(1)).alias("n"),
        (F.stddev_pop("o_totalprice") / 1000).alias("cand"), F.max(F.when(F.col("n_regionkey").isin(0, 1), 1).otherwise(0)).alias("side"))


@query("trend_residual", f"""
with {_NATION}, f as (select regr_slope(util, bulk) as s, regr_intercept(util, bulk) as i from u where side = 1)
select c_nationkey, {r('util - (s * bulk + i)')} as residual from u, f""")
def trend_residual(t):
    return rounded(gr.trend_residual(_nations(t), "bulk", "util", fit_on=F.col("side") == 1).select("c_nationkey", "residual"))


@query("explain_gap", f"""
with {_NATION}, f as (select regr_slope(util, bulk) as s, regr_intercept(util, bulk) as i from u),
w as (select u.*, util - (s * bulk + i) as res from u, f),
m as (select avg(bulk) as mb, avg(cand) as mc, avg(util) as mu, var_pop(bulk) as vb, var_pop(cand) as vc, covar_pop(bulk, cand) as bc, covar_pop(bulk, util) as bu, covar_pop(cand, util) as cu from u),
k as (select *, (bu * vc - cu * bc) / (vb * vc - bc * bc) as kb, (cu * vb - bu * bc) / (vb * vc - bc * bc) as kc from m),
x as (select w.*, util - mu - kb * (bulk - mb) - kc * (cand - mc) as left_over, {arank('cand')} as ra, {arank('res')} as rb,
   {arank('cand', 'side')} as sa, {arank('res', 'side')} as sb from w, k),
s as (select side, {scorr('sa', 'sb')} as rho from x group by 1)
select cast(count(*) as bigint) as n, {r(scorr('ra', 'rb'))} as rho, {r('avg(case when side = 1 then res end) - avg(case when side = 0 then res end)')} as gap_before,
  {r('avg(case when side = 1 then left_over end) - avg(case when side = 0 then left_over end)')} as gap_after,
  {r('stddev_pop(case when side = 1 then cand end)')} as spread_1, {r('stddev_pop(case when side = 0 then cand end)')} as spread_0,
  {r('(select rho from s where side = 1)')} as rho_1, {r('(select rho from s where side = 0)')} as rho_0 from x""")
def explain_gap(t):
    return rounded(gr.explain_gap(_nations(t), "bulk", "util", "cand", "side"))


@query("scaling_trend", """
with s as (select c_nationkey, count(*) as size, avg(c_acctbal) as metric from customer group by 1)
select cast(count(*) as bigint) as points, round(regr_slope(metric, log10(size)), 4) + 0.0 as slope, round(regr_intercept(metric, log10(size)), 4) + 0.0 as intercept,
  round(arg_max(metric, size * 100 - c_nationkey), 4) + 0.0 as actual_at_largest, max(size) as largest,
  round(regr_intercept(metric, log10(size)) + regr_slope(metric, log10(size)) * log10(100000.0), 4) + 0.0 as extrapolated from s""")
def scaling_trend(t):
    sizes = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("metric"))
    sized = sizes.withColumn("size", F.struct("n", -F.col("c_nationkey")))
    out = gr.scaling_trend(sized.select("metric", F.col("n").alias("size")), "size", "metric", 100000.0)
    best = sized.agg(F.max_by("metric", "size").alias("actual_at_largest"))
    from touchstone.operators.running import with_scalars

    return rounded(with_scalars(out.drop("actual_at_largest"), best), 4)


@query("sampling_profile", """
with m as (select l_linestatus, l_suppkey as pos, l_returnflag as wt, substr(o_orderpriority, 1, 1) as mut from lineitem join orders on o_orderkey = l_orderkey),
c as (select l_linestatus, pos, count(*) as c from m group by 1, 2),
k as (select *, sum(c) over (partition by l_linestatus order by c, pos rows unbounded preceding) as cum from c),
g as (select l_linestatus, count(*) as np, max(c) as top, sum(cum) as scum, sum(c) as total from k group by 1)
select m.l_linestatus, cast(count(*) as bigint) as n, cast(max(np) as bigint) as n_positions, round(avg(case when mut = '1' then 1.0 else 0 end), 6) + 0.0 as share_to,
  round(avg(case when wt = '1' then 1.0 else 0 end), 6) + 0.0 as share_from, round(max(top) / count(*), 6) + 0.0 as top_position_share,
  round((max(np) + 1 - 2.0 * max(scum) / max(total)) / max(np), 6) + 0.0 as gini, round(count(*) / max(np), 6) + 0.0 as per_position, cast(count(distinct mut) as bigint) as distinct_letters
from m join g on g.l_linestatus = m.l_linestatus group by 1""")
def sampling_profile(t):
    rows = t.order_lines("l_linestatus", "l_suppkey", "l_returnflag", "o_orderpriority").withColumn("mut", F.substring("o_orderpriority", 1, 1))
    return rounded(gr.sampling_profile(rows, ["l_linestatus"], "l_suppkey", "l_returnflag", "mut", "1"))


@query("two_grain_summary", f"""
with u as (select c_custkey, c_nationkey, avg(o_totalprice - 250000) as u from customer join orders on o_custkey = c_custkey group by 1, 2),
c as (select c_nationkey, avg(u) as u from u group by 1),
a as (select 'unit' as grain, u from u union all select 'cluster', u from c),
s as (select grain, count(*) as n, avg(u) as mean, stddev_samp(u) / sqrt(count(*)) as se, sum(case when u > 0 then 1 else 0 end) as pos from a group by 1),
w as (select *, {t_quantile(0.975, '(n - 1.0)')} as tc from s)
select grain, cast(n as bigint) as n, round(mean, 4) + 0.0 as mean, cast(pos as bigint) as positive, round(se, 4) + 0.0 as se, round(mean - tc * se, 4) + 0.0 as lo, round(mean + tc * se, 4) + 0.0 as hi from w""")
def two_grain_summary(t):
    orders = t.orders.select("o_custkey", (F.col("o_totalprice") - 250000).alias("v"))
    rows = orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(gr.two_grain_summary(rows, "v", ["c_custkey"], "c_nationkey"), 4)


@query("category_breakdown", """
select p_type, cast(count(*) as bigint) as n, round(avg(p_retailprice), 4) + 0.0 as mean, cast(sum(case when p_retailprice < 950 then 1 else 0 end) as bigint) as below,
  round(quantile_cont(p_retailprice, 0.5), 4) + 0.0 as median from part group by 1""")
def category_breakdown(t):
    return rounded(gr.category_breakdown(t.part, ["p_type"], "p_retailprice", 950.0), 4)


_NOISE = """o as (select o_orderpriority, o_orderkey, o_totalprice / 1e5 as pub, c_acctbal / 1e4 as le, (o_custkey % 97) / 100.0 as diff, cast(o_orderkey % 50 as double) as depth
    from orders join customer on c_custkey = o_custkey),
  x as (select *, case when depth > 0 then abs(diff) / sqrt(2.0) end as y, case when depth > 0 then 1 / sqrt(depth) end as xx from o),
  f as (select o_orderpriority, abs(regr_slope(pub, le)) as unit, regr_slope(y, xx) as b, regr_intercept(y, xx) as a, quantile_cont(y, 0.99) as cap, quantile_cont(y, 0.5) as mid from x group by 1)"""


@query("noise_model", f"""
with {_NOISE} select x.o_orderpriority, o_orderkey, {r('least(greatest(coalesce(a + b * xx, mid), 1e-3), cap) * unit')} as noise_sd from x join f on f.o_orderpriority = x.o_orderpriority""")
def noise_model(t):
    rows = t.orders.join(t.customer.select("c_custkey", "c_acctbal"), F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderpriority", "o_orderkey", (F.col("o_totalprice") / 1e5).alias("pub"), (F.col("c_acctbal") / 1e4).alias("le"),
        ((F.col("o_custkey") % 97) / 100.0).alias("diff"), (F.col("o_orderkey") % 50).cast("double").alias("depth"))
    return rounded(gr.noise_model(rows, ["o_orderpriority"], "pub", "le", "diff", "depth", "o_orderkey"))


@query("log_enrichment", """
select l_suppkey, round(ln((sum(case when l_linestatus = 'F' then l_quantity else 0 end) + 1e-7) / (sum(case when l_linestatus = 'O' then l_quantity else 0 end) + 1e-7)), 6) + 0.0 as enrichment,
  round(1.9872041e-3 * 298.15 * ln(sum(l_extendedprice) / sum(l_quantity)), 6) + 0.0 as ddg from lineitem group by 1""")
def log_enrichment_query(t):
    sums = t.lineitem.groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)).alias("f"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)).alias("o"),
        F.sum("l_extendedprice").cast("string").alias("mutant"), F.sum("l_quantity").cast("string").alias("wild"))
    return rounded(sums.select("l_suppkey", log_enrichment("o", "f").alias("enrichment"), ddg("mutant", "wild").alias("ddg")))


@query("reproduction_check", """
with a as (select o_orderkey, round(o_totalprice, 0) as v from orders where o_orderstatus <> 'P'), b as (select o_orderkey, o_totalprice as v from orders where o_orderpriority <> '5-LOW')
select cast(count(a.v + b.v) as bigint) as matched, cast(sum(case when b.o_orderkey is null then 1 else 0 end) as bigint) as only_a,
  cast(sum(case when a.o_orderkey is null then 1 else 0 end) as bigint) as only_b, round(max(abs(a.v - b.v)), 6) + 0.0 as max_abs_diff,
  cast(sum(case when abs(a.v - b.v) > 0.25 then 1 else 0 end) as bigint) as differ from a full join b on a.o_orderkey = b.o_orderkey""")
def reproduction_check(t):
    a = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", F.round("o_totalprice", 0).alias("v"))
    b = t.orders.filter("o_orderpriority <> '5-LOW'").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return rounded(gr.reproduction_check(a, b, ["o_orderkey"], "v", 0.25))


@query("level_agreement", f"""
with k as (select l_returnflag, l_quantity / 50 as a, l_extendedprice / 100000 as b, {arank('l_quantity', 'l_returnflag')} as ra, {arank('l_extendedprice', 'l_returnflag')} as rb from lineitem)
select l_returnflag, cast(count(*) as bigint) as n, {r(scorr('ra', 'rb'))} as rho, {r('avg(abs(a - b))')} as mean_abs_diff from k group by 1""")
def level_agreement(t):
    rows = t.lineitem.select("l_returnflag", (F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 100000).alias("b"))
    return rounded(gr.level_agreement(rows, "a", "b", ["l_returnflag"]))


@query("attenuation_ceiling", f"""
with i as (select p_type, p_brand, stddev_samp(p_size) as w from part group by 1, 2), w as (select p_type, avg(w) as w from i group by 1), b as (select p_type, stddev_samp(p_size) as b from part group by 1)
select w.p_type, {r('w')} as within_sd, {r('b')} as between_sd, {r('sqrt(greatest(b * b - w * w, 0)) / b')} as ceiling from w join b on b.p_type = w.p_type""")
def attenuation_ceiling(t):
    return rounded(gr.attenuation_ceiling(t.part, "p_size", ["p_brand"], ["p_type"]))


@query("draw_variance", """
with m as (select l_returnflag, l_linenumber, avg(l_discount) as m from lineitem group by 1, 2)
select l_returnflag, cast(count(*) as bigint) as seeds, round(avg(m), 8) + 0.0 as mean, round(stddev_samp(m), 8) + 0.0 as seed_sd, round(max(m) - min(m), 8) + 0.0 as seed_range from m group by 1""")
def draw_variance(t):
    return rounded(gr.draw_variance(t.lineitem, ["l_returnflag"], "l_linenumber", "l_discount"), 8)


@query("partner_margins", """
with o as (select l_suppkey, l_returnflag as p, l_linenumber as k, avg(l_quantity) as v from lineitem group by 1, 2, 3)
select a.l_suppkey, a.p as a, b.p as b, cast(count(*) as bigint) as shared, round(avg(b.v - a.v), 6) + 0.0 as mean_margin,
  round(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 6) + 0.0 as corr
from o a join o b on a.l_suppkey = b.l_suppkey and a.k = b.k and a.p < b.p group by 1, 2, 3 having count(*) >= 3""")
def partner_margins(t):
    return rounded(gr.partner_margins(t.lineitem, ["l_suppkey"], "l_returnflag", "l_linenumber", "l_quantity"))


@query("present_everywhere", """
select l_partkey from (select distinct l_partkey, l_linestatus || l_returnflag as p from lineitem) group by 1 having count(*) = (select count(distinct l_linestatus || l_returnflag) from lineitem)""")
def present_everywhere(t):
    return gr.present_everywhere(t.lineitem.select("l_partkey", F.concat("l_linestatus", "l_returnflag").alias("p")), "l_partkey", "p")


@query("baseline_pairing", """
with m as (select l_suppkey, l_returnflag, avg(l_quantity) as v from lineitem group by 1, 2)
select m.l_suppkey, m.l_returnflag, round(m.v, 6) + 0.0 as v, round(b.v, 6) + 0.0 as baseline_value, round(m.v - b.v, 6) + 0.0 as delta
from m join m b on b.l_suppkey = m.l_suppkey and b.l_returnflag = 'A' where m.l_returnflag <> 'A'""")
def baseline_pairing(t):
    means = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    return rounded(gr.baseline_pairing(means, ["l_suppkey"], "l_returnflag", "A", "v"))


@query("fallback_lookup", """
with s as (select o_custkey, max(o_totalprice) as best from orders where o_orderpriority = '1-URGENT' group by 1), g as (select max(o_totalprice) as best from orders)
select c_custkey, coalesce(s.best, (select best from g)) as best from customer left join s on o_custkey = c_custkey""")
def fallback_lookup(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    return gr.fallback_lookup(t.customer.select("c_custkey"), "c_custkey", urgent, t.orders.agg(F.max("o_totalprice").alias("best")), "best")


@query("histogram_match", """
with p as (select doc_id, floor(n_chars / 500.0) as bin, case when lang = 'en' then 0 else 1 end as side,
    cast(('0x' || substr(md5('3|' || doc_id), 1, 15)) as bigint) as h from documents),
s as (select bin, least(sum(case when side = 0 then 1 else 0 end), sum(case when side = 1 then 1 else 0 end)) as m from p group by 1),
k as (select *, row_number() over (partition by bin, side order by h, doc_id) as rn from p)
select doc_id, side, cast(k.bin as bigint) as bin from k join s on s.bin = k.bin where rn <= m""")
def histogram_match(t):
    rows = t.documents.select("doc_id", F.when(F.col("lang") == "en", 0).otherwise(1).alias("side"), "n_chars")
    return gr.histogram_match(rows, "side", "n_chars", 500.0, "doc_id", 3).select("doc_id", "side", "bin")


# ---- tests

_SIDE = "s as (select l_suppkey, l_discount, l_quantity, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem)"


def _sides(t):
    return t.lineitem.select("l_suppkey", "l_discount", "l_quantity", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


_WELCH = f"""{_SIDE}, m as (select l_suppkey, count(*) filter (y = 1) as n1, avg(l_discount) filter (y = 1) as m1, var_samp(l_discount) filter (y = 1) / count(*) filter (y = 1) as e1,
    count(*) filter (y = 0) as n0, avg(l_discount) filter (y = 0) as m0, var_samp(l_discount) filter (y = 0) / count(*) filter (y = 0) as e0 from s group by 1),
  w as (select *, (m1 - m0) / sqrt(e1 + e0) as tt, pow(e1 + e0, 2) / (e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1)) as df from m)"""


@query("welch_t", f"""
with {_WELCH} select l_suppkey, cast(n1 as bigint) as n1, {r('m1')} as mean1, cast(n0 as bigint) as n0, {r('m0')} as mean0, {r('tt')} as t, {r('df', 5)} as df, {r(t_p('tt', 'df'), 5)} as p from w""")
def welch_t(t):
    out = hy.welch_t(_sides(t), "l_discount", "y", ["l_suppkey"])
    return rounded(out.withColumn("df", F.round("df", 5)).withColumn("p", F.round("p", 5)))


_MW = f"""{_SIDE}, k as (select l_suppkey, y, {arank('l_quantity', 'l_suppkey')} as rk, count(*) over (partition by l_suppkey, l_quantity) as ties from s),
  u as (select l_suppkey, sum(y) * 1.0 as n1, sum(1 - y) * 1.0 as n0, sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0 as u, sum(ties * ties - 1.0) as tsum from k group by 1),
  z as (select *, (abs(u - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - tsum / ((n1 + n0) * (n1 + n0 - 1)))) as z from u)"""


@query("mann_whitney", f"""
with {_MW} select l_suppkey, cast(n1 as bigint) as n1, cast(n0 as bigint) as n0, {r('u')} as u, {r('z')} as z, {r('least(1.0, 2 * ' + normal_sf('z') + ')', 5)} as p from z""")
def mann_whitney(t):
    out = hy.mann_whitney(_sides(t), "l_quantity", "y", ["l_suppkey"])
    return rounded(out.withColumn("p", F.round("p", 5)))


@query("wilcoxon_signed", f"""
with m as (select l_suppkey, l_linenumber, round(avg(case when l_returnflag = 'A' then l_quantity end) - avg(case when l_returnflag = 'R' then l_quantity end), 9) as d from lineitem group by 1, 2),
k as (select l_linenumber, d, {arank('abs(d)', 'l_linenumber')} as rk, count(*) over (partition by l_linenumber, abs(d)) as ties from m where d <> 0 and d is not null),
w as (select l_linenumber, count(*) as n, sum(case when d > 0 then rk else 0 end) as wp, sum(case when d < 0 then rk else 0 end) as wm, sum(ties * ties - 1.0) as tsum from k group by 1),
z as (select *, (least(wp, wm) - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2.0 * n + 1) - tsum / 2) / 24) as z from w)
select l_linenumber, cast(n as bigint) as n, {r('wp')} as w_plus, {r('wm')} as w_minus, {r('z')} as z, 'normal' as method, {r('2 * ' + normal_sf('abs(z)'), 5)} as p from z""")
def wilcoxon_signed(t):
    means = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.round(
        F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))) - F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), 9).alias("d"))
    out = hy.wilcoxon_signed(means, "d", ["l_linenumber"])
    return rounded(out.withColumn("p", F.round("p", 5)))


@query("wilcoxon_exact", f"""
with m as (select o_orderpriority as g, month(o_orderdate) as k, round(avg(case when o_orderstatus = 'F' then o_totalprice end) - avg(case when o_orderstatus = 'O' then o_totalprice end), -4) as d from orders group by 1, 2),
x as (select g, d, {arank('abs(d)', 'g')} as rk, row_number() over (partition by g order by k) as i from m where d <> 0 and d is not null),
w as (select g, count(*) as n, coalesce(sum(rk) filter (d > 0), 0) as wp, coalesce(sum(rk) filter (d < 0), 0) as wm from x group by 1),
s as (select x.g, b, sum(case when (b >> (i - 1)) % 2 = 1 then rk else 0 end) as t from x join w on w.g = x.g, (select unnest(range(4096)) as b) where b < (1 << n) group by 1, 2),
p as (select s.g, least(1.0, 2 * avg(case when t <= least(wp, wm) then 1.0 else 0 end)) as p from s join w on w.g = s.g group by 1)
select w.g as priority, cast(n as bigint) as n, {r('wp')} as w_plus, {r('wm')} as w_minus, 'exact' as method, {r('p')} as p from w join p on p.g = w.g""")
def wilcoxon_exact(t):
    """Months of the year as units: twelve signs at most, ties by rounding."""
    side = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    means = t.orders.groupBy(F.col("o_orderpriority").alias("priority"), F.month("o_orderdate").alias("k")).agg(F.round(side("F") - side("O"), -4).alias("d"))
    return rounded(hy.wilcoxon_signed(means, "d", ["priority"], "exact").drop("z"))


@query("sign_test", f"""
with m as (select l_suppkey, l_linenumber, round(avg(case when l_returnflag = 'A' then l_quantity end) - avg(case when l_returnflag = 'R' then l_quantity end), 9) as d from lineitem group by 1, 2),
c as (select l_linenumber, count(*) as n, sum(case when d > 0 then 1 else 0 end) as k, sum(case when d = 0 then 1 else 0 end) as ties from m where d is not null group by 1)
select l_linenumber, cast(n as bigint) as n, cast(k as bigint) as positive, cast(ties as bigint) as ties, {r(binom_p('k', '(n - ties)'))} as p from c""")
def sign_test(t):
    means = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.round(
        F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))) - F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), 9).alias("d"))
    return rounded(hy.sign_test(means, "d", ["l_linenumber"]))


@query("paired_t", f"""
with d as (select o_orderpriority, o_totalprice - 250000 as d from orders), m as (select o_orderpriority, count(*) as n, avg(d) as mean, stddev_samp(d) / sqrt(count(*)) as se from d group by 1),
w as (select *, mean / se as tt, n - 1.0 as df from m)
select o_orderpriority, cast(n as bigint) as n, {r('mean', 4)} as mean, {r('se', 4)} as se, {r('tt', 4)} as t, {r(t_p('tt', 'df'), 4)} as p from w""")
def paired_t(t):
    return rounded(hy.paired_t(t.orders.select("o_orderpriority", (F.col("o_totalprice") - 250000).alias("d")), "d", ["o_orderpriority"]), 4)


@query("fisher_exact", f"""
with f as (select source, case when n_chars > 1000 then 1 else 0 end as x, quality as y from documents join labels using (doc_id)),
c as (select source, sum(x * y) as a, sum(x * (1 - y)) as b, sum((1 - x) * y) as c, sum((1 - x) * (1 - y)) as d from f group by 1),
e as (select *, a + b as r1, a + c as c1, a + b + c + d as n from c),
k as (select e.*, unnest(range(cast(greatest(0, r1 + c1 - n) as bigint), cast(least(r1, c1) + 1 as bigint))) as k from e),
p as (select *, exp(lgamma(r1 + 1) - lgamma(k + 1) - lgamma(r1 - k + 1) + lgamma(n - r1 + 1) - lgamma(c1 - k + 1) - lgamma(n - r1 - c1 + k + 1) - (lgamma(n + 1) - lgamma(c1 + 1) - lgamma(n - c1 + 1))) as p from k),
o as (select source, max(case when k = a then p end) as po from p group by 1)
select p.source, cast(max(a) as bigint) as a, cast(max(b) as bigint) as b, cast(max(c) as bigint) as c, cast(max(d) as bigint) as d,
  {r('max(a) * max(d) / nullif(max(b) * max(c), 0)')} as odds_ratio, {r('least(1.0, sum(case when p <= po * (1 + 1e-7) then p else 0 end))')} as p from p join o on o.source = p.source group by 1""")
def fisher_exact(t):
    rows = t.labelled_documents().select("source", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("x"), "quality")
    return rounded(hy.fisher_exact(rows, "x", "quality", ["source"]))


@query("adjust_pvalues", f"""
with {_WELCH}, p as (select l_suppkey, {t_p('tt', 'df')} as p from w), k as (select *, row_number() over (order by p, l_suppkey) as rk, count(*) over () as m from p),
a as (select l_suppkey, p, m, min(p * m / rk) over (order by p desc, l_suppkey desc rows unbounded preceding) as adj from k)
select l_suppkey, {r('p', 5)} as p, {r('least(1.0, adj)', 5)} as p_fdr, {r('least(1.0, p * m)', 4)} as p_bonf from a""")
def adjust_pvalues(t):
    ps = hy.welch_t(_sides(t), "l_discount", "y", ["l_suppkey"]).select("l_suppkey", "p")
    out = hy.adjust_pvalues(ps, "p", ["l_suppkey"])
    return rounded(out.withColumn("p_bonf", F.round("p_bonf", 4)), 5)


@query("distance_shift_test", f"""
with {_SIDE}, g as (select l_suppkey % 5 as pair, y, l_quantity, l_discount, l_suppkey % 2 as profile from s),
m as (select pair, profile, count(*) filter (y = 1) as n1, avg(l_discount) filter (y = 1) as m1, var_samp(l_discount) filter (y = 1) / count(*) filter (y = 1) as e1,
    count(*) filter (y = 0) as n0, avg(l_discount) filter (y = 0) as m0, var_samp(l_discount) filter (y = 0) / count(*) filter (y = 0) as e0 from g group by 1, 2),
w as (select *, (m1 - m0) / sqrt(e1 + e0) as tt, pow(e1 + e0, 2) / (e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1)) as df from m),
k as (select pair, profile, y, {arank('l_discount', 'pair, profile')} as rk, count(*) over (partition by pair, profile, l_discount) as ties from g),
u as (select pair, profile, sum(y) * 1.0 as n1, sum(1 - y) * 1.0 as n0, sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0 as u, sum(ties * ties - 1.0) as tsum from k group by 1, 2),
z as (select *, (n1 * n0 / 2 - u - 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - tsum / ((n1 + n0) * (n1 + n0 - 1)))) as z from u)
select w.pair, w.profile, {r('m1')} as mean_treat, {r('m0')} as mean_null, {r(t_p('tt', 'df'), 4)} as t_p, {r(normal_sf('z'), 4)} as u_p,
  {t_p('tt', 'df')} < 0.05 and {normal_sf('z')} < 0.05 and m1 < m0 as significant_raw from w join z on z.pair = w.pair and z.profile = w.profile""")
def distance_shift_test(t):
    rows = _sides(t).withColumn("pair", F.col("l_suppkey") % 5).withColumn("profile", F.col("l_suppkey") % 2)
    out = hy.distance_shift(rows, "pair", "profile", "l_discount", "y", "l_suppkey")
    return rounded(out.withColumn("t_p", F.round("t_p", 4)).withColumn("u_p", F.round("u_p", 4)))


@query("minimum_detectable_effect", f"""
with d as (select l_suppkey, l_discount - 0.05 as d from lineitem), m as (select l_suppkey, count(*) as n, avg(d) as mean, stddev_samp(d) / sqrt(count(*)) as se from d group by 1),
w as (select *, {t_quantile(0.975, '(n - 1.0)')} as tx, {t_quantile(0.8, '(n - 1.0)')} as ty from m)
select l_suppkey, cast(n as bigint) as n, round(mean, 6) + 0.0 as mean, round(se, 6) + 0.0 as se, round(mean - tx * se, 6) + 0.0 as ci_lo, round(mean + tx * se, 6) + 0.0 as ci_hi, round((tx + ty) * se, 6) + 0.0 as mde from w""")
def minimum_detectable_effect(t):
    rows = t.lineitem.select("l_suppkey", (F.col("l_discount") - 0.05).alias("d"))
    return rounded(hy.detectable_effect(hy.paired_interval(rows, "d", ["l_suppkey"])))


@query("quantile_bins_effect", f"""
with d as (select o_orderkey, o_orderpriority, abs(c_acctbal / 1e4 - o_totalprice / 5e5) as gap, c_acctbal / 1e4 - o_totalprice / 5e5 as effect from orders join customer on c_custkey = o_custkey),
q as (select quantile_cont(gap, [0, 0.25, 0.5, 0.75, 1.0]) as q from d),
b as (select b, effect from d, q, (select unnest([1, 2, 3, 4]) as b) where q[b] < q[b + 1] and gap >= q[b] and (gap < q[b + 1] or (b = 4 and gap <= q[5]))),
k as (select b, effect, {arank('abs(effect)', 'b')} as rk from b where effect <> 0)
select cast(b as int) as bin, cast(count(*) as bigint) as n, {r('avg(effect)')} as mean_effect, {r('sum(case when effect > 0 then rk else 0 end)', 2)} as w_plus from k group by 1""")
def quantile_bins_effect(t):
    from touchstone.operators.binning import quantile_bin_effects

    rows = t.orders.join(t.customer.select("c_custkey", "c_acctbal"), F.col("c_custkey") == F.col("o_custkey"))
    effect = F.col("c_acctbal") / 1e4 - F.col("o_totalprice") / 5e5
    out = quantile_bin_effects(rows.select(F.abs(effect).alias("gap"), effect.alias("effect")), "gap", "effect", 4)
    return rounded(out.select("bin", "n", "mean_effect", F.round("w_plus", 2).alias("w_plus")))


@query("set_intersection", """
select o_custkey from orders where o_orderpriority = '1-URGENT' intersect select o_custkey from orders where o_orderpriority = '5-LOW'""")
def set_intersection(t):
    of = lambda p: t.orders.filter(F.col("o_orderpriority") == p).select("o_custkey")
    return of("1-URGENT").intersect(of("5-LOW"))


@query("multiset_difference", """
select o_custkey from orders where o_orderpriority = '1-URGENT' except all select o_custkey from orders where o_orderpriority = '5-LOW'""")
def multiset_difference(t):
    of = lambda p: t.orders.filter(F.col("o_orderpriority") == p).select("o_custkey")
    return of("1-URGENT").exceptAll(of("5-LOW"))

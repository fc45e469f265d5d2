"""The audit, linear models, planning and batch selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchstone.operators import linear as ln
from touchstone.plans import planner as pl
from touchstone.plans import selection as se
from touchstone.plans.registry import arank, drawn, query, r, rounded, scorr

_AUDIT = f"""
with base as (select o_orderpriority, l_extendedprice, l_quantity, l_discount, o_totalprice as y, l_linenumber as z from lineitem join orders on o_orderkey = l_orderkey),
lg as (select o_orderpriority, y, z, 'l_extendedprice' as score_name, l_extendedprice as s from base union all select o_orderpriority, y, z, 'l_quantity', l_quantity from base
  union all select o_orderpriority, y, z, 'l_discount', l_discount from base),
rk as (select *, {arank('s', 'o_orderpriority, score_name')} as rs, {arank('y', 'o_orderpriority, score_name')} as ry, {arank('z', 'o_orderpriority, score_name')} as rz,
   {arank('s', 'o_orderpriority, score_name, z')} as is_, {arank('y', 'o_orderpriority, score_name, z')} as iy from lg),
w as (select o_orderpriority, score_name, count(*) as n, {scorr('rs', 'ry')} as xy, {scorr('rs', 'rz')} as xz, {scorr('ry', 'rz')} as yz from rk group by 1, 2),
st as (select o_orderpriority, score_name, z, count(*) as n, {scorr('is_', 'iy')} as rho from rk group by 1, 2, 3 having count(*) >= 5),
sm as (select o_orderpriority, score_name, count(*) as strata, avg(rho) as within_rho from st group by 1, 2),
bs as (select o_orderpriority, score_name as b, xy as v from (select *, row_number() over (partition by o_orderpriority order by abs(xy) desc, score_name desc) as i from w where score_name in ('l_quantity', 'l_discount')) where i = 1)
select w.o_orderpriority, w.score_name, cast(n as bigint) as n, {r('xy')} as rho, {r('xz')} as rho_nuisance, {r('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))')} as partial_rho,
  cast(strata as bigint) as strata, {r('within_rho')} as within_rho, sign(within_rho) <> sign(xy) as sign_flip,
  case when w.score_name = 'l_extendedprice' then b end as best_baseline, case when w.score_name = 'l_extendedprice' then {r('abs(xy) - abs(v)')} end as margin,
  abs(xz) >= 0.3 as confounded, abs(xz) >= 0.7 as is_nuisance
from w join sm on sm.o_orderpriority = w.o_orderpriority and sm.score_name = w.score_name join bs on bs.o_orderpriority = w.o_orderpriority"""


@query("score_audit", _AUDIT)
def score_audit(t):
    rows = t.order_lines("o_orderpriority", "l_extendedprice", "l_quantity", "l_discount", "l_linenumber", "o_totalprice")
    cols = pl.AuditColumns("l_orderkey", "o_totalprice", ["l_extendedprice"], ["l_quantity", "l_discount"], "l_linenumber", ["o_orderpriority"])
    return rounded(pl.audit(rows, cols))


# ---- least squares.  One feature has a closed form in SQL: slope = Sxy / (Sxx + lambda).

_R1 = """f as (select l_returnflag, regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + {lam}) as b,
   avg(l_extendedprice) as my, avg(l_quantity) as mx, count(*) as n, regr_sxx(l_extendedprice, l_quantity) as sxx from lineitem group by 1)"""


@query("ridge_by_group", f"""
with {_R1.format(lam='5.0')}, p as (select l.l_returnflag, l_extendedprice - (my + b * (l_quantity - mx)) as e from lineitem l join f on f.l_returnflag = l.l_returnflag)
select l_returnflag, cast(count(*) as bigint) as n, {r('sqrt(avg(e * e))', 4)} as rmse, {r('max(abs(e))', 4)} as worst from p group by 1""")
def ridge_by_group(t):
    rows = ln.ridge_by_group(t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice", ["l_returnflag"], 5.0)
    e = F.col("l_extendedprice") - F.col("prediction")
    return rounded(rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("worst")), 4)


@query("loo_ridge", f"""
with s as (select c_nationkey, c_custkey, c_acctbal as y, c_custkey / 1000.0 as x from customer), f as (select c_nationkey, regr_sxy(y, x) / (regr_sxx(y, x) + 1.0) as b, avg(y) as my, avg(x) as mx, count(*) as n, regr_sxx(y, x) as sxx from s group by 1)
select s.c_custkey, {r('y - (y - (my + b * (x - mx))) / greatest(1 - (1.0 / n + pow(x - mx, 2) / (sxx + 1.0)), 1e-6)', 4)} as loo from s join f on f.c_nationkey = s.c_nationkey where n >= 3""")
def loo_ridge(t):
    rows = t.customer.select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("y"), (F.col("c_custkey") / 1000.0).alias("x"))
    return rounded(ln.loo_ridge(rows, ["x"], "y", ["c_nationkey"], 1.0).select("c_custkey", "loo"), 4)


@query("ols_leave_corpus_out", f"""
with s as (select p_type, p_partkey, p_retailprice as y, p_size * 1.0 as x from part), tot as (select count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from s),
c as (select p_type, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from s group by 1),
d as (select p_type, t.n - c.n as n, t.sx - c.sx as sx, t.sy - c.sy as sy, t.sxx - c.sxx as sxx, t.sxy - c.sxy as sxy from c, tot t),
f as (select p_type, (sxy - sx * sy / n) / (sxx - sx * sx / n) as b, sy / n as my, sx / n as mx from d)
select s.p_type, cast(count(*) as bigint) as n, {r('avg(my + b * (x - mx))', 5)} as mean_prediction, {r('sqrt(avg(pow(y - (my + b * (x - mx)), 2)))', 5)} as rmse from s join f on f.p_type = s.p_type group by 1""")
def ols_leave_corpus_out(t):
    rows = t.part.select("p_type", "p_partkey", F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"))
    out = ln.out_of_fold(rows, ["x"], "y", "p_type", lam=0.0)
    return rounded(out.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("oof").alias("mean_prediction"), F.sqrt(F.avg((F.col("y") - F.col("oof")) ** 2)).alias("rmse")), 5)


@query("kfold_oof", f"""
with s as (select o_orderpriority as g, o_orderkey as k, o_totalprice / 1000 as y, o_custkey * 1.0 as x, {drawn(0, 'o_orderkey')} % 5 as fold from orders),
c as (select g, fold, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from s group by 1, 2), tot as (select g, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from c group by 1),
d as (select c.g, fold, t.n - c.n as n, t.sx - c.sx as sx, t.sy - c.sy as sy, t.sxx - c.sxx as sxx, t.sxy - c.sxy as sxy from c join tot t on t.g = c.g),
f as (select g, fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1.0) as b, sy / n as my, sx / n as mx from d)
select s.g, cast(s.fold as int) as fold, cast(count(*) as bigint) as n, {r('avg(my + b * (x - mx))', 5)} as mean_prediction, {r('avg(abs(y - (my + b * (x - mx))))', 5)} as mae from s join f on f.g = s.g and f.fold = s.fold group by 1, 2""")
def kfold_oof(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("y"), F.col("o_custkey").cast("double").alias("x"))
    out = ln.out_of_fold(rows.withColumn("fold", ln.fold_random("k", 5)), ["x"], "y", "fold", ["g"], 1.0)
    return rounded(out.groupBy("g", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("oof").alias("mean_prediction"), F.avg(F.abs(F.col("y") - F.col("oof"))).alias("mae")), 5)


@query("fold_schemes", f"""
with p as (select distinct p_size from part), i as (select p_size, row_number() over (order by p_size) as rn from p),
b as (select p_size, cast(ntile(7) over (order by p_size) - 1 as int) as block_fold from p)
select part.p_partkey, cast(part.p_size % 5 as int) as modulo_fold, block_fold, cast({drawn(0, 'p_partkey')} % 5 as int) as random_fold from part join b on b.p_size = part.p_size""")
def fold_schemes(t):
    rows = ln.fold_blocks(t.part.select("p_partkey", "p_size"), "p_size", 7, "block_fold")
    return rows.select("p_partkey", ln.fold_modulo("p_size", 5).alias("modulo_fold"), "block_fold", ln.fold_random("p_partkey", 5).alias("random_fold"))


@query("leave_one_cluster_out", f"""
with s as (select c_nationkey as c, c_custkey as k, c_acctbal / 1000 as y, c_custkey / 100.0 as x from customer), tot as (select count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from s),
q as (select c, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from s group by 1), d as (select q.c, t.n - q.n as n, t.sx - q.sx as sx, t.sy - q.sy as sy, t.sxx - q.sxx as sxx, t.sxy - q.sxy as sxy from q, tot t),
v as (select c, n, sx / n as mx, sy / n as my, sxx - sx * sx / n as cxx, sxy - sx * sy / n as cxy from d), w as (select *, sqrt(cxx / n) + 1e-8 as sd from v), f as (select *, (cxy / sd) / (cxx / (sd * sd) + 10.0) / sd as b from w)
select s.k, {r('my + b * (x - mx)', 5)} as locco from s join f on f.c = s.c""")
def leave_one_cluster_out(t):
    rows = t.customer.select(F.col("c_nationkey").alias("c"), F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 1000).alias("y"), (F.col("c_custkey") / 100.0).alias("x"))
    return rounded(ln.leave_one_cluster_out(rows, ["x"], "y", "c", lam=10.0).select("k", "locco"), 5)


@query("probe_eval")
def probe_eval(t):
    """Held-out-letter folds over part names; the letter groups come from hashes, hence no SQL."""
    rows = t.part.select("p_partkey", F.col("p_name").alias("text"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x1"),
                         F.length("p_name").cast("double").alias("x2"), (F.col("p_size") > 25).cast("int").alias("label"))
    folds = ln.fold_letters("text", "abcdefghijklmnopqrstuvwxyz", 6)
    return rounded(ln.probe_eval(rows, "p_partkey", ["x1", "x2"], "y", "label", F.col("x2") > 8, folds))


@query("within_background")
def within_background(t):
    """Keys of all parts as digits; trained without held-out digits, ranked inside shared backgrounds."""
    code = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    rows = t.part.groupBy(code.alias("code")).agg(F.avg("p_size").alias("y"))
    digits = [F.substring("code", i, 1).cast("double").alias(f"d{i}") for i in range(1, 10)]
    return rounded(ln.within_background(rows.select("code", "y", *digits), "code", "code", [f"d{i}" for i in range(1, 10)], "y", "123456789", 5))


@query("cross_map_r2", f"""
with s as (select l_returnflag as g, l_quantity as x, l_extendedprice / 1000 as y1, l_discount * 100 as y2, l_orderkey % 4 <> 0 as tr from lineitem),
f as (select g, regr_sxy(y1, x) / (regr_sxx(y1, x) + 1) as b1, avg(y1) as m1, regr_sxy(y2, x) / (regr_sxx(y2, x) + 1) as b2, avg(y2) as m2, avg(x) as mx from s where tr group by 1),
e as (select s.g, 'y1' as target, y1 as y, m1 + b1 * (x - mx) as p from s join f on f.g = s.g where not tr union all select s.g, 'y2', y2, m2 + b2 * (x - mx) from s join f on f.g = s.g where not tr)
select g, target, cast(count(*) as bigint) as n_test, {r('1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))')} as r2 from e group by 1, 2""")
def cross_map_r2(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y1"), (F.col("l_discount") * 100).alias("y2"), "l_orderkey")
    return rounded(ln.cross_map_r2(rows, ["x"], ["y1", "y2"], F.col("l_orderkey") % 4 != 0, 1.0, ["g"]))


@query("posterior_update", f"""
with s as (select p_brand as g, p_partkey as k, p_size / 50.0 as x, p_retailprice / 1000 as y, 0.05 + (p_partkey % 7) / 100.0 as sd from part),
a as (select g, sum(x * x / (sd * sd + 0.0121)) + 1 as a, sum(x * y / (sd * sd + 0.0121)) as b from s where k % 3 <> 0 group by 1)
select k, {r('x * b / a')} as posterior_mean, {r('sqrt(x * x / a + 0.0121)')} as posterior_sd from s join a on a.g = s.g""")
def posterior_update(t):
    rows = t.part.select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("k"), (F.col("p_size") / 50.0).alias("x"),
                         F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice") / 1000).alias("y"), (0.05 + (F.col("p_partkey") % 7) / 100.0).alias("sd"))
    return rounded(ln.posterior_update(rows, ["x"], "y", "sd", ["g"]).select("k", "posterior_mean", "posterior_sd"))


_LOO = """s as (select c_nationkey as g, c_custkey as k, c_acctbal as y, c_custkey / 1000.0 as x from customer),
  f as (select g, regr_sxy(y, x) / (regr_sxx(y, x) + 1.0) as b, avg(y) as my, avg(x) as mx, count(*) as n, regr_sxx(y, x) as sxx from s group by 1),
  lo as (select s.g, k, y, n, round(y - (y - (my + b * (x - mx))) / greatest(1 - (1.0 / n + pow(x - mx, 2) / (sxx + 1.0)), 1e-6), 9) as p from s join f on f.g = s.g where n >= 3)"""


@query("supervised_metrics", f"""
with {_LOO}, e as (select *, row_number() over (partition by g order by p desc, k) as ps, row_number() over (partition by g order by y desc, k) as pt, {arank('p', 'g')} as rp, {arank('y', 'g')} as ry,
  greatest(5, cast(round_even(0.1 * n, 0) as bigint)) as kk from lo)
select g, cast(max(n) as bigint) as n, {r('(sum(case when pt <= kk then rp end) - max(kk) * (max(kk) + 1) / 2.0) / (max(kk) * (max(n) - max(kk)))', 5)} as elite_auroc,
  {r('sum(case when ps <= kk and pt <= kk then 1 else 0 end) * max(n) / (max(kk) * max(kk))', 5)} as enrichment, {r(scorr('rp', 'ry'), 5)} as rho from e group by 1""")
def supervised_metrics(t):
    rows = t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("y"), (F.col("c_custkey") / 1000.0).alias("x"))
    return rounded(ln.supervised_metrics(rows, ["x"], "y", "k", ["g"]), 5)


def _campaign(t):
    """Parts as a campaign: brand groups, a third of the rows unmeasured."""
    y = F.col("p_retailprice") / 100 + F.col("p_size") / 10.0
    return t.part.select(
        F.col("p_brand").alias("g"), F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 != 0, y).alias("y"), F.col("p_size").cast("double").alias("x1"),
        F.length("p_name").cast("double").alias("x2"), F.length("p_type").cast("double").alias("nuis"), F.col("p_type").alias("cond"))


_CAMP = "c as (select p_brand as g, p_partkey as k, case when p_partkey % 3 <> 0 then p_retailprice / 100 + p_size / 10.0 end as y, p_size * 1.0 as x1, length(p_name) * 1.0 as x2, length(p_type) * 1.0 as nuis from part)"


@query("pooling_check")
def pooling_check(t):
    return rounded(pl.pooling_check(_campaign(t), ["x1", "x2"], "y", "k", "cond", reps=3))


@query("pooling_verdict")
def pooling_verdict(t):
    return rounded(pl.pooling_verdict(pl.pooling_check(_campaign(t), ["x1", "x2"], "y", "k", "cond", reps=2)))


@query("diagnose", f"""
with {_CAMP}, m as (select * from c where y is not null), lg as (select g, k, y, 'x1' as score_name, x1 as s from m union all select g, k, y, 'x2', x2 from m),
rk as (select *, {arank('s', 'g, score_name')} as rs, {arank('y', 'g, score_name')} as ry, row_number() over (partition by g, score_name order by s desc, k) as ps, row_number() over (partition by g, score_name order by y desc, k) as pt,
  count(*) over (partition by g, score_name) as n from lg), kk as (select *, greatest(5, cast(round_even(0.1 * n, 0) as bigint)) as kk from rk),
a as (select g, score_name, {scorr('rs', 'ry')} as rho, (sum(case when pt <= kk then rs end) - max(kk) * (max(kk) + 1) / 2.0) / (max(kk) * (max(n) - max(kk))) as au, sum(case when ps <= kk and pt <= kk then 1 else 0 end) * max(n) / (max(kk) * max(kk)) as en from kk group by 1, 2),
u as (select * from c where y is null), ul as (select g, nuis, 'x1' as score_name, x1 as s from u union all select g, nuis, 'x2', x2 from u), ur as (select *, {arank('s', 'g, score_name')} as rs, {arank('nuis', 'g, score_name')} as rn from ul),
cf as (select g, score_name, case when count(*) >= 5 then {scorr('rs', 'rn')} end as confound from ur group by 1, 2), sz as (select g, count(y) as nm, count(*) - count(y) as nc from c group by 1),
b as (select g, score_name as bs from (select *, row_number() over (partition by g order by au desc, score_name) as i from a) where i = 1)
select a.g, a.score_name, {r('rho')} as rho, {r('au')} as elite_auroc, {r('en')} as enrichment, {r('confound')} as confound, cast(nm as bigint) as n_measured, cast(nc as bigint) as n_candidates, bs as best_score
from a join cf on cf.g = a.g and cf.score_name = a.score_name join sz on sz.g = a.g join b on b.g = a.g""")
def diagnose(t):
    cols = pl.AuditColumns("k", "y", ["x1", "x2"], nuisance="nuis", group=["g"])
    out = pl.diagnose(_campaign(t), cols, ["x1", "x2"])
    return rounded(out.select("g", "score_name", "rho", "elite_auroc", "enrichment", "confound", "n_measured", "n_candidates", "best_score"))


@query("recommend")
def recommend(t):
    cols = pl.AuditColumns("k", "y", ["x1", "x2"], nuisance="nuis", group=["g"])
    out = pl.recommend(pl.diagnose(_campaign(t), cols, ["x1", "x2"]), ["g"])
    return rounded(out.withColumn("reasons", F.array_join("reasons", "; ")))


@query("select_by_score", f"""
with {_CAMP} select g, k, x1 as pick_score, cast(place as int) as place from (select g, k, x1, row_number() over (partition by g order by x1 desc, k) as place from c where y is null) where place <= 5""")
def select_by_score(t):
    return se.select_by_score(_campaign(t), "x1", "y", "k", 5, ["g"]).select("g", "k", "pick_score", F.col("place").cast("int").alias("place"))


@query("select_by_model", f"""
with {_CAMP}, f as (select g, regr_sxy(y, x1) / (regr_sxx(y, x1) + 1.0) as b, avg(y) as my, avg(x1) as mx, stddev_pop(y) as sd from c where y is not null group by 1),
p as (select c.g, k, my + b * (x1 - mx) as p, x1, sd from c join f on f.g = c.g where y is null),
nv as (select p.*, (select min(abs(p.x1 - m.x1)) from c m where m.g = p.g and m.y is not null) as nov from p),
s as (select g, k, round(p + 0.5 * sd * nov / (max(nov) over (partition by g) + 1e-9), 9) as sc from nv)
select g, k, {r('sc', 4)} as pick_score, cast(place as int) as place from (select *, row_number() over (partition by g order by sc desc, k) as place from s) where place <= 5""")
def select_by_model(t):
    out = se.select_by_model(_campaign(t), ["x1"], "y", "k", 5, ["g"], 1.0, 0.5)
    return rounded(out.select("g", "k", "pick_score", F.col("place").cast("int").alias("place")), 4)


@query("select_diverse")
def select_diverse(t):
    return se.select_diverse(_campaign(t), ["x1", "x2"], "y", "k", 4, ["g"])


@query("backtest_static", f"""
with b as (select c_mktsegment as g, c_custkey as k, c_acctbal as y, c_custkey * 1.0 as s, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as pt, count(*) over (partition by c_mktsegment) as n from customer),
e as (select *, pt <= greatest(1, cast(round_even(0.05 * n, 0) as bigint)) as el from b), sd as (select e.*, seed from e, (select unnest(range(3)) as seed)),
o as (select sd.*, 'random' as policy, row_number() over (partition by g, seed order by cast({drawn(0, 'seed', 'k')} as double), k) as rn from sd union all select sd.*, 'score', row_number() over (partition by g, seed order by s desc, k) from sd),
oc as (select g, policy, seed, avg(case when el then (case when rn <= 60 then 1.0 else 0 end) end) as rec, (max(case when rn <= 60 then y end) - min(y)) / (max(y) - min(y)) as bn from o group by 1, 2, 3)
select g, policy, cast(count(*) as bigint) as seeds, {r('avg(rec)')} as top_recall, {r('stddev_pop(rec)')} as top_recall_sd, {r('avg(bn)')} as best_norm from oc group by 1, 2""")
def backtest_static(t):
    rows = t.customer.select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("y"), F.col("c_custkey").cast("double").alias("s"))
    return rounded(se.backtest_grid(rows, ["s"], "y", ["s"], "k", ["g"], ["random", "score"], 3, 20, 3, top_fraction=0.05))


def _measured(t):
    """Customers as a dense campaign: balance driven in part by two features."""
    x1, x2 = F.col("c_custkey") % 13, F.col("c_nationkey")
    return t.customer.select(
        F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 1000 + x1 / 4.0).alias("y"), x1.cast("double").alias("x1"),
        x2.cast("double").alias("x2"), (F.col("c_custkey") % 7).cast("double").alias("s"))


@query("backtest_grid")
def backtest_grid(t):
    """Adaptive policies replayed for all (group, policy, seed) cells at once."""
    return rounded(se.backtest_grid(_measured(t), ["x1", "x2"], "y", ["s", "x2"], "k", ["g"], ["random", "score", "ridge", "ucb", "epsilon", "planner"], 2, 15, 3, top_fraction=0.05))


@query("decision_trace")
def decision_trace(t):
    return rounded(se.decision_trace(_measured(t), ["x1", "x2"], "y", ["s", "x2"], "k", ["g"], 2, 15, 3))


@query("rule_compare")
def rule_compare(t):
    return rounded(se.rule_compare(se.decision_trace(_measured(t), ["x1", "x2"], "y", ["s", "x2"], "k", ["g"], 1, 15, 2), ["round"]))


@query("audit_fraction_yield", f"""
with b as (select c_mktsegment as g, c_custkey as k, c_acctbal as y, c_nationkey * 1.0 as s, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as pt, count(*) over (partition by c_mktsegment) as n from customer),
e as (select *, pt <= greatest(1, cast(round_even(0.1 * n, 0) as bigint)) as el from b), h as (select e.*, seed, row_number() over (partition by g, seed order by {drawn(1, 'seed', 'k')}, k) as o from e, (select unnest(range(2)) as seed)),
p as (select *, row_number() over (partition by g, seed order by s desc, k) as rn, {drawn(2, 'seed', 'k')} as gh from h where o > 20), w as (select p.*, f, cast(round_even(f * 20, 0) as bigint) as x from p, (select unnest([0.0, 0.25, 0.5]) as f)),
q as (select *, rn > 20 - x as rest, row_number() over (partition by g, seed, f order by (rn > 20 - x) desc, gh, k) as er from w),
a as (select g, seed, f, sum(case when el and (not rest or er <= x) then 1 else 0 end) as got, 20.0 * avg(el::int) as rnd from q group by 1, 2, 3)
select g, cast(f as double) as fraction, {r('avg(got)')} as yield, {r('avg(rnd)')} as random, {r('avg(got - rnd)')} as advantage from a group by 1, 2""")
def audit_fraction_yield(t):
    rows = t.customer.select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").cast("double").alias("s"))
    return rounded(se.audit_fraction_yield(rows, "s", "y", "k", [0.0, 0.25, 0.5], ["g"], 2, 20, 0.10))


@query("ranker_yield")
def ranker_yield(t):
    return rounded(se.ranker_yield(_measured(t), ["s", "x2"], ["x1", "x2"], "y", "k", "g", 3, replicates=100))

"""Bootstrap, permutation and battery queries.  Draws are MD5-keyed, so SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchstone.operators import agreement as ag
from touchstone.operators import contrasts as co
from touchstone.operators import perturb as pt
from touchstone.operators import resample as rs
from touchstone.operators import sequences as sq
from touchstone.operators.weights import bootstrap_sums, draw_sql, weight_sql
from touchstone.plans.registry import arank, drawn, query, r, rounded, scorr, t_quantile
from touchstone.settings import settled


def _draws(units, group, key, reps, seed):
    """SQL of (group, replicate, unit key, w): the library's index draws over a unit table."""
    g = f"{group}, " if group else ""
    keys = [group] if group else []
    return f"""idx as (select *, row_number() over ({'partition by ' + group if group else ''} order by {key}) as rn, count(*) over ({'partition by ' + group if group else ''}) as n from {units}),
  pick as (select {g}b, {drawn(seed, *keys, 'b', 'rn')} % n + 1 as rn from idx, (select unnest(range({reps})) as b)),
  wt as (select {g}b, rn, count(*) as w from pick group by all),
  dr as (select idx.*, b, w from idx join wt on idx.rn = wt.rn {f'and idx.{group} = wt.{group}' if group else ''})"""


def _poisson(units, key, reps, seed):
    """SQL of the units with their Poisson weight in each replicate."""
    return f"dr as (select *, {weight_sql(seed, 'b', key)} as w from {units}, (select unnest(range({reps})) as b))"


def _interval(value, group, source):
    g = f"{group}, " if group else ""
    return (f"select {g}quantile_cont({value}, 0.025) as lo, quantile_cont({value}, 0.975) as hi, "
            f"least(1.0, 2 * least(avg(case when {value} <= 0 then 1.0 else 0 end), avg(case when {value} >= 0 then 1.0 else 0 end))) as crossing_p from {source} {'group by ' + group if group else ''}")


_CUST = "cu as (select c_mktsegment, c_custkey, c_acctbal - 4500 as x from customer)"


@query("bootstrap_mean", f"""
with {_CUST}, {_draws('cu', 'c_mktsegment', 'c_custkey', 100, 5)},
m as (select c_mktsegment, b, sum(w * x) / sum(w) as m from dr group by 1, 2), i as ({_interval('m', 'c_mktsegment', 'm')}),
p as (select c_mktsegment, count(*) as n, avg(x) as mean from cu group by 1)
select p.c_mktsegment, cast(n as bigint) as n, {r('mean', 5)} as mean, {r('lo', 5)} as lo, {r('hi', 5)} as hi, {r('crossing_p')} as crossing_p from p join i on i.c_mktsegment = p.c_mktsegment""")
def bootstrap_mean(t):
    rows = t.customer.select("c_mktsegment", "c_custkey", (F.col("c_acctbal") - 4500).alias("x"))
    return rounded(rs.bootstrap_mean(rows, "x", "c_custkey", ["c_mktsegment"], 100, 5, draws="units"), 5)


_RHO = f"""rk as (select l_suppkey, {arank('l_extendedprice', 'l_suppkey')} as rx, {arank('l_discount', 'l_suppkey')} as ry, {arank('l_quantity', 'l_suppkey')} as rz from lineitem),
  st as (select l_suppkey, count(*) as wn, {scorr('rx', 'ry')} as ra, {scorr('rz', 'ry')} as rb from rk group by 1 having count(*) >= 5)"""


def _study_rho(t):
    rows = t.lineitem.select("l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    a = ag.spearman(rows, "l_extendedprice", "l_discount", ["l_suppkey"], name="ra")
    b = ag.spearman(rows, "l_quantity", "l_discount", ["l_suppkey"], name="rb").drop("n")
    return a.join(b, "l_suppkey").filter("ra IS NOT NULL AND rb IS NOT NULL")


@query("cluster_bootstrap_mean", f"""
with {_RHO}, {_draws('st', '', 'l_suppkey', 500, 1)}, m as (select b, sum(w * wn * ra) / sum(w * wn) as m from dr group by 1), i as ({_interval('m', '', 'm')})
select cast(count(*) as bigint) as n, {r('sum(wn * ra) / sum(wn)')} as mean, {r('max(lo)')} as lo, {r('max(hi)')} as hi, {r('max(crossing_p)')} as crossing_p from st, i""")
def cluster_bootstrap_mean(t):
    return rounded(rs.cluster_bootstrap_mean(_study_rho(t), "ra", "n", "l_suppkey", (), 500, 1))


@query("cluster_bootstrap_difference", f"""
with {_RHO}, {_draws('st', '', 'l_suppkey', 500, 1)}, m as (select b, sum(w * wn * (ra - rb)) / sum(w * wn) as m from dr group by 1), i as ({_interval('m', '', 'm')})
select cast(count(*) as bigint) as n, {r('sum(wn * (ra - rb)) / sum(wn)')} as mean, {r('max(lo)')} as lo, {r('max(hi)')} as hi, {r('max(crossing_p)')} as crossing_p from st, i""")
def cluster_bootstrap_difference(t):
    return rounded(rs.cluster_bootstrap_difference(_study_rho(t), "ra", "rb", "n", "l_suppkey", (), 500, 1))


@query("cluster_mean_interval", f"""
with k as (select l_returnflag, l_suppkey, avg(l_discount) - 0.05 as x from lineitem group by 1, 2), {_draws('k', 'l_returnflag', 'l_suppkey', 100, 2)},
m as (select l_returnflag, b, sum(w * x) / sum(w) as m from dr group by 1, 2), i as ({_interval('m', 'l_returnflag', 'm')}), p as (select l_returnflag, count(*) as n, avg(x) as mean from k group by 1)
select p.l_returnflag, cast(n as bigint) as n, {r('mean')} as mean, {r('lo')} as lo, {r('hi')} as hi, {r('crossing_p')} as crossing_p from p join i on i.l_returnflag = p.l_returnflag""")
def cluster_mean_interval(t):
    rows = t.lineitem.select("l_returnflag", "l_suppkey", (F.col("l_discount") - 0.05).alias("x"))
    return rounded(rs.cluster_mean_interval(rows, "x", "l_suppkey", ["l_returnflag"], 100, 2))


@query("bootstrap_statistic", f"""
with cu as (select c_nationkey % 5 as region, c_custkey as k, c_acctbal / 1000 as x, sin(c_custkey * 1.0) + c_acctbal / 9000 as y from customer), {_poisson('cu', 'k', 60, 9)},
s as (select region, b, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / nullif(sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x), 0) as s from dr group by 1, 2),
i as ({_interval('s', 'region', 's where s is not null')}), p as (select region, regr_slope(y, x) as slope from cu group by 1)
select p.region, {r('slope', 5)} as slope, {r('lo', 5)} as lo, {r('hi', 5)} as hi, {r('crossing_p', 5)} as crossing_p from p join i on i.region = p.region""")
def bootstrap_statistic(t):
    """Interval of a regression slope, a function of five sums."""
    x, y = F.col("x"), F.col("y")
    rows = t.customer.select(
        (F.col("c_nationkey") % 5).alias("region"), F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 1000).alias("x"),
        (F.sin(F.col("c_custkey").cast("double")) + F.col("c_acctbal") / 9000).alias("y"))
    slope = lambda s: F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], s["n"] * s["xx"] - s["x"] * s["x"])
    sums = {"n": F.lit(1.0), "x": x, "y": y, "xy": x * y, "xx": x * x}
    return rounded(bootstrap_sums(rows, "k", sums, slope, ["region"], 60, 9, "slope"), 5)


@query("bootstrap_refit", f"""
with cu as (select c_nationkey % 5 as region, c_custkey % 20 as k, avg(c_acctbal) as x, avg(c_custkey) as y from customer group by 1, 2), {_draws('cu', 'region', 'k', 40, 9)},
ex as (select region, b, x, y, unnest(range(w)) as i from dr), s as (select region, b, regr_slope(y, x) as s from ex group by 1, 2),
i as (select region, quantile_cont(s, 0.025) as lo, quantile_cont(s, 0.975) as hi, least(1.0, 2 * least(avg(case when s <= 0 then 1.0 else 0 end), avg(case when s >= 0 then 1.0 else 0 end))) as crossing_p from s where s is not null group by 1),
p as (select region, regr_slope(y, x) as slope from cu group by 1)
select p.region, {r('slope', 5)} as slope, {r('lo', 5)} as lo, {r('hi', 5)} as hi, {r('crossing_p', 5)} as crossing_p from p join i on i.region = p.region""")
def bootstrap_refit(t):
    """As above for a statistic that is refitted on the drawn units."""
    units = t.customer.groupBy((F.col("c_nationkey") % 5).alias("region"), (F.col("c_custkey") % 20).alias("k")).agg(
        F.avg("c_acctbal").alias("x"), F.avg("c_custkey").alias("y"))
    slope = lambda rows, by: rows.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"))
    return rounded(rs.bootstrap_statistic(units, "k", ["region"], slope, "slope", 40, 9), 5)


def _auc_of(score, by, source, weight="w"):
    """SQL of weighted AUC per ``by`` by value counts."""
    return f"""select {by}, sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) as auc from (
      select {by}, v, p, q, coalesce(sum(q) over (partition by {by} order by v rows between unbounded preceding and 1 preceding), 0) as below from (
        select {by}, {score} as v, sum(case when y = 1 then {weight} else 0 end) as p, sum(case when y = 0 then {weight} else 0 end) as q from {source} group by all)) group by {by}"""


_LAB = "u as (select doc_id, n_chars as s, case lang when 'en' then 1 when 'fr' then 2 when 'de' then 3 else 4 end as s2, quality as y, 'all' as g from documents join labels using (doc_id))"


def _labelled(t):
    rank = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).otherwise(4)
    return t.labelled_documents().select("doc_id", F.col("n_chars").alias("s"), rank.alias("s2"), F.col("quality").alias("y"))


@query("bootstrap_auc", f"""
with {_LAB}, {_poisson('u', 'doc_id', 50, 4)}, a as ({_auc_of('s', 'b', 'dr')}), i as ({_interval('auc', '', 'a')}), p as ({_auc_of('s', 'g', 'u', '1')})
select {r('auc')} as auc, {r('lo')} as lo, {r('hi')} as hi, {r('crossing_p')} as crossing_p from p, i""")
def bootstrap_auc(t):
    return rounded(rs.bootstrap_auc(_labelled(t), "s", "y", "doc_id", (), 50, 4))


@query("bootstrap_auc_difference", f"""
with {_LAB}, {_poisson('u', 'doc_id', 50, 4)}, a1 as ({_auc_of('s', 'b', 'dr')}), a2 as ({_auc_of('s2', 'b', 'dr')}), a as (select a1.b, a1.auc - a2.auc as auc from a1 join a2 on a1.b = a2.b),
i as ({_interval('auc', '', 'a')}), p1 as ({_auc_of('s', 'g', 'u', '1')}), p2 as ({_auc_of('s2', 'g', 'u', '1')})
select {r('p1.auc - p2.auc')} as auc_difference, {r('lo')} as lo, {r('hi')} as hi, {r('crossing_p')} as crossing_p from p1, p2, i""")
def bootstrap_auc_difference(t):
    return rounded(rs.bootstrap_auc_difference(_labelled(t), "s", "s2", "y", "doc_id", (), 50, 4))


@query("cluster_bootstrap_auc", f"""
with o as (select o_custkey % 200 as c, o_totalprice as s, case when o_orderstatus = 'F' then 1 else 0 end as y, 'all' as g from orders), cl as (select distinct c from o), {_draws('cl', '', 'c', 50, 6)},
j as (select o.*, b, w from o join dr on dr.c = o.c), a as ({_auc_of('s', 'b', 'j')}), i as ({_interval('auc', '', 'a')}), p as ({_auc_of('s', 'g', 'o', '1')})
select {r('auc')} as auc, {r('lo')} as lo, {r('hi')} as hi, {r('crossing_p')} as crossing_p from p, i""")
def cluster_bootstrap_auc(t):
    rows = t.orders.select((F.col("o_custkey") % 200).alias("c"), F.col("o_totalprice").alias("s"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    return rounded(rs.cluster_bootstrap_auc(rows, ["s"], "y", "c", (), 50, 6))


def _perm(alt):
    test = {"two-sided": "abs(d) >= abs(obs) - 1e-12", "greater": "d >= obs - 1e-12", "less": "d <= obs + 1e-12"}[alt]
    return f"""
with s as (select c_nationkey % 5 as region, c_custkey as k, c_acctbal as x, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 1 else 0 end as y from customer),
ob as (select region, sum(y) as n1, count(*) as n, avg(x) filter (y = 1) - avg(x) filter (y = 0) as obs from s group by 1),
h as (select s.region, k, x, b, n1, obs, {draw_sql(7, 'b', 's.region', 'k')} as h from s join ob on ob.region = s.region, (select unnest(range(60)) as b)),
q as (select *, row_number() over (partition by region, b order by h, k) as rn from h),
nd as (select region, b, obs, avg(x) filter (rn <= n1) - avg(x) filter (rn > n1) as d from q group by 1, 2, 3),
p as (select region, (sum(case when {test} then 1.0 else 0 end) + 1) / (count(*) + 1) as p from nd group by 1)
select p.region, cast(n1 as bigint) as n1, cast(n as bigint) as n, {r('obs', 5)} as observed, {r('p')} as p from p join ob on ob.region = p.region"""


@query("permutation_test", _perm("two-sided"))
def permutation_test(t):
    side = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1).otherwise(0)
    rows = t.customer.select((F.col("c_nationkey") % 5).alias("region"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), side.alias("y"))
    out = rs.permutation_test(rows, "x", "y", "k", ["region"], 60, 7)
    return rounded(out.withColumn("observed", F.round("observed", 5)))


@query("auc_permutation", f"""
with s as (select c_nationkey as g, c_custkey as k, c_acctbal as x, case when c_mktsegment = 'BUILDING' then 1 else 0 end as y from customer),
rk as (select *, {arank('x', 'g')} as rk from s), sz as (select g, count(*) as n, sum(y) as k1, sum(case when y = 1 then rk end) as sm from rk group by 1),
h as (select rk.g, rk, b, k1, sm, k, {draw_sql(3, 'b', 'rk.g', 'k')} as h from rk join sz on sz.g = rk.g, (select unnest(range(50)) as b)),
q as (select *, row_number() over (partition by g, b order by h, k) as rn from h), t as (select g, b, sm, sum(case when rn <= k1 then rk end) as t from q group by 1, 2, 3),
p as (select g, avg(case when t >= sm - 1e-9 then 1.0 else 0 end) as p from t group by 1)
select sz.g, cast(n as bigint) as n, cast(k1 as bigint) as n_pos, {r('(sm - k1 * (k1 + 1) / 2.0) / (k1 * (n - k1))')} as auc, 'drawn' as method, {r('p')} as p from sz join p on p.g = sz.g""")
def auc_permutation(t):
    rows = t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("y"))
    return rounded(rs.auc_permutation(rows, "x", "y", "k", ["g"], "drawn", 50, 3))


@query("auc_permutation_exact", f"""
with s as (select n_regionkey as g, c_nationkey as k, avg(c_acctbal) as x, max(case when c_nationkey % 3 = 0 then 1 else 0 end) as y from customer join nation on n_nationkey = c_nationkey group by 1, 2),
rk as (select *, {arank('x', 'g')} as rk, row_number() over (partition by g order by k) as i from s), sz as (select g, count(*) as n, sum(y) as k1, sum(case when y = 1 then rk end) as sm from rk group by 1),
sub as (select rk.g, m, sum(rk) as t from rk join sz on sz.g = rk.g, (select unnest(range(1, 2048)) as m) where (m >> (i - 1)) % 2 = 1 and m < (1 << n) group by rk.g, m, k1 having count(*) = max(k1)),
p as (select sub.g, avg(case when t >= sm - 1e-9 then 1.0 else 0 end) as p from sub join sz on sz.g = sub.g group by 1)
select sz.g, cast(n as bigint) as n, cast(k1 as bigint) as n_pos, {r('(sm - k1 * (k1 + 1) / 2.0) / (k1 * (n - k1))')} as auc, 'exact' as method, {r('p')} as p from sz join p on p.g = sz.g where k1 > 0 and k1 < n""")
def auc_permutation_exact(t):
    rows = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select(F.col("n_regionkey").alias("g"), F.col("c_nationkey").alias("k"), "x", F.when(F.col("c_nationkey") % 3 == 0, 1).otherwise(0).alias("y"))
    return rounded(rs.auc_permutation(rows, "x", "y", "k", ["g"], "exact"))


@query("cluster_permuted_null", f"""
with s as (select p_partkey as k, p_brand as c, p_size as f, p_retailprice as y from part), k as (select {arank('f')} as rx, {arank('y')} as ry from s),
ob as (select count(*) as n, {scorr('rx', 'ry')} as rho from k), me as (select c, avg(y) as m from s group by 1), ix as (select c, m, row_number() over (order by c) as i from me),
od as (select c, b, row_number() over (partition by b order by {drawn(2, 'b', 'c')}, c) as i from ix, (select unnest(range(60)) as b)),
sw as (select od.b, od.c, ix.m as nm from od join ix on ix.i = od.i), j as (select b, f, nm from s join sw on sw.c = s.c),
jr as (select b, {arank('f', 'b')} as rx, {arank('nm', 'b')} as ry from j), nl as (select b, {scorr('rx', 'ry')} as r0 from jr group by 1)
select {r('max(rho)')} as rho, cast(max(n) as bigint) as n, {r('avg(case when abs(r0) >= abs(rho) - 1e-12 then 1.0 else 0 end)')} as p from nl, ob""")
def cluster_permuted_null(t):
    return rounded(rs.cluster_permuted_null(t.part, "p_size", "p_retailprice", "p_brand", "p_partkey", 60, 2).select("rho", "n", "p"))


@query("noise_split", f"""
with s as (select c_nationkey as u, c_custkey as k, c_acctbal / 1000 as x from customer), {_draws('s', 'u', 'k', 30, 8)},
m as (select u, b, sum(w * x) / sum(w) as m from dr group by 1, 2), nz as (select sqrt(avg(v)) as ws from (select var_samp(m) as v from m group by u)),
un as (select u, avg(x) as res from s group by 1), tt as (select count(*) as n, stddev_samp(res) as sd from un)
select cast(n as bigint) as units, {r('sd')} as total_sd, {r('ws')} as within_sd, {r('sqrt(greatest(0, sd * sd - ws * ws))')} as between_sd from tt, nz""")
def noise_split(t):
    rows = t.customer.select(F.col("c_nationkey").alias("u"), F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 1000).alias("x"))
    reps = rs.resampled_rows(rows, "k", ["u"], 30, 8).groupBy("u", rs.REPLICATE).agg(F.avg("x").alias("m"))
    units = rows.groupBy("u").agg(F.avg("x").alias("res"))
    return rounded(rs.noise_split(units, "u", "res", reps, "m"))


# ---- batteries: letter-bigram score of whole texts against deterministic perturbations

_GRAMS = """gram as (select d.doc_id, kind, substr(txt, cast(i as int), 1) as a, substr(txt, cast(i + 1 as int), 1) as b from (
    select doc_id, 'real' as kind, text as txt from benchmark_docs union all select doc_id, 'reversal', reverse(text) from benchmark_docs
    union all select doc_id, 'frameshift +1', substr(text, 2) || substr(text, 1, 1) from benchmark_docs) d, unnest(range(1, length(txt))) as u(i)),
  own as (select doc_id, kind, a, b, count(*) as n from gram where regexp_full_match(a || b, '[a-z]{2}') group by all),
  fit as (select a, b, sum(n) as c from own where kind = 'real' group by all), ctx as (select a, sum(c) as ca from fit group by 1),
  sc as (select doc_id, kind, sum(n * ln((coalesce(c, 0) + 1) / (coalesce(ca, 0) + 26.0))) / sum(n) as score from own left join fit on own.a = fit.a and own.b = fit.b left join ctx on ctx.a = own.a group by 1, 2),
  dl as (select p.doc_id, p.kind, rl.score - p.score as delta from sc p join sc rl on rl.doc_id = p.doc_id and rl.kind = 'real' where p.kind <> 'real')"""
_TEXTS = "benchmark_docs as (select item_id as doc_id, text from benchmark)"


def battery_deltas(t):
    """Real minus perturbed letter-bigram score of the benchmark passages."""
    texts = t.benchmark.select(F.col("item_id").alias("doc_id"), "text")
    made = pt.perturb(texts, "doc_id", "text", ["reversal", "frameshift +1"])
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    real = sq.markov_scores(texts, "doc_id", "text", 1, alphabet=alphabet)
    scored = sq.markov_scores(made.withColumnRenamed("perturbed", "text"), "doc_id", "text", 1, alphabet=alphabet, corpus=texts, corpus_text="text", score_key="perturbation")
    return co.paired_deltas(real, scored, "doc_id")


_STATS = f"""st as (select kind, count(*) as n, avg(round(delta, 12)) as mean, stddev_samp(round(delta, 12)) / sqrt(count(*)) as se, sum(case when round(delta, 12) > 0 then 1 else 0 end) as up, sum(case when round(delta, 12) = 0 then 1 else 0 end) as ties from dl group by 1),
  rf as (select mean as ref from st where kind = 'reversal'),
  ci as (select *, {t_quantile(0.975, '(n - 1.0)')} * se as half from st, rf)"""
_BOOT = f"""{_poisson('dl', 'doc_id', 300, 0)}, bm as (select kind, b, sum(w * round(delta, 12)) / nullif(sum(w), 0) as m from dr group by 1, 2),
  bi as (select kind, quantile_cont(m, 0.025) as blo, quantile_cont(m, 0.975) as bhi from bm where m is not null group by 1)"""


@query("contrast_battery", f"""
with {_TEXTS}, {_GRAMS}, {_STATS}, {_BOOT}
select kind as perturbation, {r('blo')} as boot_lo, {r('bhi')} as boot_hi, cast(n as bigint) as n, {r('mean')} as mean, {r('se')} as se, {r('mean - half')} as ci_lo, {r('mean + half')} as ci_hi, cast(up as bigint) as real_higher, cast(ties as bigint) as ties,
  {r('ref')} as reference_delta, {r('mean / ref', 5)} as ratio_to_reference, case when mean - half > 0 then 'REPRESENTS' when mean + half < 0 then 'INVERTED' when ref > 0 and mean + half < ref then 'NULL' else 'UNDERPOWERED' end as verdict from ci join bi using (kind)""")
def contrast_battery(t):
    deltas = battery_deltas(t).withColumn("delta", F.round("delta", 12))
    declared = pt.registry_table(t.spark, ["reversal", "frameshift +1"])
    out = co.contrast_battery(deltas, declared, "reversal", key="doc_id", replicates=300)
    out = out.withColumn("ratio_to_reference", F.round("ratio_to_reference", 5))
    return rounded(out.select("perturbation", "n", "mean", "se", "ci_lo", "ci_hi", "boot_lo", "boot_hi", "real_higher", "ties", "reference_delta", "ratio_to_reference", "verdict"))


@query("matched_contrast", f"""
with {_TEXTS}, {_GRAMS}, w0 as (select doc_id, max(case when kind = 'reversal' then delta end) - max(case when kind = 'frameshift +1' then delta end) as d from dl group by 1),
w as (select * from w0 where d is not null), {_poisson('w', 'doc_id', 300, 0)}, bm as (select b, sum(w * d) / nullif(sum(w), 0) as m from dr group by 1)
select {r('(select quantile_cont(m, 0.025) from bm)')} as boot_lo, {r('(select quantile_cont(m, 0.975) from bm)')} as boot_hi, cast(count(d) as bigint) as n, {r('avg(d)')} as mean, {r('stddev_samp(d) / sqrt(count(d))')} as se, cast(sum(case when d > 0 then 1 else 0 end) as bigint) as real_higher from w where d is not null""")
def matched_contrast(t):
    out = co.matched_contrast(battery_deltas(t), "doc_id", "reversal", "frameshift +1", "reversal", replicates=300)
    return rounded(out.select("n", "mean", "se", "boot_lo", "boot_hi", "real_higher"))


@query("battery_claims")
def battery_claims(t):
    """Whole battery on documents with hashed shuffles; draws of the pair walk are not in SQL."""
    texts = t.documents.select("doc_id", F.lower("text").alias("text"))
    names = ["reversal", "mononucleotide shuffle", "dinucleotide shuffle"]
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    made = pt.perturb(texts, "doc_id", "text", names, original="real")
    scored = settled(sq.markov_scores(made.withColumnRenamed("perturbed", "text"), "doc_id", "text", 1, alphabet=alphabet, corpus=texts, corpus_text="text", score_key="perturbation"), always=True)
    declared = pt.registry_table(t.spark, names)
    deltas = co.paired_deltas(scored.filter("perturbation = 'real'"), scored.filter("perturbation <> 'real'"), "doc_id")
    out = co.contrast_battery(deltas, declared, "mononucleotide shuffle", key="doc_id", replicates=1000)
    return rounded(co.claim_text(out, declared))


@query("replayed_deltas", f"""
with w as (select l_suppkey, avg(l_quantity) filter (l_returnflag = 'A') as a, avg(l_quantity) filter (l_returnflag = 'N') as n, avg(l_quantity) filter (l_returnflag = 'R') as rr from lineitem group by 1)
select perturbation, cast(count(*) as bigint) as n, {r('avg(delta)')} as mean, {r('stddev_samp(delta) / sqrt(count(*))')} as se from (
  select 'first' as perturbation, a - n as delta from w where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0) union all select 'second', a - rr from w where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)) where delta is not null group by 1""")
def replayed_deltas(t):
    from touchstone.operators.hypothesis import paired_interval

    means = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    wide = means.select("l_suppkey", (F.col("A") - F.col("N")).alias("delta:first"), (F.col("A") - F.col("R")).alias("delta:second"))
    keep = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    long = co.replay_deltas(wide, "l_suppkey", keep=keep)
    return rounded(paired_interval(long, "delta", ["perturbation"]).select("perturbation", "n", "mean", "se"))

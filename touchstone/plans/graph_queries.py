"""Neighbour graphs, clusters, intervals, splits, vectors and time-ordered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchstone.operators import graph as gp
from touchstone.operators import probes as pb
from touchstone.operators import sampling as sa
from touchstone.operators import triples as tr
from touchstone.operators import vectors as ve
from touchstone.operators.running import islands_by_gap
from touchstone.plans.registry import drawn, query, r, rounded
from touchstone.streaming import streams as st

# ---- short codes of customers: nation and balance, six digits

_CODES = "codes as (select lpad(cast(c_nationkey as varchar), 2, '0') || lpad(cast(cast(floor(abs(c_acctbal) / 10) as int) as varchar), 4, '0') as c, max(c_acctbal) as v, max(case when c_mktsegment = 'BUILDING' then 1 else 0 end) as y from customer group by 1)"


def _codes(t):
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(F.floor(F.abs("c_acctbal") / 10).cast("string"), 4, "0"))
    return t.customer.groupBy(code.alias("c")).agg(F.max("c_acctbal").alias("v"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)).alias("y"))


def _linked(distance):
    """SQL of (src, dst) among ``nodes(c)`` and of their components by repeated minimum."""
    return f"""ed as (select a.c as src, b.c as dst from nodes a join nodes b on a.c <> b.c and hamming(a.c, b.c) <= {distance}),
  cc(node, comp) using key (node) as (select c, c from nodes union select ed.dst, min(cc.comp) from cc join ed on ed.src = cc.node
    join recurring.cc as old on old.node = ed.dst where cc.comp < old.comp group by 1)"""


@query("hamming_neighbours", f"with {_CODES} select a.c as src, b.c as dst from codes a join codes b on hamming(a.c, b.c) = 1")
def hamming_neighbours(t):
    return gp.hamming_neighbours(_codes(t), "c")


@query("connected_components", f"with recursive {_CODES}, nodes as (select c from codes), {_linked(1)} select node, comp as component from cc")
def connected_components(t):
    nodes = _codes(t).select(F.col("c").alias("node"))
    return gp.connected_components(gp.hamming_neighbours(nodes, "node"), nodes=nodes)


@query("order_components", """
with recursive e as (select l_orderkey as src, 1000000000 + l_partkey as dst from lineitem union select 1000000000 + l_partkey, l_orderkey from lineitem
  union select o_orderkey, 2000000000 + o_custkey from orders union select 2000000000 + o_custkey, o_orderkey from orders), nodes as (select distinct src as v from e),
cc(node, comp) using key (node) as (select v, v from nodes union select e.dst, min(cc.comp) from cc join e on e.src = cc.node join recurring.cc as old on old.node = e.dst where cc.comp < old.comp group by 1)
select comp as component, cast(count(*) as bigint) as size from cc group by 1""")
def order_components(t):
    """Orders, parts and customers as one graph; hubs and a giant component included."""
    parts = t.lineitem.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 1000000000).alias("dst"))
    buyers = t.orders.select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 2000000000).alias("dst"))
    return gp.connected_components(parts.unionByName(buyers)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query("missed_set_shape", f"""
with recursive {_CODES}, neg as (select v, row_number() over (order by v desc) as rk, count(*) over () as n from codes where y = 0), th as (select v as th from neg where rk = floor(0.2 * n)),
nodes as (select c from codes, th where y = 1 and v < th), {_linked(1)}, s as (select comp, count(*) as n from cc group by 1)
select cast(count(*) as bigint) as n_components, cast(max(n) as bigint) as largest, {r('max(n) / sum(n)')} as largest_share, cast(sum(case when n = 1 then 1 else 0 end) as bigint) as singletons from s""")
def missed_set_shape(t):
    return rounded(gp.missed_set_shape(_codes(t), "c", "v", "y", 0.2))


@query("identity_clusters", f"with recursive {_CODES}, nodes as (select c || substr(reverse(c), 1, 4) as c from codes), {_linked(2)} select node as key, comp as component from cc")
def identity_clusters(t):
    rows = _codes(t).select(F.concat("c", F.substring(F.reverse("c"), 1, 4)).alias("text"))
    return gp.identity_clusters(rows.withColumn("key", F.col("text")), "key", "text", 0.75)


@query("prefix_identity_clusters", f"""
with recursive {_CODES}, rep as (select substr(c, 1, 3) as p, min(c) as c from codes group by 1), nodes as (select distinct c from rep), {_linked(2)},
grp as (select comp, min(p) as cluster from rep join cc on cc.node = rep.c group by 1)
select codes.c, cluster from codes join rep on rep.p = substr(codes.c, 1, 3) join cc on cc.node = rep.c join grp on grp.comp = cc.comp""")
def prefix_identity_clusters(t):
    rows = _codes(t).select("c", F.col("c").alias("text"))
    return gp.prefix_then_identity_clusters(rows, "c", "text", 3, 0.60)


@query("ruggedness", f"""
with recursive {_CODES}, ed as (select a.c as src, b.c as dst from codes a join codes b on hamming(a.c, b.c) = 1), nb as (select src, dst, v, row_number() over (partition by src order by v desc, dst) as i from ed join codes on codes.c = ed.dst),
up as (select k.c, case when nb.v > k.v then nb.dst else k.c end as nxt from codes k left join nb on nb.src = k.c and nb.i = 1),
walk(c, pos, d) as (select c, c, 0 from codes union all select w.c, up.nxt, d + 1 from walk w join up on up.c = w.pos where up.nxt <> w.pos),
fin as (select c, arg_max(pos, d) as peak from walk group by 1), best as (select c as gk, v as gv from codes order by v desc, c limit 1)
select cast(sum(case when up.nxt = up.c then 1 else 0 end) as bigint) as local_optima, cast(count(*) as bigint) as n, max(gk) as global_key, {r('max(gv)')} as global_value,
  {r('avg(case when peak = gk then 1.0 else 0 end)')} as reach_global, {r('avg(pk.v)')} as mean_peak from up join fin on fin.c = up.c join codes pk on pk.c = fin.peak, best""")
def ruggedness(t):
    return rounded(gp.ruggedness(_codes(t), "c", "v"))


# ---- intervals and islands

@query("session_clusters", """
with e as (select user_id, epoch_us(ts) // 1000000 as s, event_id from events), g as (select *, case when s > max(s + 60) over (partition by user_id order by s, s + 60 rows between unbounded preceding and 1 preceding) + 1800 or row_number() over (partition by user_id order by s) = 1 then 1 else 0 end as o from e),
c as (select *, sum(o) over (partition by user_id order by s rows unbounded preceding) as c from g)
select user_id, cast(max(c) as bigint) as clusters, cast(count(*) as bigint) as events from c group by 1""")
def session_clusters(t):
    rows = t.events.select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s")).withColumn("e", F.col("s") + 60)
    marked = islands_by_gap(rows, ["user_id"], "s", "e", 1800)
    return marked.groupBy("user_id").agg(F.max("cluster").alias("clusters"), F.count(F.lit(1)).alias("events"))


@query("interval_overlap", """
with iv as (select p_size % 5 as chrom, p_partkey * 10 as s, p_partkey * 10 + p_size as e from part), w as (select p_size % 5 as chrom, p_partkey as k, p_partkey * 10 - 15 as a, p_partkey * 10 + 25 as b from part),
m as (select chrom, s, e, case when s > coalesce(max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as o from iv),
c as (select chrom, s, e, sum(o) over (partition by chrom order by s, e rows unbounded preceding) as c from m), mg as (select chrom, c, min(s) as s, max(e) as e from c group by 1, 2)
select w.chrom, k, round(sum(greatest(0, least(b, e) - greatest(a, s))) / max(b - a), 6) + 0.0 as covered_share from w left join mg on mg.chrom = w.chrom group by 1, 2""")
def interval_overlap(t):
    chrom = (F.col("p_size") % 5).alias("chrom")
    intervals = t.part.select(chrom, (F.col("p_partkey") * 10).alias("a"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("b"))
    windows = t.part.select(chrom, F.col("p_partkey").alias("k"), (F.col("p_partkey") * 10 - 15).alias("a"), (F.col("p_partkey") * 10 + 25).alias("b"))
    return rounded(gp.interval_overlap(windows, intervals, ["chrom"], "k", "a", "b", 100))


# ---- splits and samples

@query("hash_sample", f"select o_orderkey from orders where {drawn(3, 'o_orderkey')} % 10 = 0")
def hash_sample(t):
    return t.orders.filter(sa.hash_sample("o_orderkey", 10, 3)).select("o_orderkey")


@query("random_split", f"""
select o_orderkey, case when row_number() over (order by {drawn(0, 'o_orderkey')}, o_orderkey) <= 1000 then 'test' else 'train' end as split from orders""")
def random_split(t):
    return sa.random_split(t.orders.select("o_orderkey"), "o_orderkey", 1000)


@query("cluster_split", f"""
with s as (select o_custkey, count(*) as n, {drawn(0, 'o_custkey')} as h from orders group by 1), b as (select o_custkey, coalesce(sum(n) over (order by h, o_custkey rows between unbounded preceding and 1 preceding), 0) as b from s)
select o_orderkey, case when b < 3000 then 'test' else 'train' end as split from orders join b using (o_custkey)""")
def cluster_split(t):
    return sa.cluster_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 3000).select("o_orderkey", "split")


@query("stratified_sample", f"""
with k as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {drawn(0, 'o_orderkey')}, o_orderkey) as rn, count(*) over (partition by o_orderpriority) as n, count(*) over () as a from orders)
select o_orderkey, o_orderpriority from k where rn <= round_even(500.0 * n / a, 0)""")
def stratified_sample(t):
    return sa.stratified_sample(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 500)


@query("top_up_sample", f"""
with k as (select p_partkey, p_type, row_number() over (partition by p_type order by (case when p_partkey % 50 = 0 then 1 else 0 end) desc, {drawn(0, 'p_partkey')}, p_partkey) as rn from part) select p_partkey, p_type from k where rn <= 12 or p_partkey % 50 = 0""")
def top_up_sample(t):
    return sa.top_up_sample(t.part.select("p_partkey", "p_type"), "p_partkey", "p_type", 12, F.col("p_partkey") % 50 == 0)


def _feistel(x, h, tweak, seed):
    """SQL of one pass of the library's pair permutation."""
    at = f"[{x} >> {h}, {x} & ((1::bigint << {h}) - 1)]"
    for i in range(sa.ROUNDS):
        key = [f"({drawn(seed, repr(c), str(i))} % {n})" for c, n in (("f", sa.PRIME - 1), ("o", sa.PRIME))]
        at = (f"list_transform([{at}], lambda s: [s[2], xor(s[1], (s[2] * ({key[0]} + 1) + ({key[1]} + {tweak}) % {sa.PRIME}) % {sa.PRIME} "
              f"& ((1::bigint << {h}) - 1))])[1]")
    return f"list_transform([{at}], lambda s: (s[1] << {h}) | s[2])[1]"


@query("sample_pairs", f"""
with recursive i as (select c_nationkey as g, c_custkey as k, row_number() over (partition by c_nationkey order by c_custkey) - 1 as rn from customer),
s as (select g, count(*) * (count(*) - 1) // 2 as al, cast(ceil(log2(greatest(count(*) * (count(*) - 1) // 2, 2)) / 2) as int) as h, {drawn(5, 'g')} % {sa.PRIME} as tw from i group by 1),
w as (select g, al, h, tw, slot, {_feistel('slot', 'h', 'tw', 5)} as t from (select s.*, cast(unnest(range(cast(least(al, 40) as bigint))) as bigint) as slot from s where al > 0)
      union all select g, al, h, tw, slot, {_feistel('t', 'h', 'tw', 5)} as t from w where t >= al),
h as (select g, t, cast(floor((1 + sqrt(1 + 8.0 * t)) / 2) as bigint) as hi from w where t < al)
select h.g, a.k as a, b.k as b from h join i a on a.g = h.g and a.rn = h.t - h.hi * (h.hi - 1) // 2 join i b on b.g = h.g and b.rn = h.hi""")
def sample_pairs(t):
    return sa.sample_pairs(t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k")), "k", 40, ["g"], 5)


@query("sample_windows", f"""
with d as (select doc_id, text, unnest(range(0, 4)) as i from documents where length(text) >= 32), s as (select doc_id, text, {drawn(2, 'doc_id', 'i')} % (length(text) - 30) as st from d),
a as (select doc_id, text, st - st % 6 as st from s), w as (select distinct doc_id, st, substr(text, cast(st as int) + 1, 30) as w from a where st + 30 <= length(text))
select doc_id, cast(st as int) as start, w as "window" from w where regexp_full_match(w, '[a-zA-Z .,]+')""")
def sample_windows(t):
    return sa.sample_windows(t.documents, "doc_id", "text", 30, 4, "a-zA-Z .,", seed=2)


# ---- vectors

_CEN = """u as (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(v::double) as m from u group by 1, 2), c as (select label, list(m order by i) as c from m group by 1)"""


@query("nearest_centroid", f"""
with {_CEN}, s as (select e.vec_id, c.label, round(list_cosine_similarity(e.embedding::double[], c.c), 9) as s from embeddings e, c), k as (select *, row_number() over (partition by vec_id order by s desc, label) as rn from s)
select vec_id, label as nearest, {r('s')} as similarity from k where rn = 1""")
def nearest_centroid(t):
    models = ve.centroids(t.embeddings, ["label"], "embedding")
    return rounded(ve.nearest_centroid(t.embeddings, "vec_id", "embedding", models, "label"))


@query("nearest_summary", f"""
with {_CEN}, s as (select e.vec_id, e.label as g, c.label, round(list_cosine_similarity(e.embedding::double[], c.c), 9) as s from embeddings e, c), k as (select *, row_number() over (partition by vec_id order by s desc, label) as rn from s),
n as (select g, label, count(*) as n, row_number() over (partition by g order by count(*) desc, label) as rn from k where rn = 1 group by 1, 2)
select g as label, cast(count(*) as bigint) as distinct_nearest, max(case when rn = 1 then label end) as modal, {r('max(n) / sum(n)')} as modal_share from n group by 1""")
def nearest_summary(t):
    models = ve.centroids(t.embeddings, ["label"], "embedding")
    near = ve.nearest_centroid(t.embeddings, "vec_id", "embedding", models, "label")
    return rounded(ve.nearest_summary(near.join(t.embeddings.select("vec_id", "label"), "vec_id"), ["label"]))


@query("cosine_distance", f"""
with {_CEN} select vec_id, {r('1 - list_cosine_similarity(e.embedding::double[], c.c)')} as distance from embeddings e join c on c.label = e.label""")
def cosine_distance(t):
    models = ve.centroids(t.embeddings, ["label"], "embedding")
    return rounded(t.embeddings.join(models, "label").select("vec_id", ve.cosine_distance("embedding", "centroid").alias("distance")))


@query("mean_pairwise_cosine", f"""
select a.label, cast(max(n) as bigint) as n, {r('avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[]))')} as mean_pairwise_cosine
from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id join (select label, count(*) as n from embeddings group by 1) c on c.label = a.label group by 1""")
def mean_pairwise_cosine(t):
    return rounded(ve.mean_pairwise_cosine(t.embeddings, "embedding", ["label"]))


@query("unit_vectors", f"""
select vec_id, {r('list_sum(list_transform(embedding, lambda x: abs(x::double))) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x)))', 5)} as l1 from embeddings""")
def unit_vectors(t):
    from touchstone.sources.readers import unit_vectors as scaled

    rows = scaled(t.embeddings, "vec_id", "embedding")
    return rounded(rows.select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + F.abs(v)).alias("l1")), 5)


_KNN = """tr as (select * from embeddings where vec_id % 5 <> 0), te as (select * from embeddings where vec_id % 5 = 0),
  d as (select te.vec_id, tr.vec_id as tid, tr.label, row_number() over (partition by te.vec_id order by round(list_distance(te.embedding::double[], tr.embedding::double[]), 9), tr.vec_id) as p from te, tr),
  v as (select vec_id, label as candidate, count(*) as votes, min(p) as f from d where p <= 7 group by 1, 2),
  rk as (select *, row_number() over (partition by vec_id order by votes desc, f, candidate) as rank from v)"""


def _knn(t):
    return ve.knn_vote(t.embeddings.filter("vec_id % 5 <> 0"), t.embeddings.filter("vec_id % 5 = 0"), "vec_id", "embedding", "label", 7)


@query("knn_vote", f"with {_KNN} select vec_id, candidate, cast(votes as bigint) as votes, cast(rank as bigint) as rank from rk")
def knn_vote(t):
    return _knn(t).select("vec_id", "candidate", "votes", F.col("rank").cast("long").alias("rank"))


@query("knn_accuracy", f"""
with {_KNN}, h as (select te.vec_id, min(case when rk.candidate = te.label then rank end) as at_ from te join rk on rk.vec_id = te.vec_id group by 1)
select cast(count(*) as bigint) as n, {r('avg(case when at_ <= 1 then 1.0 else 0 end)')} as top1, {r('avg(case when at_ <= 3 then 1.0 else 0 end)')} as top3, {r('avg(coalesce(1.0 / at_, 0))')} as mrr from h""")
def knn_accuracy(t):
    from touchstone.operators.agreement import topk_accuracy

    ranked = _knn(t).join(t.embeddings.select("vec_id", "label"), "vec_id").withColumn("s", -F.col("rank"))
    return rounded(topk_accuracy(ranked, "vec_id", "label", "candidate", "s", (1, 3)))


@query("variance_explained", f"""
with u as (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings), w as (select i, label, var_pop(v) * count(*) as ss from u group by 1, 2), t as (select i, var_pop(v) * count(*) as ss from u group by 1)
select {r('(select sum(ss) from w)', 4)} as within_ss, {r('(select sum(ss) from t)', 4)} as total_ss, {r('1 - (select sum(ss) from w) / (select sum(ss) from t)')} as eta2""")
def variance_explained(t):
    out = ve.variance_explained(t.embeddings, "embedding", "label")
    return rounded(out.select(F.round("within_ss", 4).alias("within_ss"), F.round("total_ss", 4).alias("total_ss"), "eta2"))


_CKA = """u as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings), c as (select vec_id, i, v - avg(v) over (partition by i) as v from u),
  x as (select vec_id, i, v from c where i <= 32), y as (select vec_id, i, v from c where i > 32), xy as (select x.i, y.i as j, sum(x.v * y.v) as s from x join y using (vec_id) group by 1, 2),
  xx as (select a.i, b.i as j, sum(a.v * b.v) as s from x a join x b using (vec_id) group by 1, 2), yy as (select a.i, b.i as j, sum(a.v * b.v) as s from y a join y b using (vec_id) group by 1, 2)"""


@query("linear_cka", f"""
with {_CKA} select (select count(*) from embeddings) as n, {r('(select sum(s * s) from xy) / (sqrt((select sum(s * s) from xx)) * sqrt((select sum(s * s) from yy)))')} as cka""")
def linear_cka(t):
    rows = t.embeddings.select("vec_id", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    return rounded(ve.linear_cka(rows, "x", "y", 32, 32))


@query("contrast_vector", f"""
with u as (select label % 2 as half, vec_id, 1.0 + label as w, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings)
select half, cast(i as int) as component, {r('sum(w * v) / sum(w) - avg(v)')} as value from u group by 1, 2""")
def contrast_vector(t):
    rows = t.embeddings.select((F.col("label") % 2).alias("half"), "embedding", (1.0 + F.col("label")).alias("w"))
    return rounded(ve.contrast_vector(rows, "embedding", "w", ["half"]))


@query("split_half_cosine", f"""
with u as (select vec_id % 2 as half, 1.0 + label as w, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings), c as (select half, i, sum(w * v) / sum(w) - avg(v) as c from u group by 1, 2),
p as (select i, max(case when half = 0 then c end) as a, max(case when half = 1 then c end) as b from c group by 1)
select {r('sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))')} as split_half_cosine, {r('sqrt(sum(a * a))')} as length_a, {r('sqrt(sum(b * b))')} as length_b from p""")
def split_half_cosine(t):
    rows = t.embeddings.select("vec_id", "embedding", (1.0 + F.col("label")).alias("w"))
    return rounded(ve.split_half_cosine(rows, "embedding", "w", F.col("vec_id") % 2))


@query("dimension_join", f"""
with {_CEN}, j as (select e.vec_id, list_concat(list_concat(a.c, b.c), list_transform(list_zip(a.c, b.c), lambda z: z[2] - z[1])) as v from embeddings e join c a on a.label = e.label join c b on b.label = (e.label + 1) % 10)
select vec_id, len(v) as size, {r('list_sum(list_transform(v, lambda x: abs(x)))', 5)} as l1 from j""")
def dimension_join(t):
    models = ve.centroids(t.embeddings, ["label"], "embedding")
    origin, target = models.select("label", F.col("centroid").alias("o")), models.select(F.col("label").alias("to"), F.col("centroid").alias("t"))
    rows = t.embeddings.select("vec_id", "label", ((F.col("label") + 1) % 10).alias("to")).join(origin, "label").join(target, "to")
    rows = rows.select("vec_id", ve.concatenated_pair("o", "t").alias("v"))
    return rounded(rows.select("vec_id", F.size("v").cast("long").alias("size"), F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.abs(x)).alias("l1")), 5)


@query("vector_map_eval")
def vector_map_eval(t):
    """The second half of every vector from its first half; the 64 components are all read."""
    rows = t.embeddings.select("vec_id", "label", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    return rounded(ve.vector_map_eval(rows, "x", "y", 32, F.col("vec_id") % 4 != 0, "label", 1.0, 32), 5)


# ---- fitted classifiers (Spark ML)

@query("logistic_probe")
def logistic_probe(t):
    rows = t.embeddings.select("vec_id", (F.col("label") < 5).cast("double").alias("y"), "embedding", (F.col("vec_id") % 20).alias("cluster"))
    return rounded(pb.logistic_probe(rows, "vec_id", "embedding", "y", "cluster", F.col("vec_id") % 4 != 0), 3)


@query("tree_classifier")
def tree_classifier(t):
    rows = t.embeddings.select("vec_id", F.col("label").cast("double").alias("y"), "embedding", (F.col("vec_id") % 20).alias("cluster"))
    return rounded(pb.tree_classifier(rows, "vec_id", "embedding", "y", "cluster", 0.25, trees=20), 3)


@query("triple_scoring")
def triple_scoring(t):
    """Whole vectors against whole class centroids."""
    models = ve.centroids(t.embeddings, ["label"], "embedding").select("label", F.col("centroid").alias("profile"))
    rows = t.embeddings.select("vec_id", "label", "embedding")
    return rounded(pb.triple_scoring(rows, models, "vec_id", "embedding", "label", "profile", F.col("label") < 7, negatives=2), 3)


_EDGES = ", ".join(repr(e) for e in tr.bin_edges(8))
_RANKERS = f"""e as (select vec_id as k, label, i, cast(embedding[i] as double) as x from embeddings, (select unnest(range(1, 65)) as i)),
cl as (select label, row_number() over (order by label) - 1 as no, count(*) over () as c from (select distinct label from embeddings)),
q as (select no, i, avg(x) as q from e join cl using (label) group by 1, 2),
rw as (select vec_id as k, no, c, vec_id % 3 as g from embeddings join cl using (label)),
pr as (select k, no, g, no as cand from rw union select k, no, g, (no + 1 + {drawn(0, 'k', 't')} % (c - 1)) % c from rw, (select unnest(range(2)) as t)),
fx as (select p.*, e.i, unnest([0, 1, 2]) as b, unnest([x, q, x - q]) as v from pr p join e on e.k = p.k join q on q.no = p.cand and q.i = e.i),
ms as (select i, b, avg(v) as m, stddev_samp(v) as sd from fx group by all),
cn as (select no, cand, g, i, b, list_sum(list_transform([{_EDGES}], lambda t: case when round((v - m) / sd, 9) >= t then 1 else 0 end)) as bin, count(*) as n from fx join ms using (i, b) group by all),
te as (select r.k, r.no, r.g, a.no as cand, e.i, unnest([0, 1, 2]) as b, unnest([x, q, x - q]) as v from rw r join e on e.k = r.k join q a on a.i = e.i),
tb as (select k, no, g, cand, i, b, list_sum(list_transform([{_EDGES}], lambda t: case when round((v - m) / sd, 9) >= t then 1 else 0 end)) as bin from te join ms using (i, b))"""


def _ranked_by(trains, tests, splits):
    """SQL of the rankings under splits (``s``): counts that train, log ratios, block sums, ranks."""
    return f"""sp as ({splits}), al as (select distinct s, i, b, bin from sp, (select unnest(range(1, 65)) as i), (select unnest(range(3)) as b), (select unnest(range(8)) as bin)),
w0 as (select s, i, b, bin, sum(n) filter (no = cand) as t, sum(n) filter (no <> cand) as d from cn join sp on {trains} group by all),
w1 as (select s, i, b, bin, coalesce(t, 0) as t, coalesce(d, 0) as d from al left join w0 using (s, i, b, bin)),
w as (select s, i, b, bin, ln(t + 1) - ln(sum(t) over z + 8) - ln(d + 1) + ln(sum(d) over z + 8) as w from w1 window z as (partition by s, i, b)),
sc as (select w.s, k, no, cand, w.b, sum(w) as v from tb join sp on {tests} join w on w.s = sp.s and w.i = tb.i and w.b = tb.b and w.bin = tb.bin group by all),
fs as (select unnest(['vector', 'profile', 'difference', 'vector+profile', 'full']) as feature_set, unnest([[0], [1], [2], [0, 1], [0, 1, 2]]) as bs),
sm as (select feature_set, s, k, no, cand, round(sum(v), 6) as v from sc join fs on list_contains(bs, b) group by all),
rk as (select a.feature_set, a.s, a.k, 1 + count(o.cand) as r from sm a left join sm o on o.feature_set = a.feature_set and o.s = a.s and o.k = a.k and (o.v > a.v or (o.v = a.v and o.cand < a.cand)) where a.no = a.cand group by all)
select s as split, feature_set, cast(count(*) as bigint) as n, {r('avg(case when r <= 1 then 1.0 else 0 end)', 4)} as top1, {r('avg(case when r <= 3 then 1.0 else 0 end)', 4)} as top3, {r('avg(1.0 / r)', 4)} as mrr from rk group by all"""


def _profiled(t):
    rows = t.embeddings.select("vec_id", "label", "embedding", (F.col("vec_id") % 3).cast("string").alias("site"))
    return rows, ve.centroids(t.embeddings, ["label"], "embedding").select("label", F.col("centroid").alias("profile"))


@query("class_transfer", f"""
with {_RANKERS}, {_ranked_by('no <> sp.h and cand <> sp.h', 'tb.no = sp.h', 'select cast(label as varchar) as s, no as h from cl')}""")
def class_transfer(t):
    """Every class held out in turn, for every set of features."""
    rows, classes = _profiled(t)
    return rounded(tr.evaluate_rankers(rows, classes, "vec_id", "embedding", "label", "profile"), 4)


@query("group_transfer", f"""
with {_RANKERS}, {_ranked_by('cn.g = sp.a', 'tb.g = sp.z', "select cast(a as varchar) || ' to ' || cast(z as varchar) as s, a, z from (select unnest(range(3)) as a), (select unnest(range(3)) as z) where a <> z")}""")
def group_transfer(t):
    """Trained on one third of the rows, tested on another, for every set of features."""
    rows, classes = _profiled(t)
    return rounded(tr.evaluate_rankers(rows, classes, "vec_id", "embedding", "label", "profile", "groups", "site"), 4)


# ---- time order

@query("forward_validation", """
with a as (select user_id, ts, value, event_id from events where event_type = 'view'), b as (select user_id, ts, event_id, value from events where event_type = 'purchase'),
j as (select b.user_id, b.event_id, arg_max(a.value, (a.ts, a.value)) as score, max(a.ts) as score_ts, max(b.value) as outcome from b join a on a.user_id = b.user_id and a.ts < b.ts group by 1, 2)
select user_id, event_id, score, epoch_us(score_ts) as score_us from j""")
def forward_validation(t):
    events = t.events.select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    scores = events.filter("event_type = 'view'").select("user_id", F.col("us").alias("score_us"), F.col("value").alias("score"))
    outcomes = events.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("outcome_us"), "event_id")
    return st.forward_pairs(scores, outcomes, "user_id", "score_us", "outcome_us", "score", "event_id")


@query("rolling_audit", f"""
with e as (select event_type, epoch_us(ts) // 21600000000 * 21600000000 as w, value as x, cast(regexp_extract(props, '[0-9]+') as double) as y from events)
select w as window_us, event_type, cast(count(*) as bigint) as n, {r('covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)', 5)} as pearson from e group by 1, 2 having count(*) >= 3""")
def rolling_audit(t):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    out = st.pearson_from_sums(st.rolling_sums(rows, "ts", "x", "y", ["event_type"], "6 hours")).filter("n >= 3")
    return rounded(out.select(F.unix_micros("window.start").alias("window_us"), "event_type", "n", "pearson"), 5)


@query("binned_auc", f"""
with e as (select event_type, epoch_us(ts) // 86400000000 * 86400000000 as w, least(greatest(floor(value / 5), 0), 99) as b, case when cast(regexp_extract(props, '[0-9]+') as int) >= 50 then 1 else 0 end as y from events),
h as (select event_type, w, b, sum(y) as p, sum(1 - y) as q from e group by 1, 2, 3), c as (select *, coalesce(sum(q) over (partition by event_type, w order by b rows between unbounded preceding and 1 preceding), 0) as bl from h)
select w as window_us, event_type, cast(sum(p) as bigint) as n_pos, cast(sum(q) as bigint) as n_neg, {r('sum(p * (bl + q / 2.0)) / nullif(sum(p) * sum(q), 0)')} as binned_auc from c group by 1, 2""")
def binned_auc(t):
    label = (F.get_json_object("props", "$.k").cast("int") >= 50).cast("int").alias("y")
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", label)
    out = st.binned_auc(st.rolling_histogram(rows, "ts", "value", "y", (0.0, 500.0, 100), ["event_type"], "1 day"), ["event_type"])
    return rounded(out.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n_pos", "n_neg", "binned_auc"))

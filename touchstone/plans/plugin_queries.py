"""Extension points on the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from touchstone.functions import edits as ed
from touchstone.functions.numeric import register_sql_functions
from touchstone.operators import agreement as ag
from touchstone.operators import plugins as pg
from touchstone.operators import ranks
from touchstone.operators import sequences as sq
from touchstone.plans.registry import arank, binom_p, query, r, rounded, scorr


@F.pandas_udf(DoubleType())
def _word_count(text: pd.Series) -> pd.Series:
    return text.str.split(" ").str.len().astype(float)


@query("score_distinct", "select doc_id, cast(len(string_split(text, ' ')) as double) as score from documents")
def score_distinct(t):
    return pg.score_distinct(t.documents.select("doc_id", "text"), "text", _word_count).select("doc_id", "score")


@query("oriented_baselines", f"""
with lg as (select p_brand, 'p_size' as score_name, p_size * -1.0 as s, p_retailprice as y from part union all select p_brand, 'len', length(p_name) * 1.0, p_retailprice from part),
k as (select *, {arank('s', 'p_brand, score_name')} as rs, {arank('y', 'p_brand, score_name')} as ry from lg), n as (select p_brand, count(*) as n from part group by 1 having count(*) >= 5)
select k.p_brand, score_name, cast(max(n) as bigint) as n, cast(count(*) as bigint) as n_score, {r(scorr('rs', 'ry'))} as rho from k join n on n.p_brand = k.p_brand group by 1, 2""")
def oriented_baselines(t):
    rows = t.part.select("p_brand", "p_size", F.length("p_name").alias("len"), "p_retailprice")
    return rounded(ag.within_group_rank(pg.oriented(rows, {"p_size": -1, "len": 1}), ["p_size", "len"], "p_retailprice", ["p_brand"]))


@query("validate_reference", """
with v as (select p_type, p_name, upper(substr(p_name, 1, 1)) as w from part), rf as (select p_type, upper(min(p_name)) as ref from part group by 1)
select v.p_type, cast(count(*) as bigint) as rows, cast(sum(case when substr(ref, 1, 1) <> w then 1 else 0 end) as bigint) as dropped from v join rf on rf.p_type = v.p_type group by 1""")
def validate_reference(t):
    name = F.concat(F.substring(F.upper("p_name"), 1, 1), F.lit("1Z"))
    rows = t.part.select("p_type", ed.parse_edits(name).alias("e"))
    targets = t.part.groupBy("p_type").agg(F.upper(F.min("p_name")).alias("ref"))
    _, drops = pg.validate_reference(rows, targets, ["p_type"], "e", "ref")
    return drops


@query("combined_metrics", f"""
with k as (select o_orderpriority, {arank('o_totalprice', 'o_orderpriority')} as rx, {arank('o_custkey', 'o_orderpriority')} as ry, o_totalprice, o_custkey from orders)
select o_orderpriority, {r(scorr('rx', 'ry'))} as rho, {r(scorr('o_totalprice', 'o_custkey'))} as pearson, cast(max(rx) as double) as top_rank from k group by 1""")
def combined_metrics(t):
    from touchstone.functions.numeric import safe_corr

    rows = t.orders.select("o_orderpriority", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    ranked = ranks.average_ranks(rows, ["o_orderpriority"], ["o_totalprice", "o_custkey"])
    return rounded(pg.combine_metrics(ranked, ["o_orderpriority"], {
        "rho": safe_corr("rank_o_totalprice", "rank_o_custkey"), "pearson": safe_corr("o_totalprice", "o_custkey"), "top_rank": F.max("rank_o_totalprice")}))


@query("sql_functions", f"""
with c as (select p_type, cast(sum(case when p_size > 25 then 1 else 0 end) as int) as k, cast(count(*) as int) as n from part group by 1)
select p_type, k, n, {r(binom_p('k', 'n'))} as p, {r('k * 100.0 / (n * 1.0 * n)')} as enriched from c""")
def sql_functions(t):
    register_sql_functions(t.spark)
    counts = t.part.groupBy("p_type").agg(F.sum((F.col("p_size") > 25).cast("int")).cast("int").alias("k"), F.count(F.lit(1)).cast("int").alias("n"))
    return rounded(counts.selectExpr("p_type", "k", "n", "binom_two_sided(k, n) as p", "enrichment(double(k), double(n), 100D) as enriched"))


@query("letter_vectors", """
select p_partkey, cast(27 * (select max(length(p_name)) from part) as int) as size, cast(length(regexp_replace(p_name, '[^a-z ]', '', 'g')) as double) as known_letters from part""")
def letter_vectors(t):
    """Indicator vectors of letters by place: their size and how many places hold a letter of the alphabet."""
    from pyspark.ml.functions import vector_to_array

    rows = sq.letter_vectors(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", alphabet="abcdefghijklmnopqrstuvwxyz ")
    cells = rows.select("p_partkey", vector_to_array("features").alias("cells"))
    return cells.select("p_partkey", F.size("cells").alias("size"), F.size(F.array_remove("cells", 0.0)).cast("double").alias("known_letters"))


@query("edit_descriptors", """
with l as (select p_partkey as k, chr(cast(65 + p_partkey % 20 as int)) as a, chr(cast(65 + p_size % 20 as int)) as b from part),
vol(l, v) as (values ('A', 88.6), ('C', 108.5), ('D', 111.1), ('E', 138.4), ('F', 189.9), ('G', 60.1), ('H', 153.2), ('I', 166.7), ('K', 168.6), ('L', 166.7), ('M', 162.9), ('N', 114.1), ('P', 112.7), ('Q', 143.8), ('R', 173.4), ('S', 89.0), ('T', 116.1), ('V', 140.0), ('W', 227.8), ('Y', 193.6))
select k, case when a = 'A' and b = 'D' then -2.0 else 0.0 end::double as pair, round(coalesce(y.v, 0) - coalesce(x.v, 0), 6) + 0.0::double as d_volume, round(abs(coalesce(y.v, 0) - coalesce(x.v, 0)), 6) + 0.0::double as abs_volume
from l left join vol x on x.l = a left join vol y on y.l = b""")
def edit_descriptors(t):
    letter = lambda c: F.chr(65 + c % 20)
    rows = t.part.select(F.col("p_partkey").alias("k"), ed.parse_edits(F.concat(letter(F.col("p_partkey")), F.lit("5"), letter(F.col("p_size")))).alias("e"))
    return rounded(sq.edit_descriptors(rows, "k", "e", {("A", "D"): -2.0}).select("k", "pair", "d_volume", "abs_volume"))

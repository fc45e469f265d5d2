"""Tables written by the library's sinks and read back by its readers, and baseline score columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchstone.functions.tables import HYDROPATHY
from touchstone.operators import sequences as sq
from touchstone.plans.registry import query, r, rounded
from touchstone.settings import scratch
from touchstone.sources import readers as rd
from touchstone.sources import writers as wr

_ORDERS = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("delimited_rows", f"""
select o_orderpriority, cast(count(*) as bigint) as n, cast(sum(o_custkey) as bigint) as customers, {r('avg(o_totalprice)', 4)} as mean_price from orders group by 1""")
def delimited_rows(t):
    """All orders as compressed delimited text and back."""
    path = scratch(t.spark)
    _orders(t).write.option("header", True).option("sep", ";").option("compression", "gzip").csv(path)
    rows = rd.read_delimited(t.spark, path, ";", _ORDERS)
    return rounded(rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers"), F.avg("o_totalprice").alias("mean_price")), 4)


@query("written_report", f"""
select o_orderpriority, o_orderstatus, cast(count(*) as bigint) as n, {r('avg(o_totalprice)', 4)} as mean_price from orders group by 1, 2""")
def written_report(t):
    """A report in one folder per priority, written over an older one, and read back."""
    path = scratch(t.spark)
    report = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"))
    wr.write_report(report.limit(1), path, partition_by=["o_orderpriority"])
    wr.write_report(report, path, partition_by=["o_orderpriority"])
    return rounded(t.spark.read.parquet(path).select("o_orderpriority", "o_orderstatus", "n", "mean_price"), 4)


@query("merged_results", """
select o_orderstatus = 'F' as first_run, cast(count(*) as bigint) as n, cast(sum(o_custkey) as bigint) as customers, cast(count(case when o_orderstatus = 'F' then o_totalprice end) as bigint) as priced,
  cast(count(case when o_orderstatus <> 'F' then o_orderpriority end) as bigint) as ranked from orders group by 1""")
def merged_results(t):
    """Two result sets with different columns in different order, merged by name."""
    path = scratch(t.spark)
    done = F.col("o_orderstatus") == "F"
    t.orders.filter(done).select("o_orderkey", "o_custkey", "o_totalprice", done.alias("first_run")).write.parquet(f"{path}/one")
    t.orders.filter(~done).select("o_orderpriority", done.alias("first_run"), "o_custkey", "o_orderkey").write.parquet(f"{path}/two")
    rows = wr.merge_files(t.spark, f"{path}/*", "parquet")
    return rows.groupBy("first_run").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers"), F.count("o_totalprice").alias("priced"), F.count("o_orderpriority").alias("ranked"))


@query("study_rows", f"""
with s as (select 'region_' || n_regionkey as study, c_custkey, c_acctbal, case when n_regionkey % 2 = 0 then c_mktsegment end as segment from customer join nation on n_nationkey = c_nationkey)
select study, cast(count(*) as bigint) as n, {r('avg(c_acctbal)', 4)} as mean_balance, cast(count(segment) as bigint) as segments from s group by 1""")
def study_rows(t):
    """One folder of files per region, of which some lack a column; the study comes from the folder's name."""
    path = scratch(t.spark)
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    regions = range(5)
    for region in regions:
        columns = ["c_custkey", "c_acctbal", *(["c_mktsegment"] if region % 2 == 0 else [])]
        rows.filter(F.col("n_regionkey") == region).select(*columns).write.option("header", True).csv(f"{path}/region_{region}")
    rows, _ = rd.read_study_files(t.spark, [f"{path}/region_{region}" for region in regions], "c_custkey")
    return rounded(rows.groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean_balance"), F.count("c_mktsegment").alias("segments")), 4)


_VALUES = ", ".join(f"('{a}', {v!r})" for a, v in HYDROPATHY.items())


@query("cheap_scores", f"""
with h as (select * from (values {_VALUES}) v(a, v)), d as (select doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as s from documents), l as (select doc_id, unnest(string_split(s, '')) as a from d where s <> ''),
m as (select doc_id, sum(coalesce(v, 0)) as total from l left join h using (a) group by 1)
select doc_id, cast(length(s) as int) as seq_len, {r('total / nullif(length(s), 0)')} as mean_hydropathy from d left join m using (doc_id)""")
def cheap_scores(t):
    """Length and mean letter property of whole texts, which know nothing of a target."""
    rows = t.documents.select("doc_id", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("sequence"))
    return rounded(sq.cheap_scores(rows, "sequence").select("doc_id", "seq_len", "mean_hydropathy"))

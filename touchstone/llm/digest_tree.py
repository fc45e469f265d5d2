"""Exact duplicates: sorted runs of digests, merged up a tree and read back down."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import SPACES, partitions, settle, whole_text


def exact_groups(docs: DataFrame, fan_in_bits: int = 4) -> DataFrame:
    """Groups of documents whose texts are equal once white space ``[\\x20\\x09-\\x0D]`` is deleted.

    Returns one row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.  Of a group stays
    the row with the most code points in its original text, then the smallest doc_id (null last).

    Method: every row starts in one of 2^m runs (by a hash of its row number, so copies are spread); a run is sorted by
    digest and holds one entry per distinct digest.  In each round runs meet in groups of ``2^fan_in_bits`` that differ in
    the next bits of the run number, exchanging halves of the digest space: the entry moves to the run whose next bits are
    those of its digest, and a sort-merge aggregate keeps the best entry and adds the counts.  After all rounds one entry
    per digest is left.  Each merge also compares the check values (length and a second hash) of what meets under a digest
    and fails on a difference.  The result goes down to the first runs, at most one entry per run and digest, so that a
    digest with a third of all rows is never one task's.

    Null text counts as empty; empty and blank texts form one group.  Of identical repeated rows exactly one is kept.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bits = max(1, math.ceil(math.log2(partitions(spark))))
    text = whole_text(docs)
    squeezed = F.translate(text, SPACES, "")
    seen = settle(
        docs.select("doc_id", squeezed.alias("t"), F.length(text).cast("long").alias("points"))
        .select("doc_id", F.sha2("t", 256).alias("text_sha256"), "points",
                F.struct(F.length("t").alias("n"), F.xxhash64("t").alias("x")).alias("check"),
                F.monotonically_increasing_id().alias("row_no"))
        .withColumn("run", F.pmod(F.xxhash64("row_no"), F.lit(1 << bits)).cast("int")))
    best = F.struct((-F.col("points")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                    F.col("row_no"))
    runs = (seen.groupBy("run", "text_sha256")
            .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"),
                 F.min("check").alias("low"), F.max("check").alias("high")))
    aim = F.conv(F.substring("text_sha256", 1, 7), 16, 10).cast("int")  # the run that a digest ends in
    merged = runs
    for low in range(0, bits, fan_in_bits):
        mask = ((1 << min(fan_in_bits, bits - low)) - 1) << low
        merged = (merged
                  .withColumn("run", F.col("run").bitwiseAND(F.lit(~mask)).bitwiseOR(aim.bitwiseAND(F.lit(mask))))
                  .groupBy("run", "text_sha256")
                  .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"),
                       F.min("low").alias("low"), F.max("high").alias("high")))
    root = merged.select(
        "text_sha256", "best", "group_size",
        F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two texts share a digest"))).alias("clash"))
    # Down the tree: the verdict of a digest reaches each first run that holds it, then the rows of that run.
    down = (seen.select("run", "text_sha256").distinct().join(root, "text_sha256")
            .select("run", "text_sha256", F.col("best.id").alias("keep_id"), F.col("best.row_no").alias("keep_row"),
                    "group_size", "clash"))
    return (seen.join(down, ["run", "text_sha256"])
            .select("doc_id", "keep_id", "group_size",
                    (F.col("clash").isNull() & (F.col("row_no") == F.col("keep_row"))).alias("kept"), "text_sha256"))


OP9_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept,
       text_sha256
from d
window w as (partition by text_sha256 order by points desc, doc_id)
"""

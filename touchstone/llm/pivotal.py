"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchstone.llm.common import discard, partitions, settle, whole_text

GROUP_ROWS = 4096  # documents of a source in a leaf of the tree
FAN_IN = 256  # residuals that meet in an inner node
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
MOST = 3  # copies of a document, and so times its source's size
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``rank``, ``rows``, ``source_size``, ``target`` from rows (``source``, ``size``).

    Sources in order of code points, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes by weight.  A
    target stops at three times its source's size; what it leaves is shared again by weight until none is above.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    # Numbered without one task for all: ranges of sources, and the number of sources in the ranges before.
    ranges = settle(sums.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, start = {}, 0
    for r in ranges.groupBy("part").count().orderBy("part").collect():  # one row per partition
        before[r["part"]], start = start, start + r["count"]
    offset = F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(max(before, default=0) + 1)]), F.col("part"))
    weigh = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.col("rank"), F.lit(len(WEIGHTS))).cast("int"))
    sources = settle(
        ranges.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + offset)
        .withColumn("weight", weigh).select("source", "rank", "weight", "rows", "source_size"))
    discard(ranges)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    capped, weight, level = 0, None, 0.0
    while True:
        full = F.col("source_size") * MOST <= F.col("weight") * F.lit(level) if weight is not None else F.lit(False)
        row = sources.agg(F.sum(F.when(full, F.col("source_size") * MOST).otherwise(0)).alias("capped"),
                          F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if (row["capped"], row["weight"]) == (capped, weight) or not row["weight"]:
            break
        capped, weight = row["capped"], row["weight"]
        level = (total - capped) / weight
    target = F.least((F.col("source_size") * MOST).cast("double"), F.col("weight") * F.lit(float(level)))
    return sources.withColumn("target", target)


def _round(final: bool, names: list[str]):
    """Pivotal rounding along each group (``rank``, ``bucket``); one residual at most leaves a group undecided."""

    def settle_pair(c_size: int, c_f: float, d_size: int, d_f: float, u: float) -> tuple[float, float]:
        """Transfer mass between two documents at random, keeping both expectations and the words taken."""
        up, down = min(c_size * (1 - c_f), d_size * d_f), min(c_size * c_f, d_size * (1 - d_f))
        if u * (up + down) < down:  # the first gains
            return (1.0, max(0.0, d_f - up / d_size)) if c_size * (1 - c_f) <= d_size * d_f else (min(1.0, c_f + up / c_size), 0.0)
        return (0.0, min(1.0, d_f + down / d_size)) if c_size * c_f <= d_size * (1 - d_f) else (max(0.0, c_f - down / c_size), 1.0)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carry, carry_row = None, None, None  # carry: size, fraction, dice

        def out(rows: pa.RecordBatch, extra: list, fraction: list) -> pa.RecordBatch:
            cols = [rows[c] for c in names if c != "fraction"]
            return pa.RecordBatch.from_arrays([*cols, pa.array(fraction, pa.float64()), pa.array(extra, pa.int32())],
                                              [*[c for c in names if c != "fraction"], "fraction", "extra"])

        def left(row: pa.RecordBatch, c: list) -> pa.RecordBatch:
            return out(row, [int(c[2] < c[1])], [None]) if final else out(row, [None], [c[1]])

        for batch in batches:
            n = batch.num_rows
            rank, bucket, size, fraction, dice = (batch[c].to_pylist() for c in ("rank", "bucket", "size", "fraction", "dice"))
            extra: list = [None] * n
            at = -1  # row of this batch that is carried; -1: none or one of an earlier batch
            late = []
            for i in range(n):
                if (rank[i], bucket[i]) != group:
                    if carry is not None:
                        if at < 0:
                            late.append(left(carry_row, carry))
                        else:
                            late.append(left(batch.slice(at, 1), carry))
                            extra[at] = -1
                    group, carry, at = (rank[i], bucket[i]), None, -1
                f, u = fraction[i], ((dice[i] >> 11) & ((1 << 52) - 1)) / (1 << 52)
                if f <= 0 or f >= 1 or size[i] == 0:
                    extra[i] = int(u < f)
                elif carry is None:
                    carry, at = [size[i], f, u], i
                else:
                    c, d = settle_pair(carry[0], carry[1], size[i], f, u)
                    if c in (0.0, 1.0):
                        if at < 0:
                            late.append(out(carry_row, [int(c)], [None]))
                        else:
                            extra[at] = int(c)
                        carry = None
                    else:
                        carry[1] = c
                    if d in (0.0, 1.0):
                        extra[i] = int(d)
                    else:
                        carry, at = [size[i], d, u], i
            yield from late
            done = [i for i in range(n) if extra[i] is not None and extra[i] >= 0]
            if done:
                yield out(batch.take(pa.array(done)), [extra[i] for i in done], [None] * len(done))
            if carry is not None and at >= 0:
                carry_row = batch.slice(at, 1)
        if carry is not None:
            yield left(carry_row, carry)

    return go


def copies(docs: DataFrame, seed: int = 1) -> DataFrame:
    """How often the mix takes each document: ``doc_id``, ``source``, ``text_key``, ``size``, ``source_size``, ``target``, ``copies``.

    A source's documents are all due ``target / source_size`` copies.  The whole part is certain; the fractions are rounded
    by pivotal sampling: two documents meet, words are moved between their expected takings at random so that the sum and
    both expectations stay, until one of them is integral.  Groups of a source end with one residual each; residuals meet in
    the next level of the tree, the last one is drawn.  So a source's taken words miss its target by less than one document.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+``; null texts have 0 and are taken with 0 words.  Draws depend on the
    seed, the id and the text, so reruns agree.  A source of any share is cut into groups of about GROUP_ROWS documents.
    Repeated rows count each; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = settle(docs.select("doc_id", "source", F.xxhash64(whole_text(docs)).alias("text_key"),
                              F.regexp_count(whole_text(docs), F.lit(WORD)).cast("long").alias("size")))
    sources = settle(source_targets(rows.select("source", "size")).withColumn("groups", F.ceil(F.col("rows") / GROUP_ROWS)))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target", "groups")
    level = (rows.join(keyed, F.expr("source <=> _source")).drop("_source")
             .withColumn("dice", F.xxhash64("doc_id", "text_key", F.lit(seed)))
             .withColumn("bucket", F.pmod("dice", "groups"))
             .withColumn("dice", F.xxhash64("dice"))
             .withColumn("whole", F.floor(due).cast("int")).withColumn("fraction", due - F.floor(due)).drop("groups"))
    groups = sources.agg(F.max("groups")).first()[0] or 1
    order = ["doc_id", "source", "text_key", "size", "rank", "source_size", "target", "dice", "bucket", "whole", "fraction"]
    level = level.select(order)
    names = order
    kinds = level.schema.add("extra", "integer")
    parts = []
    while True:
        final = groups <= 1
        out = settle(level.repartition(partitions(spark), "rank", "bucket")
                     .sortWithinPartitions("rank", "bucket", F.col("size").desc(), "dice", "doc_id")
                     .mapInArrow(_round(final, names), kinds))
        parts.append(out.where("extra is not null"))
        if final:
            break
        groups = -(-groups // FAN_IN)
        level = (out.where("extra is null").drop("extra").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
                 .withColumn("dice", F.xxhash64("dice")).select(order))
    done = parts[0]
    for more in parts[1:]:
        done = done.union(more)
    discard(sources)
    return done.select("doc_id", "source", "text_key", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix itself: the documents, all their columns, each repeated as often as it is taken.

    Rows repeated under one id, source and text are one document with the copies of all.
    """
    taken = (copies(docs, seed).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("n")).where("n > 0")
             .select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_key").alias("_k"), F.col("n").alias("_n")))
    keyed = docs.withColumn("_key", F.xxhash64(whole_text(docs))).dropDuplicates(["doc_id", "source", "_key"])
    return (keyed.join(taken, F.expr("_key = _k and doc_id <=> _d and source <=> _s"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*docs.columns))


def op2(docs: DataFrame) -> DataFrame:
    """Digest of :func:`copies`: the words that the mix takes from each document."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

"""Structured Streaming forms of resumable appends, rolling audits and forward validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchstone.functions.numeric import finite
from touchstone.operators.agreement import auc_counts, spearman
from touchstone.sources.bucketed import append_bucketed
from touchstone.sources.writers import append_new


def append_new_stream(
    stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, trigger: dict | None = None, buckets: int | None = None,
) -> StreamingQuery:
    """Append rows with unseen keys from a stream; the result equals one batch append of all input.

    Each micro-batch anti-joins the sink, so a replayed batch after a failure adds nothing.  With ``buckets`` the sink is
    that of :func:`touchstone.sources.bucketed.append_bucketed`, and a micro-batch reads only parts that may hold its keys.
    """

    def add(batch: DataFrame, _epoch: int) -> None:
        if buckets:
            append_bucketed(batch, path, keys, buckets)
        else:
            append_new(batch, path, keys)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def deduplicated(stream: DataFrame, ts: str, keys: Sequence[str], lateness: str) -> DataFrame:
    """First row per key within the watermark; state is dropped past the lateness."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def rolling_sums(rows: DataFrame, ts: str, x: str, y: str, group: Sequence[str], length: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Centred moments of (x, y) per window and group, merged pairwise; works on batch and stream alike."""
    kept = rows.filter(finite(x) & finite(y))
    if lateness:
        kept = kept.withWatermark(ts, lateness)
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return kept.groupBy(window.alias("window"), *group).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.covar_pop(a, b).alias("cov"))


def pearson_from_sums(sums: DataFrame) -> DataFrame:
    vx, vy = F.col("vx"), F.col("vy")
    return sums.withColumn("pearson", F.when((vx > 0) & (vy > 0), F.col("cov") / (F.sqrt(vx) * F.sqrt(vy)))).drop("vx", "vy", "cov")


def rolling_histogram(rows: DataFrame, ts: str, score: str, label: str, edges: tuple[float, float, int], group: Sequence[str], length: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Positives and negatives per score bin, window and group: the additive sketch behind a binned AUC."""
    low, high, bins = edges
    kept = rows.filter(finite(score) & F.col(label).isin(0, 1))
    if lateness:
        kept = kept.withWatermark(ts, lateness)
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    place = F.least(F.greatest(F.floor((F.col(score) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    return kept.groupBy(window.alias("window"), *group, place.alias("bin")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("n_pos"), F.sum((F.col(label) == 0).cast("long")).alias("n_neg"))


def binned_auc(histogram: DataFrame, group: Sequence[str]) -> DataFrame:
    """AUC over score bins: approximate, since scores that share a bin count as ties."""
    flat = histogram.withColumn("window_start", F.col("window.start")).drop("window")
    return auc_counts(flat, ["window_start", *group], "bin", name="binned_auc", split=False)  # bins rows per group


def rolling_audit_stream(stream: DataFrame, ts: str, x: str, y: str, group: Sequence[str], length: str, lateness: str | None, path: str, checkpoint: str, slide: str | None = None) -> StreamingQuery:
    """Pearson per closed window, appended as windows pass the watermark.

    A stream that already carries a watermark (``deduplicated``) keeps it: give no lateness then.
    """
    sums = rolling_sums(stream, ts, x, y, group, length, slide, lateness)
    out = pearson_from_sums(sums).select(F.col("window.start").alias("window_start"), *group, "n", "pearson")
    writer = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def exact_audit_stream(stream: DataFrame, x: str, y: str, group: Sequence[str], store: str, report: str, checkpoint: str, key: Sequence[str]) -> StreamingQuery:
    """After every micro-batch: exact rank correlation of all rows measured so far.

    Ranks are not incremental, so each round is a batch job over the stored rows.
    """

    def audit(batch: DataFrame, epoch: int) -> None:
        append_new(batch, store, key)
        so_far = batch.sparkSession.read.parquet(store)
        spearman(so_far, x, y, group).withColumn("round", F.lit(epoch)).write.mode("overwrite").parquet(f"{report}/round={epoch}")

    return stream.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forward_pairs(scores: DataFrame, outcomes: DataFrame, entity: str, score_ts: str, outcome_ts: str, score: str, outcome_key: str) -> DataFrame:
    """Each outcome with the latest score of its entity that had arrived strictly before it.

    Both sides go through one sort per entity (an as-of join as a running maximum), not through a
    join of all scores with all outcomes of an entity.
    """
    from touchstone.operators.running import Total, running

    a = scores.select(entity, F.col(score_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(outcomes.schema[outcome_key].dataType).alias(outcome_key), F.struct(F.col(score_ts).alias("t"), F.col(score).alias("s")).alias("__seen"))
    b = outcomes.select(entity, F.col(outcome_ts).alias("__t"), F.lit(0).alias("__side"), F.col(outcome_key), F.lit(None).cast(a.schema["__seen"].dataType).alias("__seen"))
    both = a.unionByName(b).withColumn("__tie", F.coalesce(F.col("__seen.s").cast("string"), F.col(outcome_key).cast("string")))
    # At equal times outcomes sort first: a score must be strictly earlier.
    placed = running(both, [entity], ["__t", "__side", "__tie"], [Total("__last", "__seen", "max")])
    hit = placed.filter(F.col("__side") == 0)
    return hit.select(entity, outcome_key, F.col("__last.t").alias(score_ts), F.col("__last.s").alias(score)).filter(F.col(score).isNotNull())


def forward_join_stream(scores: DataFrame, outcomes: DataFrame, entity: str, score_ts: str, outcome_ts: str, lateness: str, horizon: str) -> DataFrame:
    """Stream-stream join of outcomes with scores that arrived before them, within a horizon."""
    a = scores.withWatermark(score_ts, lateness).withColumnRenamed(entity, f"__{entity}")
    b = outcomes.withWatermark(outcome_ts, lateness)
    before = (F.col(score_ts) < F.col(outcome_ts)) & (F.col(score_ts) >= F.col(outcome_ts) - F.expr(f"INTERVAL {horizon}"))
    return b.join(a, (F.col(entity) == F.col(f"__{entity}")) & before).drop(f"__{entity}")


def replay_source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, a few files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

"""Paired-intervention batteries: long deltas in, adjudicated contrasts out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.tails import binom_two_sided
from touchstone.operators.hypothesis import paired_interval
from touchstone.operators.resample import bootstrap_mean
from touchstone.operators.running import attach
from touchstone.settings import settled


def paired_deltas(real: DataFrame, perturbed: DataFrame, key: str, score: str = "score", name: str = "perturbation") -> DataFrame:
    """(key, perturbation, delta): real score minus perturbed score."""
    base = real.select(key, F.col(score).alias("__real"))
    return perturbed.join(base, key).select(key, name, (F.col("__real") - F.col(score)).alias("delta"))


def _verdict(expect: Column) -> Column:
    lo, hi, ref = F.col("ci_lo"), F.col("ci_hi"), F.col("reference_delta")
    resolved = F.coalesce(ref > 0, F.lit(False))
    directed = (
        F.when(lo > 0, "REPRESENTS").when(hi < 0, "INVERTED").when(resolved & (hi < ref), "NULL").otherwise("UNDERPOWERED"))
    indifferent = (
        F.when((lo > 0) | (hi < 0), "SENSITIVE")
        .when(resolved & (F.greatest(F.abs(lo), F.abs(hi)) < ref), "INVARIANT").otherwise("UNDERPOWERED"))
    return F.when(expect == "real_higher", directed).otherwise(indifferent)


def _adjudicate(df, value: str, by: Sequence[str], reference: DataFrame, expect: Column, group, distribution, key, replicates, seed, draws) -> DataFrame:
    d = F.col(value)
    stats = paired_interval(df, value, by, distribution)
    if key is not None:
        boot = bootstrap_mean(df, value, key, by, replicates, seed, draws=draws).select(*by, F.col("lo").alias("boot_lo"), F.col("hi").alias("boot_hi"))
        stats = attach(stats, boot, by)
    signs = df.filter(d.isNotNull()).groupBy(*by).agg(
        F.sum(F.when(d > 0, 1).otherwise(0)).alias("real_higher"), F.sum(F.when(d == 0, 1).otherwise(0)).alias("ties"))
    out = attach(attach(stats, signs, by), reference, group, "left" if group else "inner")
    out = out.withColumn("ratio_to_reference", F.when(F.col("reference_delta") != 0, F.col("mean") / F.col("reference_delta")))
    out = out.withColumn("verdict", _verdict(expect)).withColumn("passed", F.col("verdict").isin("REPRESENTS", "INVARIANT"))
    return out.withColumn("binom_p", binom_two_sided(F.col("real_higher"), F.col("n") - F.col("ties")))


def contrast_battery(
    deltas: DataFrame, expectations: DataFrame, reference: str, group: Sequence[str] = (), name: str = "perturbation",
    distribution: str = "t", key: str | None = None, replicates: int = 10_000, seed: int = 0, draws: str = "poisson",
) -> DataFrame:
    """Adjudicate every perturbation: mean delta, interval, sign count without ties, exact binomial p,
    ratio to the reference perturbation's mean delta and a verdict by declared expectation.

    ``expectations`` has (perturbation, expect) with expect "real_higher" or "no_preference".  With the
    units' ``key`` a percentile bootstrap interval (``boot_lo``, ``boot_hi``) stands beside the parametric
    one; all perturbations see the same draws.  Deltas that are made of joined tables are written once, as every figure
    reads them.
    """
    group, deltas = list(group), settled(deltas)
    ref = deltas.filter(F.col(name) == reference).groupBy(*group).agg(F.avg("delta").alias("reference_delta"))
    declared = deltas.join(expectations.select(name, "expect"), name)
    return _adjudicate(declared, "delta", [*group, name, "expect"], ref, F.col("expect"), group, distribution, key, replicates, seed, draws)


def matched_contrast(
    deltas: DataFrame, key: str, a: str, b: str, reference: str, group: Sequence[str] = (), name: str = "perturbation",
    distribution: str = "t", replicates: int = 10_000, seed: int = 0, draws: str = "poisson",
) -> DataFrame:
    """Difference of two paired deltas of the same unit (a minus b) under the same rule, with both intervals."""
    group, deltas = list(group), settled(deltas)
    ref = deltas.filter(F.col(name) == reference).groupBy(*group).agg(F.avg("delta").alias("reference_delta"))
    pick = lambda which: F.max(F.when(F.col(name) == which, F.col("delta")))
    wide = deltas.filter(F.col(name).isin(a, b)).groupBy(*group, key).agg(pick(a).alias("__a"), pick(b).alias("__b"))
    wide = wide.filter(F.col("__a").isNotNull() & F.col("__b").isNotNull()).withColumn("diff", F.col("__a") - F.col("__b"))
    out = _adjudicate(wide, "diff", group, ref, F.lit("real_higher"), group, distribution, key, replicates, seed, draws)
    return out.withColumn("a", F.lit(a)).withColumn("b", F.lit(b))


def claim_text(results: DataFrame, declarations: DataFrame, name: str = "perturbation") -> DataFrame:
    """The declared sentence that a verdict supports."""
    joined = results.join(declarations.select(name, "asks"), name, "left")
    claim = (
        F.when(F.col("verdict").isin("REPRESENTS", "SENSITIVE"), F.concat(F.lit("the score follows: "), "asks"))
        .when(F.col("verdict").isin("NULL", "INVARIANT"), F.concat(F.lit("the score does not follow: "), "asks"))
        .when(F.col("verdict") == "INVERTED", F.lit("prefers the perturbed text"))
        .otherwise(F.lit("cannot be decided at this number of units")))
    return joined.withColumn("claim", claim).drop("asks")


def replay_deltas(wide: DataFrame, key: str, prefix: str = "delta:", keep: DataFrame | None = None, name: str = "perturbation") -> DataFrame:
    """Stored wide per-unit deltas back to long form, optionally for a subset of keys only."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    rows = wide.join(keep.select(key), key, "left_semi") if keep is not None else wide
    renamed = rows.select(key, *[F.col(f"`{c}`").cast("double").alias(c[len(prefix):]) for c in columns])
    return renamed.unpivot([key], [c[len(prefix):] for c in columns], name, "delta").filter(F.col("delta").isNotNull())


def seed_variation(deltas: DataFrame, seed: str, name: str = "perturbation") -> DataFrame:
    """Spread of mean deltas over perturbation seeds."""
    from touchstone.operators.groups import draw_variance

    return draw_variance(deltas, [name], seed, "delta")



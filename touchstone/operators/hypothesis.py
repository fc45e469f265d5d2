"""Classical tests, intervals and multiple-testing adjustment on grouped data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from touchstone.functions.numeric import Z975, finite, t_critical
from touchstone.functions.tails import binom_two_sided, fisher_two_sided, normal_two_sided, normal_upper, t_quantile, t_two_sided
from touchstone.operators.ranks import value_counts
from touchstone.operators.running import Total, attach, numbered, running, with_group_totals
from touchstone.settings import needs_split


def welch_t(df, value: str, side: str, group: Sequence[str] = ()) -> DataFrame:
    """Unequal-variance t of side 1 against side 0 per group."""
    v = F.col(value).cast("double")
    rows = df.filter(finite(value))
    cells = []
    for s in (0, 1):
        x = F.when(F.col(side) == s, v)
        cells += [F.count(x).alias(f"n{s}"), F.avg(x).alias(f"mean{s}"), F.var_samp(x).alias(f"__v{s}")]
    out = rows.groupBy(*group).agg(*cells)
    e1, e0 = F.try_divide(F.col("__v1"), F.col("n1")), F.try_divide(F.col("__v0"), F.col("n0"))
    out = out.withColumn("__e", e1 + e0)
    out = out.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt("__e")))
    freedom = F.try_divide(F.col("__e") ** 2, e1**2 / (F.col("n1") - 1) + e0**2 / (F.col("n0") - 1))
    out = out.withColumn("df", F.when((F.col("n1") > 1) & (F.col("n0") > 1), freedom))
    return out.withColumn("p", t_two_sided("t", "df")).drop("__e", "__v0", "__v1")


def mann_whitney(df, value: str, side: str, group: Sequence[str] = (), alternative: str = "two-sided", split="auto") -> DataFrame:
    """Rank-sum U of side 1 with tie-corrected normal p (continuity correction).

    Computed from value counts: only distinct values are ordered.
    """
    group = list(group)
    rows = df.filter(finite(value)).withColumn("__v", F.col(value).cast("double"))
    hist = value_counts(rows, group, "__v", {
        "__a": F.sum(F.when(F.col(side) == 1, 1).otherwise(0)), "__b": F.sum(F.when(F.col(side) == 0, 1).otherwise(0))})
    run = running(hist, group, ["__v"], [Total("__below", "__b")], split)
    t = (F.col("__a") + F.col("__b")).cast("double")
    out = run.groupBy(*group).agg(
        F.sum("__a").alias("n1"), F.sum("__b").alias("n0"),
        F.sum(F.col("__a") * (F.coalesce("__below", F.lit(0)) + F.col("__b") / 2.0)).alias("u"), F.sum(t * t * t - t).alias("__ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.try_divide(F.col("__ties"), n * (n - 1))))
    mean = n1 * n0 / 2.0
    if alternative == "two-sided":
        z = F.try_divide(F.abs(F.col("u") - mean) - 0.5, sd)
        p = F.least(F.lit(1.0), 2 * normal_upper(z))
    elif alternative == "greater":
        z = F.try_divide(F.col("u") - mean - 0.5, sd)
        p = normal_upper(z)
    elif alternative == "less":
        z = F.try_divide(mean - F.col("u") - 0.5, sd)
        p = normal_upper(z)
    else:
        raise ValueError(alternative)
    return out.withColumn("z", z).withColumn("p", p).drop("__ties")


def signed_rank_tail(ranks: Sequence[int], counts: Sequence[int], low: int) -> float:
    """Two-sided p of the smaller signed-rank sum: chances of every sum of doubled ranks, each row's sign a fair coin.

    Ties have equal (doubled, integer) mean ranks and stay exact.
    """
    whole = sum(r * c for r, c in zip(ranks, counts, strict=True))
    chance = np.zeros(whole + 1)
    chance[0] = 1.0
    for r, c in zip(ranks, counts, strict=True):
        for _ in range(c):
            chance[r:] = (chance[r:] + chance[:len(chance) - r]) / 2
            chance[:r] /= 2
    return float(min(1.0, 2 * chance[:low + 1].sum()))


MOST_SIGNED = 500  # rows of a group for which the exact null is built


def wilcoxon_signed(df, difference: str, group: Sequence[str] = (), method: str = "normal", most: int = MOST_SIGNED, split="auto") -> DataFrame:
    """Signed-rank test of differences, zeros dropped: ``group, n, w_plus, w_minus, z, method, p``.

    ``method="normal"`` corrects the variance for ties; ``method="exact"`` counts sign sets, ties included, and refuses a
    group of more than ``most`` rows.  The method is the caller's, at every size.
    """
    if method not in ("normal", "exact"):
        raise ValueError(f"unknown method {method!r}")
    group = list(group)
    rows = df.filter(finite(difference) & (F.col(difference) != 0)).select(
        *group, F.abs(F.col(difference)).cast("double").alias("__d"), (F.col(difference) > 0).cast("int").alias("__up"))
    hist = value_counts(rows, group, "__d", {"__n": F.count(F.lit(1)), "__pos": F.sum("__up")})
    run = running(hist, group, ["__d"], [Total("__before", "__n")], split)
    before = F.coalesce("__before", F.lit(0))
    rank = before + (F.col("__n") + 1) / F.lit(2.0)
    t = F.col("__n").cast("double")
    out = run.groupBy(*group).agg(
        F.sum("__n").alias("n"), F.sum(F.col("__pos") * rank).alias("w_plus"),
        F.sum((F.col("__n") - F.col("__pos")) * rank).alias("w_minus"), F.sum(t * t * t - t).alias("__ties"))
    n = F.col("n").cast("double")
    low = F.least("w_plus", "w_minus")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("__ties") / 2.0) / 24.0)
    out = out.withColumn("z", F.try_divide(low - n * (n + 1) / 4.0, sd)).withColumn("method", F.lit(method))
    if method == "normal":
        return out.withColumn("p", normal_two_sided(F.col("z"))).drop("__ties")

    @F.pandas_udf(DoubleType())
    def tail(ranks: pd.Series, counts: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_tail([int(v) for v in r], [int(v) for v in c], int(w)) for r, c, w in zip(ranks, counts, low)])

    fits = out.withColumn("__low", F.when(F.col("n") <= most, (2 * low).cast("long")).otherwise(
        F.raise_error(F.concat(F.lit(f"a group of more than {most} rows has no exact null: n = "), F.col("n")))))
    # At most ``most`` distinct ranks meet in a group.
    blocks = attach(run.select(*group, (2 * before + F.col("__n") + 1).cast("long").alias("__r"), F.col("__n").alias("__c")), fits.select(*group, "__low"), group)
    blocks = blocks.filter("__low is not null").groupBy(*group, "__low").agg(F.collect_list(F.struct("__r", "__c")).alias("__b"))
    p = blocks.select(*group, tail(F.col("__b.__r"), F.col("__b.__c"), "__low").alias("p"))
    return attach(out.drop("__ties"), p, group, "left")


def sign_test(df, difference: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact binomial test of the share of positive differences; ties carry no sign."""
    d = F.col(difference)
    out = df.filter(finite(difference)).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(d > 0, 1).otherwise(0)).alias("positive"), F.sum(F.when(d == 0, 1).otherwise(0)).alias("ties"))
    return out.withColumn("p", binom_two_sided(F.col("positive"), F.col("n") - F.col("ties")))


def paired_t(df, difference: str, group: Sequence[str] = ()) -> DataFrame:
    """t test of the mean difference."""
    d = F.col(difference).cast("double")
    out = df.filter(finite(difference)).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"))
    out = out.withColumn("t", F.try_divide(F.col("mean"), F.col("se")))
    return out.withColumn("p", t_two_sided("t", F.when(F.col("n") > 1, F.col("n") - 1)))


def fisher_exact(df, row: str, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Two-sided exact test of a 2x2 table of 0/1 columns."""
    cell = lambda r, c: F.sum(F.when((F.col(row) == r) & (F.col(column) == c), 1).otherwise(0))
    out = df.groupBy(*group).agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    return out.withColumn("odds_ratio", F.try_divide((F.col("a") * F.col("d")).cast("double"), F.col("b") * F.col("c"))).withColumn(
        "p", fisher_two_sided("a", "b", "c", "d"))


def paired_interval(df, delta: str, group: Sequence[str] = (), distribution: str = "t") -> DataFrame:
    """Mean, standard error and a t or normal 95% interval of paired deltas."""
    if distribution not in ("t", "normal"):
        raise ValueError(f"unknown distribution {distribution!r}")
    d = F.col(delta).cast("double")
    out = df.filter(finite(delta)).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"))
    half = (t_critical(F.col("n") - 1) if distribution == "t" else F.lit(Z975)) * F.col("se")
    return out.withColumn("ci_lo", F.col("mean") - half).withColumn("ci_hi", F.col("mean") + half)


def adjust_pvalues(df, p: str, key: Sequence[str], group: Sequence[str] = (), prefix: str | None = None, split="auto") -> DataFrame:
    """Add ``<p>_fdr`` (Benjamini-Hochberg) and ``<p>_bonf`` inside each test family.

    Walking down from the largest p, the adjusted value is the running minimum of p * m / rank.
    """
    group, prefix = list(group), prefix or p
    rows = df.filter(F.col(p).isNotNull())
    if split == "auto":
        split = needs_split(rows, group)
    out = with_group_totals(rows, group, {"__m": F.count(F.lit(1))}, split)
    down = [(p, "desc"), *[(k, "desc") for k in key]]
    out = numbered(out, group, down, "__down", split)
    out = out.withColumn("__raw", F.col(p) * F.col("__m") / (F.col("__m") - F.col("__down") + 1))
    out = running(out, group, down, [Total("__adj", "__raw", "min", inclusive=True)], split)
    return out.withColumn(f"{prefix}_fdr", F.least(F.lit(1.0), F.col("__adj"))).withColumn(
        f"{prefix}_bonf", F.least(F.lit(1.0), F.col(p) * F.col("__m"))).drop("__m", "__down", "__raw", "__adj")


def flag_discoveries(df, ps: Sequence[str], treated: str, null: str, key, group=(), alpha: float = 0.05, split="auto") -> DataFrame:
    """Adjust several p columns; a row is significant when all pass and treated mean < null mean."""
    out = df
    for p in ps:
        out = adjust_pvalues(out, p, key, group, split=split)
    toward = F.col(treated) < F.col(null)
    both = lambda tag: toward & F.forall(F.array(*[F.col(f"{p}_{tag}") for p in ps]), lambda v: v < alpha)
    return out.withColumn("significant_fdr", both("fdr")).withColumn("significant_bonf", both("bonf"))


def detectable_effect(summary: DataFrame, n: str = "n", se: str = "se", reference: str | None = None) -> DataFrame:
    """Smallest effect found with 80% power at 5%: (t.975 + t.80) * SE, and its ratio to a reference."""
    out = summary.withColumn("mde", (t_critical(F.col(n) - 1) + t_quantile(0.8, F.col(n) - 1)) * F.col(se))
    return out.withColumn("mde_ratio", F.try_divide(F.col("mde"), F.abs(F.col(reference)))) if reference else out


def distance_shift(df, pair: str, profile: str, distance: str, treated: str, key: str, alpha: float = 0.05, permutations: int = 0, seed: int = 0) -> DataFrame:
    """Per (pair, profile): do treated draws lie nearer than null draws?

    ``treated`` is 1 for draws under the profile and 0 for the null draws of the pair.  Welch t and
    one-sided rank-sum p, and with ``permutations`` a one-sided label permutation p.
    """
    by = [pair, profile]
    t = welch_t(df, distance, treated, by).select(*by, F.col("mean1").alias("mean_treat"), F.col("mean0").alias("mean_null"), F.col("p").alias("t_p"))
    u = mann_whitney(df, distance, treated, by, "less").select(*by, F.col("p").alias("u_p"))
    out = attach(t, u, by)
    ps = ["t_p", "u_p"]
    if permutations:
        from touchstone.operators.resample import permutation_test

        perm = permutation_test(df, distance, treated, key, by, permutations, seed, "less").select(*by, F.col("p").alias("perm_p"))
        out, ps = attach(out, perm, by), [*ps, "perm_p"]
    passes = F.forall(F.array(*[F.col(p) for p in ps]), lambda v: v < alpha)
    return out.withColumn("significant_raw", passes & (F.col("mean_treat") < F.col("mean_null")))

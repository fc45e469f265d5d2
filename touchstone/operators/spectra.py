"""Channel spectra: counting, normalising, decomposing on profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from touchstone.functions.text import substitutions
from touchstone.operators.linear import gram
from touchstone.operators.running import attach, with_scalars
from touchstone.settings import BROADCAST_BYTES, setting, spread


def spectrum(pairs: DataFrame, a, b, group: Sequence[str], grid: DataFrame) -> DataFrame:
    """(group, context, n): folded substitution channels of equal-length pairs, zeros included."""
    group = list(group)
    found = spread(pairs).select(*group, F.explode(substitutions(a, b)).alias("context"))
    counts = found.groupBy(*group, "context").agg(F.count(F.lit(1)).alias("n"))
    return complete_grid(counts, pairs.select(*group).distinct(), group, "context", grid)


def complete_grid(counts: DataFrame, groups: DataFrame, group: Sequence[str], channel: str, grid: DataFrame, value="n") -> DataFrame:
    """Counts on the full channel grid.  The grid is fixed and small (it is one array per group)."""
    channels = grid.agg(F.sort_array(F.collect_list(grid.columns[0])).alias("__grid"))
    full = with_scalars(groups, channels).select(*group, F.explode("__grid").alias(channel))
    out = attach(full, counts, [*group, channel], "left")
    return out.withColumn(value, F.coalesce(value, F.lit(0)))


def normalise(profiles: DataFrame, profile: Sequence[str], value: str, name="share") -> DataFrame:
    """Each profile scaled to sum 1."""
    totals = profiles.groupBy(*profile).agg(F.sum(value).alias("__t"))
    return attach(profiles, totals, profile).withColumn(name, F.try_divide(F.col(value), F.col("__t"))).drop("__t")


def missing_channels(profiles: DataFrame, profile: str, channel: str, grid: DataFrame) -> DataFrame:
    """(profile, channel) cells a profile should have and lacks."""
    channels = grid.agg(F.collect_list(grid.columns[0]).alias("__grid"))
    full = with_scalars(profiles.select(profile).distinct(), channels).select(profile, F.explode("__grid").alias(channel))
    return full.join(profiles.select(profile, channel), [profile, channel], "left_anti")


def null_profile(profiles: DataFrame, profile: str, channel: str, value: str) -> DataFrame:
    """Mean over all profiles per channel; a channel that a profile lacks counts as zero there."""
    count = profiles.select(profile).distinct().agg(F.count(F.lit(1)).alias("__k"))
    sums = profiles.groupBy(channel).agg(F.sum(value).alias("__s"))
    return with_scalars(sums, count).select(channel, (F.col("__s") / F.col("__k")).alias(value))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by the active-set method (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gain = a.T @ b
    tol = 10 * max(a.shape) * np.finfo(float).eps * max(1.0, np.abs(a).sum(0).max(initial=0.0))
    for _ in range(3 * n + 10):
        slope = np.where(passive, -np.inf, gain)
        j = int(slope.argmax())
        if slope[j] <= tol:
            break
        passive[j] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min() > tol:
                break
            bad = passive & (s <= tol)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            passive &= x > tol
            x[~passive] = 0.0
            if not passive.any():
                break
        if passive.any():
            x = s
        gain = a.T @ (b - a @ x)
    return np.maximum(x, 0.0)


def _vectors(long: DataFrame, group: Sequence[str], channel: str, value: str, name: str) -> DataFrame:
    """Channel values as one array in channel order (a grid's length)."""
    listed = long.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(channel), F.col(value).cast("double").alias("v")))).alias("__l"))
    return listed.select(*group, F.transform("__l", lambda s: s["v"]).alias(name))


def _profile_matrix(profiles: DataFrame, profile: str, channel: str, value: str):
    """Profiles as (names, channels x profiles matrix).  A model, not data: its size is checked."""
    wide = _vectors(profiles, [profile], channel, value, "__v").orderBy(profile)
    limit = setting(profiles.sparkSession, BROADCAST_BYTES)
    size = profiles.count() * 8
    if size > limit:
        raise ValueError(f"profile matrix of {size} bytes exceeds the broadcast limit of {limit}")
    rows = wide.collect()
    return [r[profile] for r in rows], np.array([r["__v"] for r in rows], float).T


def signature_exposure(
    spectra: DataFrame, profiles: DataFrame, group: Sequence[str], profile: str, channel: str = "context",
    count: str = "n", share: str = "share",
) -> DataFrame:
    """(group, profile, exposure): non-negative fit of each normalised spectrum on the profiles.

    Exposures of a group sum to one; an empty spectrum gets zeros.  Groups are rows of Arrow
    batches; the profile matrix is broadcast after its size is checked.
    """
    names, matrix = _profile_matrix(profiles, profile, channel, share)
    shared = spectra.sparkSession.sparkContext.broadcast(matrix)

    def fit(v: pd.Series) -> pd.Series:
        out = []
        for s in v:
            s = np.asarray(s, float)
            total = s.sum()
            x = nnls(shared.value, s / total) if total > 0 else np.zeros(shared.value.shape[1])
            out.append(x / x.sum() if x.sum() > 0 else x)
        return pd.Series(out)

    vectors = _vectors(spectra, group, channel, count, "__v")
    fitted = vectors.withColumn("__x", F.pandas_udf(fit, ArrayType(DoubleType()))("__v"))
    labels = F.array(*[F.lit(n) for n in names])
    return fitted.select(*group, F.explode(F.arrays_zip(labels.alias(profile), F.col("__x").alias("exposure"))).alias("__c")).select(*group, "__c.*")


def family_exposure(exposures: DataFrame, group: Sequence[str], profile: str, members: Sequence) -> DataFrame:
    """Summed exposure of a family of profiles."""
    return exposures.groupBy(*group).agg(F.sum(F.when(F.col(profile).isin(*members), F.col("exposure")).otherwise(0.0)).alias("family_exposure"))


def profile_cosines(profiles: DataFrame, profile: str, channel: str, value: str) -> DataFrame:
    """(a, b, cosine) of all profile pairs a < b.  Profiles are a model's columns, so pairs are few."""
    norms = profiles.groupBy(profile).agg(F.sqrt(F.sum(F.col(value) ** 2)).alias("__n"))
    u = profiles.join(norms, profile).select(F.col(profile).alias("p"), channel, F.try_divide(F.col(value), F.col("__n")).alias("u"))
    pairs = u.withColumnsRenamed({"p": "a", "u": "x"}).join(u.withColumnsRenamed({"p": "b", "u": "y"}), channel).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


@F.pandas_udf(DoubleType())
def _condition(xtx: pd.Series, n: pd.Series) -> pd.Series:
    """Largest over smallest singular value from a moment matrix with a leading intercept; null where it is singular."""
    out = []
    for a, rows in zip(xtx, n):
        p = int(round(np.sqrt(len(a))))
        values = np.linalg.eigvalsh(np.asarray(a, float).reshape(p, p)[1:, 1:])[::-1]
        low = values[min(int(rows), len(values)) - 1] if len(values) else 0.0
        out.append(float(np.sqrt(values[0] / low)) if low > values[0] * 1e-13 else None)
    return pd.Series(out, dtype=object)


def profile_collinearity(profiles: DataFrame, profile: str, channel: str, value: str, high: float = 0.8) -> DataFrame:
    """Mean and largest pairwise cosine, pairs above ``high`` and the matrix condition number.

    Products of channels are added up over profiles inside tasks, so any number of profiles becomes one matrix of the
    channel grid's size; its eigenvalues are the squared singular values.  A singular matrix has no condition number.
    """
    vectors = _vectors(profiles, [profile], channel, value, "__v").withColumn("__zero", F.lit(0.0))
    moments = gram(vectors, "__v", ["__zero"]).select(_condition("xtx", "n").alias("condition_number"))
    out = profile_cosines(profiles, profile, channel, value).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("cosine").alias("mean_cosine"), F.max("cosine").alias("max_cosine"),
        F.sum((F.col("cosine") > high).cast("int")).alias("pairs_high"))
    return with_scalars(out, moments)


def top_partners(cosines: DataFrame, of, k: int = 3) -> DataFrame:
    """The k profiles most collinear with one profile."""
    partner = F.when(F.col("a") == F.lit(of), F.col("b")).when(F.col("b") == F.lit(of), F.col("a"))
    return cosines.select(partner.alias("partner"), "cosine").filter("partner IS NOT NULL").orderBy(F.desc("cosine"), "partner").limit(k)


def budget_stability(
    samples: DataFrame, group: Sequence[str], sample: str, profiles: DataFrame, profile: str, members: Sequence, budgets: Sequence[int],
    draws: int = 200, seed: int = 0, channel: str = "context", share: str = "share",
) -> DataFrame:
    """Per group and budget N: mean, interval and width of a family's exposure over N-sample draws.

    ``samples`` is (group, sample, context, n): per-sample spectra counted once; a draw only adds
    them up with multiplicities.  Budgets above the group's samples are left out.
    """
    from touchstone.functions.numeric import keyed_int
    from touchstone.operators.running import numbered

    group = list(group)
    units = numbered(samples.select(*group, sample).distinct(), group, [sample], "__rn")
    sizes = units.groupBy(*group).agg(F.max("__rn").alias("__n"))
    slots = sizes.withColumn("budget", F.explode(F.array(*[F.lit(int(b)) for b in budgets]))).filter(F.col("budget") <= F.col("__n"))
    slots = slots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("budget"))))
    slots = slots.withColumn("__rn", F.pmod(keyed_int(seed, *group, "budget", "draw", "__i"), F.col("__n")) + 1)
    weights = slots.groupBy(*group, "budget", "draw", "__rn").agg(F.count(F.lit(1)).alias("w"))
    drawn = attach(weights, units, [*group, "__rn"])
    spectra = attach(samples, drawn.select(*group, sample, "budget", "draw", "w"), [*group, sample])
    by = [*group, "budget", "draw"]
    spectra = spectra.groupBy(*by, channel).agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    grid = profiles.select(channel).distinct()
    spectra = complete_grid(spectra, spectra.select(*by).distinct(), by, channel, grid)
    exposures = family_exposure(signature_exposure(spectra, profiles, by, profile, channel, "n", share), by, profile, members)
    return exposures.groupBy(*group, "budget").agg(
        F.avg("family_exposure").alias("mean"), F.percentile("family_exposure", F.lit(0.025)).alias("lo"),
        F.percentile("family_exposure", F.lit(0.975)).alias("hi")).withColumn("width", F.col("hi") - F.col("lo"))



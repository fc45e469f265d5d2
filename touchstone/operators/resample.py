"""Bootstrap, permutation and cluster resampling.

Two kinds of draws, always the caller's choice and never the table's size: ``draws="poisson"``
gives every row independent keyed weights inside its task (:mod:`touchstone.operators.weights`),
``draws="units"`` draws n of n units with replacement, as a table of (group, replicate, unit,
multiplicity) whose rows are units (studies, clusters) rather than rows of the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.numeric import finite, keyed_int
from touchstone.operators.agreement import auc_counts, spearman
from touchstone.operators.ranks import value_ranks
from touchstone.operators.running import Total, attach, fresh, numbered, running, with_group_totals, with_scalars
from touchstone.operators.weights import REPLICATE, permuted_sums, weight_arrays, weighted_auc, weighted_sums
from touchstone.settings import cut_lineage, needs_split

def _replicates(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def resample(units: DataFrame, key: str, group: Sequence[str], replicates: int, seed: int = 0, split="auto") -> DataFrame:
    """Units with a ``replicate`` and a multiplicity ``w`` >= 1: n draws with replacement of n units.

    Slot i of replicate b draws unit keyed_int(seed, group, b, i) mod n.  The same call always
    draws the same units, so paired statistics share replicates.
    """
    placed, slots = _slots(units, key, group, replicates, seed, split)
    weights = slots.groupBy(*group, REPLICATE, "__rn").agg(F.count(F.lit(1)).alias("w"))
    return _picked(placed, weights, group)


def _slots(units, key, group, replicates, seed, split="auto") -> tuple[DataFrame, DataFrame]:
    """Numbered units, and per slot of every replicate the number ``__rn`` of the unit it draws."""
    group = list(group)
    if split == "auto":
        split = needs_split(units, group)
    placed = numbered(units, group, [key], "__rn", split)
    placed = with_group_totals(placed, group, {"__n": F.count(F.lit(1))}, split)
    # Numbering leaves a group in one task; its slots are dealt out before there are ``replicates`` of each.
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = placed.select(*group, "__rn", "__n").repartition(tasks, *group, "__rn").withColumn(REPLICATE, _replicates(replicates))
    pick = F.pmod(keyed_int(seed, *group, REPLICATE, "__rn"), F.col("__n")) + 1
    return placed.drop("__n"), slots.select(*group, REPLICATE, pick.alias("__rn"))


def _picked(placed, slots, group) -> DataFrame:
    """The units that slots point to.  The units are the side that is held, a share in each task: slots are ``replicates``
    times as many, which their estimated size does not tell, and must not be broadcast."""
    names = {g: f"__t_{g}" for g in [*group, "__rn"]}
    same = F.col("__t___rn") == F.col("__rn")
    for g in group:
        same = same & F.col(names[g]).eqNullSafe(F.col(g))
    rest = [c for c in slots.columns if c not in names]
    return slots.withColumnsRenamed(names).join(placed.hint("shuffle_hash"), same).select(*[c for c in placed.columns if c != "__rn"], *rest)


def resampled_rows(units, key, group, replicates, seed=0, split="auto") -> DataFrame:
    """As ``resample`` with one row for each draw: for statistics that take no weights, and for sums, which need no multiplicities."""
    placed, slots = _slots(units, key, group, replicates, seed, split)
    return _picked(placed, slots, group)


def interval(replicates: DataFrame, value: str, group: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Percentile interval over replicates (a bounded number of rows per group) and crossing p."""
    v = F.col(value)
    return replicates.filter(finite(value)).groupBy(*group).agg(
        F.percentile(value, F.lit(alpha / 2)).alias("lo"), F.percentile(value, F.lit(1 - alpha / 2)).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((v <= 0).cast("double")), F.avg((v >= 0).cast("double")))).alias("crossing_p"))


def bootstrap_mean(
    df, value: str, key: str, group: Sequence[str] = (), replicates: int = 1000, seed: int = 0, weight: str | None = None, draws: str = "poisson",
) -> DataFrame:
    """Mean (or weighted mean) with its percentile interval; one unit gives itself.

    With ``draws="poisson"`` no row is copied: tasks add up arrays of weighted sums.  ``draws="units"`` draws exactly n of
    n rows, which matters where a group has a handful of them.
    """
    if draws not in ("poisson", "units"):
        raise ValueError(f"unknown draws {draws!r}")
    group = list(group)
    x, wt = fresh(df, "x", "wt")
    rows = df.filter(finite(value)).select(*group, key, F.col(value).cast("double").alias(x), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias(wt))
    mean = F.try_divide(F.sum(F.col(wt) * F.col(x)), F.sum(wt))
    if draws == "units":
        rows = cut_lineage(rows)  # one row per unit, read by the point, the size check and the draws
        reps = resampled_rows(rows, key, group, replicates, seed).groupBy(*group, REPLICATE).agg(mean.alias("__m"))
    else:
        both = weighted_sums(rows, key, {"__sx": F.col(wt) * F.col(x), "__sw": F.col(wt)}, group, replicates, seed)
        reps = both.select(*group, REPLICATE, F.try_divide("__sx", "__sw").alias("__m"))
    point = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"))
    return attach(point, interval(reps, "__m", group), group, "left")


def bootstrap_statistic(df, key, group, statistic: Callable[[DataFrame, list[str]], DataFrame], value: str, replicates=200, seed=0) -> DataFrame:
    """Interval of any statistic, refit inside each replicate.

    ``statistic(rows, by)`` returns one row per combination of ``by`` with the column ``value``.
    """
    group = list(group)
    point = statistic(df, group).select(*group, value)
    reps = statistic(resampled_rows(df, key, group, replicates, seed), [*group, REPLICATE])
    return attach(point, interval(reps, value, group), group, "left")


def bootstrap_auc(df, score: str, label: str, key: str, group: Sequence[str] = (), replicates=200, seed=0) -> DataFrame:
    """AUC with a percentile interval; rows have Poisson weights, positives and negatives each their own."""
    return _weighted_aucs(df, [score], label, group, replicates, seed, key=key)


def bootstrap_auc_difference(df, a: str, b: str, label: str, key: str, group: Sequence[str] = (), replicates=200, seed=0) -> DataFrame:
    """AUC(a) - AUC(b) with an interval; both scorers see the same weights."""
    return _weighted_aucs(df, [a, b], label, group, replicates, seed, key=key)


def _weighted_aucs(df, scores, label, group, replicates, seed, key=None, weights=None) -> DataFrame:
    group = list(group)
    ok = F.col(label).isin(0, 1)
    for s in scores:
        ok = ok & finite(s)
    rows = df.filter(ok)
    positive, negative = (F.when(F.col(label) == side, F.lit(1.0)).otherwise(F.lit(0.0)) for side in (1, 0))
    points = reps = None
    for i, s in enumerate(scores):
        hist = rows.groupBy(*group, F.col(s).cast("double").alias("__v")).agg(F.sum(positive).alias("n_pos"), F.sum(negative).alias("n_neg"))
        point = auc_counts(hist, group, "__v", name=f"__auc{i}").select(*group, f"__auc{i}")
        each = weighted_auc(rows, s, positive, negative, group, replicates, seed, key, weights, f"__auc{i}")
        points = point if points is None else attach(points, point, group)
        reps = each if reps is None else attach(reps, each, [*group, REPLICATE])
    stat = F.col("__auc0") if len(scores) == 1 else F.col("__auc0") - F.col("__auc1")
    name = "auc" if len(scores) == 1 else "auc_difference"
    ends = interval(reps.select(*group, stat.alias("__stat")), "__stat", group)
    return attach(points.select(*group, stat.alias(name)), ends, group, "left")


def cluster_bootstrap_auc(df, scores: Sequence[str], label: str, cluster: str, group: Sequence[str] = (), replicates=200, seed=0, draws: str = "units") -> DataFrame:
    """AUC (or difference of two AUCs) with an interval from resampling whole clusters.

    A cluster's multiplicities in all replicates are one array that its rows carry through a single sort by score, so no
    row is copied and no matrix of cluster pairs is formed.  ``draws="poisson"`` hashes the cluster instead.
    """
    if draws == "poisson":
        return _weighted_aucs(df, list(scores), label, group, replicates, seed, key=[*group, cluster])
    if draws != "units":
        raise ValueError(f"unknown draws {draws!r}")
    group = list(group)
    clusters = df.select(*group, cluster).distinct()
    held, = fresh(df, "drawn")
    drawn = weight_arrays(resample(clusters, cluster, group, replicates, seed), [*group, cluster], replicates, held)
    # A cluster that no replicate draws has no array: it counts in the point value only.
    none = F.array_repeat(F.lit(0), replicates)
    rows = attach(df, drawn, [*group, cluster], "left").withColumn(held, F.coalesce(held, none))
    return _weighted_aucs(rows, list(scores), label, group, replicates, seed, weights=held)


def cluster_bootstrap_mean(per_cluster: DataFrame, value: str, weight: str, cluster: str, group: Sequence[str] = (), replicates=1000, seed=0) -> DataFrame:
    """Weighted mean over studies with a study bootstrap interval and two-sided crossing p."""
    return bootstrap_mean(per_cluster, value, cluster, group, replicates, seed, weight, "units")


def cluster_bootstrap_difference(per_cluster, a: str, b: str, weight: str, cluster: str, group=(), replicates=1000, seed=0) -> DataFrame:
    """Paired difference of two weighted means under the same study draws."""
    rows = per_cluster.filter(finite(a) & finite(b)).withColumn("__d", F.col(a) - F.col(b))
    return bootstrap_mean(rows, "__d", cluster, group, replicates, seed, weight, "units")


def cluster_mean_interval(df, value: str, cluster: str, group: Sequence[str] = (), replicates=1000, seed=0) -> DataFrame:
    """Mean of cluster means with a cluster bootstrap interval."""
    means = df.filter(finite(value)).groupBy(*group, cluster).agg(F.avg(value).alias("__c"))
    return bootstrap_mean(means, "__c", cluster, group, replicates, seed, draws="units")


def permutation_test(
    df, value: str, side: str, key: str, group: Sequence[str] = (), replicates=1000, seed=0,
    alternative: str = "two-sided", plus_one: bool = True,
) -> DataFrame:
    """Mean difference (side 1 - side 0) against shuffled labels.

    In each replicate the n1 rows with the smallest keyed draws take label 1, so every
    permutation keeps the class sizes (:func:`touchstone.operators.weights.permuted_sums`).
    p is (c + 1) / (B + 1), or c / B without ``plus_one``; null where a side is empty.
    """
    group = list(group)
    x, y, size, total, whole = fresh(df, "x", "y", "n1", "n", "sx")
    rows = df.filter(finite(value) & F.col(side).isin(0, 1)).select(*group, key, F.col(value).cast("double").alias(x), F.col(side).cast("int").alias(y))
    mean = lambda flag: F.avg(F.when(flag, F.col(x)))
    obs = rows.groupBy(*group).agg(
        F.sum(y).alias(size), F.count(F.lit(1)).alias(total), F.sum(x).alias(whole), (mean(F.col(y) == 1) - mean(F.col(y) == 0)).alias("observed"))
    drawn = permuted_sums(attach(rows, obs.drop("observed"), group), key, x, size, total, group, replicates, seed, "__s1")
    null = attach(drawn, obs, group).withColumn("__d", F.try_divide("__s1", size) - F.try_divide(F.col(whole) - F.col("__s1"), F.col(total) - F.col(size)))
    tol = 1e-12
    beyond = {
        "greater": F.col("__d") >= F.col("observed") - tol, "less": F.col("__d") <= F.col("observed") + tol,
        "two-sided": F.abs("__d") >= F.abs(F.col("observed")) - tol}[alternative]
    add = 1 if plus_one else 0
    p = null.groupBy(*group).agg(((F.sum(beyond.cast("int")) + add) / (F.count(F.lit(1)) + add)).alias("p"))
    out = attach(obs, p, group)
    return out.select(*group, F.col(size).alias("n1"), F.col(total).alias("n"), "observed", F.when(F.col("observed").isNotNull(), F.col("p")).alias("p"))


def rank_sum_tail(ranks: Sequence[int], counts: Sequence[int], positives: int, reached: int) -> float:
    """Share of the placements of ``positives`` labels on tied rows whose sum of doubled ranks is ``reached`` or more.

    ``ranks`` are the distinct doubled mean ranks (integers), ``counts`` the rows of each.  The number of label sets per
    (labels placed, sum) is built up block by block; sums of the smaller class are counted, and scaled so that none overflows.
    """
    n = sum(counts)
    whole = sum(r * c for r, c in zip(ranks, counts, strict=True))
    flip = positives > n - positives
    k = n - positives if flip else positives
    ordered = sorted(zip(ranks, counts, strict=True), reverse=True)
    most = 0  # the largest sum of k rows
    left = k
    for r, c in ordered:
        most += r * min(left, c)
        left -= min(left, c)
    # Chances instead of counts: a block's share of j labels is weighed by C(c, j) and the whole divided by C(n, k) at the end.
    ways = np.zeros((k + 1, most + 1))
    ways[0, 0] = 1.0
    scale, placed = 0.0, 0
    for r, c in zip(ranks, counts, strict=True):
        placed += c
        new = np.zeros_like(ways)
        for j in range(min(c, k) + 1):
            shift = r * j
            if shift > most:
                break
            new[j:, shift:] += math.comb(c, j) * ways[:k + 1 - j, :most + 1 - shift]
        top = new.max()
        ways = new / top
        scale += math.log(top)
    last = ways[k]
    if flip:  # the positives' sum is the rest
        good = last[:max(0, min(most, whole - reached) + 1)].sum()
    else:
        good = last[max(0, reached):].sum()
    return float(min(1.0, good / last.sum()))


MOST_EXACT = 300  # rows of a group for which the exact null is built


def auc_permutation(
    df, score: str, label: str, key: str, group: Sequence[str] = (), method: str = "drawn", replicates=1000, seed=0, most: int = MOST_EXACT,
) -> DataFrame:
    """One-sided permutation p of an AUC: ``group, n, n_pos, auc, method, p``.

    ``method="exact"`` counts, for every group, the label sets per rank sum; a group of more than ``most`` rows is an error,
    as its table of counts would not fit a task.  ``method="drawn"`` re-labels the ranked rows of every group, of any size.
    The method is the caller's and never the group's: p means the same at every size.
    """
    if method not in ("exact", "drawn"):
        raise ValueError(f"unknown method {method!r}")
    group = list(group)
    s, y, rank = fresh(df, "s", "y", "rank")
    rows = df.filter(finite(score) & F.col(label).isin(0, 1)).select(*group, key, F.col(score).cast("double").alias(s), F.col(label).cast("int").alias(y))
    ranked = value_ranks(rows, group, s).select(*group, s, F.col("rank").alias(rank))
    rows = attach(rows, ranked, [*group, s])
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos"), F.sum(F.when(F.col(y) == 1, F.col(rank))).alias("__sum"))
    k, n = F.col("n_pos"), F.col("n")
    sizes = sizes.filter((k > 0) & (k < n)).withColumn("auc", (F.col("__sum") - k * (k + 1) / 2.0) / (k * (n - k)))
    if method == "exact":
        hist = rows.groupBy(*group, (2 * F.col(rank)).cast("long").alias("__r")).agg(F.count(F.lit(1)).alias("__c"))
        fits = sizes.withColumn("__ok", F.when(n <= most, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"a group of more than {most} rows has no exact null: n = "), n))))
        hist = attach(hist, fits.filter("__ok").select(*group, "n_pos", (2 * F.col("__sum")).cast("long").alias("__seen")), group)
        # At most ``most`` distinct ranks meet in a group.
        blocks = hist.groupBy(*group, "n_pos", "__seen").agg(F.sort_array(F.collect_list(F.struct("__r", "__c"))).alias("__b"))

        @F.pandas_udf("double")
        def tail(r: pd.Series, c: pd.Series, positives: pd.Series, seen: pd.Series) -> pd.Series:
            return pd.Series([rank_sum_tail([int(v) for v in a], [int(v) for v in b], int(m), int(t)) for a, b, m, t in zip(r, c, positives, seen)])

        p = blocks.select(*group, tail(F.col("__b.__r"), F.col("__b.__c"), "n_pos", "__seen").alias("p"))
    else:
        sums = permuted_sums(attach(rows, sizes.select(*group, "n", "n_pos"), group), key, rank, "n_pos", "n", group, replicates, seed, "__t")
        p = attach(sums, sizes.select(*group, "__sum"), group).groupBy(*group).agg(F.avg((F.col("__t") >= F.col("__sum") - 1e-9).cast("double")).alias("p"))
    return attach(sizes.select(*group, "n", "n_pos", "auc", F.lit(method).alias("method")), p, group, "left")


def cluster_permuted_null(df, feature: str, target: str, cluster: str, key: str, replicates=200, seed=0) -> DataFrame:
    """|rho(feature, target)| against rho with whole cluster means permuted across clusters.

    Ranks of the feature are the same in every replicate, and those of the permuted means are the same in a whole cluster,
    so a replicate needs the clusters' sizes and sums of feature ranks only: rows are read once and never copied.
    """
    c, x, rank, size, mean = fresh(df, "c", "x", "rank", "size", "m")
    rows = df.filter(finite(feature) & finite(target))
    seen = spearman(rows, feature, target, name="rho")
    means = rows.groupBy(F.col(cluster).alias(c)).agg(F.avg(target).alias(mean))
    cells = rows.filter(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias(c), F.col(feature).cast("double").alias(x)).agg(F.count(F.lit(1)).alias(size))
    hist = cells.groupBy(x).agg(F.sum(size).alias("n"))
    whole = hist.agg(F.sum("n").alias("__n"))
    ranks = with_scalars(running(hist, [], [x], [Total("__before", "n")]), whole)
    # Twice the rank, less its mean: a whole number.
    ranks = ranks.select(x, "n", "__n", (2 * F.coalesce("__before", F.lit(0)) + F.col("n") - F.col("__n")).cast("double").alias(rank))
    spread = ranks.agg(F.sum(F.col("n") * F.col(rank) * F.col(rank)).alias("__sxx"), F.max("__n").alias("__n"))
    clusters = cells.join(ranks.select(x, rank), x).groupBy(c).agg(F.sum(size).alias(size), F.sum(F.col(size) * F.col(rank)).alias(rank))
    placed = cut_lineage(attach(numbered(means, [], [c], "__i"), clusters, [c], "left"))  # one row per cluster
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    orders = placed.select(c, size, rank).repartition(tasks, c).withColumn(REPLICATE, _replicates(replicates)).withColumn(
        "__h", keyed_int(seed, REPLICATE, c))
    orders = numbered(orders, [REPLICATE], ["__h", c], "__i", fanout=replicates)
    swapped = orders.join(placed.select("__i", F.col(mean).alias("__new")).hint("shuffle_hash"), "__i").filter(F.col(size).isNotNull())
    ties = swapped.groupBy(REPLICATE, "__new").agg(F.sum(size).alias("__w"), F.sum(rank).alias("__s"))
    ties = with_scalars(running(ties, [REPLICATE], ["__new"], [Total("__before", "__w")], fanout=replicates), spread)
    y = (2 * F.coalesce("__before", F.lit(0)) + F.col("__w") - F.col("__n")).cast("double")
    sums = ties.groupBy(REPLICATE, "__n", "__sxx").agg(F.sum(y * F.col("__s")).alias("__sxy"), F.sum(F.col("__w") * y * y).alias("__syy"))
    known = (F.col("__n") >= 5) & (F.col("__sxx") > 0) & (F.col("__syy") > 0)
    null = sums.select(REPLICATE, F.when(known, F.col("__sxy") / F.sqrt("__sxx") / F.sqrt("__syy")).alias("__null"))
    both = with_scalars(null, seen)
    return both.groupBy("rho", "n").agg(F.avg((F.abs("__null") >= F.abs("rho") - 1e-12).cast("double")).alias("p"))


def noise_split(units: DataFrame, unit: str, residual: str, replicate_value: DataFrame, value: str) -> DataFrame:
    """Split the spread of residuals into bootstrap noise inside units and the rest between them.

    ``replicate_value`` has (unit, replicate, value) of the same statistic.
    """
    noise = replicate_value.groupBy(unit).agg(F.stddev_samp(value).alias("__s")).agg(F.sqrt(F.avg(F.col("__s") ** 2)).alias("within_sd"))
    total = units.agg(F.count(F.lit(1)).alias("units"), F.stddev_samp(residual).alias("total_sd"))
    out = with_scalars(total, noise)
    return out.withColumn("between_sd", F.sqrt(F.greatest(F.lit(0.0), F.col("total_sd") ** 2 - F.col("within_sd") ** 2)))

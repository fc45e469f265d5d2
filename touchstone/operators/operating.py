"""Operating points, coverage and selective use of a score.  Aggregates only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.numeric import finite, half_even, is_specific, objective
from touchstone.functions.tails import spearman_p
from touchstone.operators.agreement import label_histogram, spearman
from touchstone.operators.ranks import group_quantiles
from touchstone.operators.running import Total, attach, longest_runs, numbered, running, with_group_totals
from touchstone.settings import needs_split, once


def operating_points(df, score: str, label: str, budgets: Sequence[float], group=(), split="auto") -> DataFrame:
    """Per group and false-positive budget: threshold, realised rate and true-positive rate.

    At most floor(budget * n_neg) negatives may be flagged.  With none allowed the threshold
    lies just above the largest negative (``above_max`` true: flag score > threshold), else it is
    the k-th largest negative and score >= threshold is flagged.
    """
    group = list(group)
    hist = label_histogram(df, group, score, label)
    if split == "auto":
        split = needs_split(hist, group)
    hist = running(hist, group, [("__v", "desc")], [Total("__neg_above", "n_neg"), Total("__pos_to", "n_pos", inclusive=True)], split)
    hist = hist.withColumn("__neg_above", F.coalesce("__neg_above", F.lit(0)))
    hist = with_group_totals(hist, group, {"__pos": F.sum("n_pos"), "__neg": F.sum("n_neg")}, split)
    budgets_col = F.explode(F.array(*[F.lit(float(b)) for b in budgets]))
    rows = hist.withColumn("fpr_budget", budgets_col).withColumn(
        "__k", F.floor(F.col("fpr_budget") * F.col("__neg"))
    )
    nothing = F.col("__k") == 0
    holds_kth = (F.col("__neg_above") < F.col("__k")) & (F.col("__k") <= F.col("__neg_above") + F.col("n_neg"))
    holds_max = (F.col("__neg_above") == 0) & (F.col("n_neg") > 0)
    at = F.when(nothing, holds_max).otherwise(holds_kth)
    # k = 0: flagged positives are those strictly above the largest negative.
    flagged_pos = F.when(nothing, F.col("__pos_to") - F.col("n_pos")).otherwise(F.col("__pos_to"))
    flagged_neg = F.when(nothing, F.lit(0)).otherwise(F.col("__neg_above") + F.col("n_neg"))
    out = rows.groupBy(*group, "fpr_budget").agg(
        F.max("__pos").alias("n_pos"), F.max("__neg").alias("n_neg"),
        F.max(F.when(at, F.col("__v"))).alias("threshold"),
        F.max(nothing).alias("above_max"),
        F.max(F.when(at, flagged_pos)).alias("flagged_pos"),
        F.max(F.when(at, flagged_neg)).alias("flagged_neg"),
    )
    return out.select(
        *group, "fpr_budget", "n_pos", "n_neg", "threshold", "above_max",
        F.try_divide("flagged_pos", "n_pos").alias("tpr"),
        F.try_divide("flagged_neg", "n_neg").alias("realised_fpr"),
        (F.col("fpr_budget") * F.col("n_neg") >= 1).alias("estimable"),
    )


def usable_units(df, score, label, unit: Sequence[str], min_neg: int = 20) -> DataFrame:
    """Units with their class sizes and the reason they are dropped (null when kept)."""
    ok = finite(score) & F.col(label).isin(0, 1)
    sizes = df.groupBy(*unit).agg(
        F.sum(F.when(ok & (F.col(label) == 0), 1).otherwise(0)).alias("n_neg"),
        F.sum(F.when(ok & (F.col(label) == 1), 1).otherwise(0)).alias("n_pos"),
    )
    reason = F.when(F.col("n_neg") < min_neg, "too few negatives").when(F.col("n_pos") == 0, "no positives")
    return sizes.withColumn("dropped_because", reason)


def operating_report(points: DataFrame, bulk: DataFrame, unit: Sequence[str], bulk_col="rho") -> DataFrame:
    """Per budget over estimable units: median tpr and its rank correlation with bulk agreement."""
    rows = once(points.filter("estimable").join(bulk.select(*unit, F.col(bulk_col).alias("__bulk")), list(unit)).select("fpr_budget", "tpr", "__bulk"))
    med = group_quantiles(rows, ["fpr_budget"], "tpr", {"median_tpr": 0.5})
    count = rows.groupBy("fpr_budget").agg(F.count(F.lit(1)).alias("n_estimable"))
    rho = spearman(rows, "__bulk", "tpr", ["fpr_budget"], min_n=3, name="bulk_predicts_tpr").withColumnRenamed("n", "__pairs")
    out = count.join(med, "fpr_budget").join(rho, "fpr_budget", "left")
    return out.withColumn("bulk_predicts_p", spearman_p("bulk_predicts_tpr", F.col("__pairs"))).drop("__pairs")


def flag_rows(df, score, label, budget: float, group=(), name="flagged", split="auto") -> DataFrame:
    """Rows with a boolean flag at one false-positive budget (null where a class is missing)."""
    group = list(group)
    points = operating_points(df, score, label, [budget], group, split).select(*group, "threshold", "above_max")
    rows = df.filter(finite(score))
    # One threshold row per group; a plain join lets the optimiser decide how to ship it.
    rows = attach(rows, points, group, "left")
    s = F.col(score).cast("double")
    return rows.withColumn(
        name, F.when(F.col("above_max"), s > F.col("threshold")).otherwise(s >= F.col("threshold"))
    ).drop("threshold", "above_max")


def topk_coverage(df, score, label, target, key, budget: float, ks=(10, 50, 100), group=(), split="auto") -> DataFrame:
    """Flagged share among the best positives by target, for several k."""
    group = list(group)
    flagged = flag_rows(df, score, label, budget, group, split=split).filter(F.col(label) == 1)
    ranked = numbered(flagged, group, [(target, "desc"), key], "__place", split)
    return ranked.groupBy(*group).agg(
        *[F.avg(F.when(F.col("__place") <= k, F.col("flagged").cast("double"))).alias(f"coverage_top{k}") for k in ks]
    )


def cluster_coverage(df, score, label, cluster, budget: float, group=(), split="auto") -> DataFrame:
    """Share of positive-bearing clusters with at least one flagged positive."""
    group = list(group)
    flagged = flag_rows(df, score, label, budget, group, split=split).filter(F.col(label) == 1)
    per = flagged.groupBy(*group, cluster).agg(F.max("flagged").alias("__hit"))
    return per.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_pos_clusters"), F.avg(F.col("__hit").cast("double")).alias("cluster_coverage")
    )


def longest_miss_run(df, score, label, order: Sequence[str], budget: float, group=(), split="auto") -> DataFrame:
    """Longest stretch of consecutive unflagged positives along an order."""
    flagged = flag_rows(df, score, label, budget, group, split=split).filter(F.col(label) == 1)
    return longest_runs(flagged, list(group), list(order), "flagged", "longest_miss_run", split)


def nomination_eval(df, picked: Column, on: str, off: list[str], kind="margin", group=(), tau=0.5, on_min=0.8) -> DataFrame:
    """Mean objective of nominated rows, regret to the best of all rows, crosstalk and success."""
    worst = F.greatest(*[F.col(o) for o in off]) if len(off) > 1 else F.col(off[0])
    value = objective(kind, on, off, tau=tau)
    among = lambda c: F.avg(F.when(picked, c))
    return df.groupBy(*group).agg(
        F.sum(F.when(picked, 1).otherwise(0)).alias("n"),
        among(value).alias("mean_score"),
        (F.max(value) - among(value)).alias("regret"),
        among((worst > tau).cast("double")).alias("off_target_rate"),
        among(is_specific(on, off, tau, on_min).cast("double")).alias("success_rate"),
        among(F.col(on)).alias("mean_on"),
        among(worst).alias("mean_off"),
    )


def risk_coverage(df, forecast, skill, key, coverages: Sequence[float], group=(), unreliable_below=0.2, split="auto") -> DataFrame:
    """Mean skill and unreliable share of the units kept by forecast, beside their plain mean.

    The expectation of a random subset of any size is the overall mean, so that control is exact.
    """
    group = list(group)
    rows = df.filter(finite(forecast) & finite(skill)).withColumn("__k", F.col(skill).cast("double"))
    if split == "auto":
        split = needs_split(rows, group)
    rows = numbered(rows, group, [(forecast, "desc"), key], "__place", split)
    rows = with_group_totals(rows, group, {"__n": F.count(F.lit(1))}, split)
    keep = lambda c: F.col("__place") <= half_even(F.lit(float(c)) * F.col("__n"))
    aggregates = []
    for i, c in enumerate(coverages):
        aggregates += [
            F.sum(F.when(keep(c), 1).otherwise(0)).alias(f"__n{i}"),
            F.avg(F.when(keep(c), F.col("__k"))).alias(f"__m{i}"),
            F.avg(F.when(keep(c), (F.col("__k") < unreliable_below).cast("double"))).alias(f"__u{i}"),
        ]
    wide = rows.groupBy(*group).agg(F.avg("__k").alias("random_control"), *aggregates)
    cells = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("coverage"), F.col(f"__n{i}").alias("kept"), F.col(f"__m{i}").alias("mean_skill"),
                 F.col(f"__u{i}").alias("frac_unreliable"))
        for i, c in enumerate(coverages)
    ])).alias("cell")
    return wide.select(*group, "random_control", cells).select(*group, "cell.*", "random_control")


def low_tail_catch(df, forecast, skill, key, cuts: Sequence[float], group=(), split="auto") -> DataFrame:
    """How many truly bad units the equally many lowest forecasts catch, beside chance."""
    group = list(group)
    rows = df.filter(finite(forecast) & finite(skill))
    if split == "auto":
        split = needs_split(rows, group)
    rows = numbered(rows, group, [forecast, key], "__place", split)
    bad = {f"__bad{i}": F.sum(F.when(F.col(skill) < c, 1).otherwise(0)) for i, c in enumerate(cuts)}
    rows = with_group_totals(rows, group, {"__n": F.count(F.lit(1)), **bad}, split)
    hits = [
        F.sum(F.when((F.col(skill) < c) & (F.col("__place") <= F.col(f"__bad{i}")), 1).otherwise(0)).alias(f"__hit{i}")
        for i, c in enumerate(cuts)
    ]
    wide = rows.groupBy(*group, "__n", *bad).agg(*hits)
    cells = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("cut"), F.col(f"__bad{i}").alias("bad"), F.col(f"__hit{i}").alias("hits"))
        for i, c in enumerate(cuts)
    ])).alias("cell")
    out = wide.select(*group, F.col("__n").alias("n"), cells).select(*group, "n", "cell.*").filter("bad > 0")
    return out.withColumn("chance", F.col("bad") * F.col("bad") / F.col("n").cast("double")).withColumn(
        "precision", F.col("hits") / F.col("bad").cast("double")
    )


def calibration_bins(df, forecast, actual, bins: int = 4, group=(), split="auto") -> DataFrame:
    """Mean forecast and mean actual per quantile bin; both edges closed, so edge values count twice."""
    group = list(group)
    rows = df.filter(finite(forecast) & finite(actual))
    edges = group_quantiles(rows, group, forecast, {f"__q{i}": i / bins for i in range(bins + 1)}, split)
    rows = attach(rows, edges, group)
    member = F.explode(F.filter(
        F.array(*[
            F.when((F.col(forecast) >= F.col(f"__q{i}")) & (F.col(forecast) <= F.col(f"__q{i + 1}")), F.lit(i + 1))
            for i in range(bins)
        ]), lambda v: v.isNotNull()))
    return rows.withColumn("bin", member).groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(forecast).alias("predicted"), F.avg(actual).alias("actual")
    )


def routing_curve(df, forecast, cheap, costly, key, fractions: Sequence[float], cost_ratio: float, group=(), split="auto") -> DataFrame:
    """Send the fraction f with the lowest forecasts to the costly model: cost and share of the gain.

    ``gain_oracle`` routes by the true gain; a random router's expected share is f itself.
    """
    group = list(group)
    rows = df.filter(finite(forecast) & finite(cheap) & finite(costly)).withColumn(
        "__gain", F.col(costly).cast("double") - F.col(cheap)
    )
    if split == "auto":
        split = needs_split(rows, group)
    rows = numbered(rows, group, [forecast, key], "__by_f", split)
    rows = numbered(rows, group, [("__gain", "desc"), key], "__by_g", split)
    rows = with_group_totals(rows, group, {"__n": F.count(F.lit(1))}, split)
    aggregates = []
    for i, f in enumerate(fractions):
        k = half_even(F.lit(float(f)) * F.col("__n"))
        aggregates += [
            F.avg(F.when(F.col("__by_f") <= k, F.col("__gain")).otherwise(0.0)).alias(f"__f{i}"),
            F.avg(F.when(F.col("__by_g") <= k, F.col("__gain")).otherwise(0.0)).alias(f"__g{i}"),
        ]
    wide = rows.groupBy(*group).agg(F.avg("__gain").alias("__all"), *aggregates)
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(float(f)).alias("fraction"), F.lit((1.0 + f * (cost_ratio - 1.0)) / cost_ratio).alias("cost"),
            F.try_divide(F.col(f"__f{i}"), F.col("__all")).alias("gain_forecast"),
            F.try_divide(F.col(f"__g{i}"), F.col("__all")).alias("gain_oracle"),
            F.lit(float(f)).alias("gain_random"),
        ) for i, f in enumerate(fractions)
    ])).alias("cell")
    return wide.select(*group, cells).select(*group, "cell.*")


def crossover_budget(df, budget: str, a: str, b: str, group=(), split="auto") -> DataFrame:
    """Smallest budget from which b >= a and stays so; null when there is none."""
    group = list(group)
    behind = df.groupBy(*group).agg(F.max(F.when(F.col(b) < F.col(a), F.col(budget))).alias("__last"))
    rows = attach(df, behind, group)
    after = F.col("__last").isNull() | (F.col(budget) > F.col("__last"))
    return rows.groupBy(*group).agg(F.min(F.when(after, F.col(budget))).alias("crossover"))


def global_best(df, value: str, key: str, group=()) -> DataFrame:
    """Row with the largest value per group (ties: smallest key)."""
    # max_by keeps the last of equals, so the tie goes through a two-step comparison.
    best = df.groupBy(*group).agg(F.max(value).alias("best_value"))
    rows = attach(df, best, list(group))
    return rows.filter(F.col(value) == F.col("best_value")).groupBy(*group, "best_value").agg(F.min(key).alias("best_key"))


def hamming_ball_best(df, text: str, value: str, start: str, radii: Sequence[int]) -> DataFrame:
    """Best value within h substitutions of a start string of equal length."""
    from touchstone.functions.text import hamming

    near = df.filter(F.length(text) == len(start)).withColumn("__d", hamming(F.col(text), F.lit(start)))
    wide = near.agg(*[F.max(F.when(F.col("__d") <= h, F.col(value))).alias(f"__b{h}") for h in radii])
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("radius"), F.col(f"__b{h}").alias("best")) for h in radii]))
    return wide.select(cells.alias("cell")).select("cell.*")

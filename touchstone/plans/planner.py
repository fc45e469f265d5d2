"""The audit in one plan, and deciding which ranker has earned a selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.functions.numeric import finite, keyed_int
from touchstone.operators import agreement as ag
from touchstone.operators import linear as ln
from touchstone.operators.running import attach, numbered, with_scalars

# Thresholds of the decision rule.
MIN_FOR_TRUST, TRUST_AUROC, TIE_AUROC, CONFOUND_RHO, NUISANCE_RHO, POOL_MARGIN = 12, 0.55, 0.01, 0.30, 0.7, 0.02


@dataclass(frozen=True)
class AuditColumns:
    """Roles of a table's columns."""

    key: str
    target: str
    scores: list[str]
    baselines: list[str] = field(default_factory=list)
    nuisance: str | None = None
    group: list[str] = field(default_factory=list)
    min_n: int = 5


def audit(df: DataFrame, cols: AuditColumns, split="auto") -> DataFrame:
    """Per group and score: rho with the target, rho with the nuisance, partial rho, rho inside fixed
    nuisance levels and sign flip, margin over the best baseline, and confound flags.

    Rows stay wide where every row has every score, and each column is ranked once inside the groups and once inside their
    levels; the rest are joins of result rows.
    """
    group, z, y = cols.group, cols.nuisance, cols.target
    names = [*cols.scores, *[b for b in cols.baselines if b not in cols.scores]]
    rows = df.filter(finite(y) & finite(z)).withColumns({"__y": F.col(y).cast("double"), "__z": F.col(z).cast("double")})
    by = [*group, "score_name"]
    table = ag.rank_correlations(rows, names, ["__y", "__z"], group, split, "__z", cols.min_n).filter(F.col("n") >= cols.min_n).select(
        *by, "n", F.col("rho_0").alias("rho"), F.col("rho_0").alias("raw_rho"), F.col("rho_1").alias("score_vs_nuisance"),
        F.col("between").alias("target_vs_nuisance"), "strata", "within_rho")
    table = ag.with_partial(table)
    best = table.filter(F.col("score_name").isin(*cols.baselines)).groupBy(*group).agg(
        F.max_by(F.struct(F.col("score_name").alias("b"), F.col("rho").alias("v")), F.struct(F.abs("rho"), F.col("score_name"))).alias("__best"))
    table = attach(table, best, group, "left" if group else "inner") if cols.baselines else table.withColumn("__best", F.lit(None).cast("struct<b:string,v:double>"))
    learned = F.col("score_name").isin(*[s for s in cols.scores if s not in cols.baselines])
    return table.select(
        *by, "n", "rho", F.col("score_vs_nuisance").alias("rho_nuisance"), "partial_rho", "strata", "within_rho",
        F.coalesce(F.signum("within_rho") != F.signum("rho"), F.lit(False)).alias("sign_flip"),
        F.when(learned, F.col("__best.b")).alias("best_baseline"),
        F.when(learned, F.abs("rho") - F.abs(F.coalesce(F.col("__best.v"), F.lit(0.0)))).alias("margin"),
        F.coalesce(F.abs("score_vs_nuisance") >= CONFOUND_RHO, F.lit(False)).alias("confounded"),
        F.coalesce(F.abs("score_vs_nuisance") >= NUISANCE_RHO, F.lit(False)).alias("is_nuisance"))


def pooling_check(
    df: DataFrame, features: Sequence[str], target: str, key: str, condition: str, lam: float = 1.0, reps: int = 10,
    min_per: int = 20, folds: int = 5, seed: int = 0,
) -> DataFrame:
    """Per condition: AUROC of a model from that condition alone (leave-one-out), from as many rows
    of other conditions (mean over draws), and from everything (k-fold), with the verdict's inputs.

    Draws are exact: for each (condition, draw) the n_c other rows with the smallest keyed hashes
    train.  Every model is a difference or sum of moments.
    """
    rows = df.filter(finite(target)).withColumn(target, F.col(target).cast("double"))
    sizes = rows.groupBy(condition).agg(F.count(F.lit(1)).alias("__n"), F.stddev_pop(target).alias("__sd"))
    total = sizes.agg(F.sum("__n").alias("__all"))
    usable = with_scalars(sizes, total).filter(
        (F.col("__n") >= min_per) & (F.col("__sd") >= 1e-12) & (F.col("__all") - F.col("__n") >= F.col("__n"))).select(condition, "__n")
    mine = rows.join(usable.select(condition), condition, "left_semi")
    within = ln.loo_ridge(mine, features, target, [condition], lam).withColumn("__s", F.round("loo", 9))
    within = ag.elite_metrics(within, "__s", target, key, [condition]).select(condition, "n", F.col("elite_auroc").alias("within"))
    pooled = ln.out_of_fold(rows.withColumn("__fold", ln.fold_random(key, folds, seed)), features, target, "__fold", (), lam)
    pooled = pooled.join(usable.select(condition), condition, "left_semi").withColumn("__s", F.round("oof", 9))
    pooled = ag.elite_metrics(pooled, "__s", target, key, [condition]).select(condition, F.col("elite_auroc").alias("pooled"))
    # Other-condition draws: the number of usable conditions is a condition count, not a data size.
    targets = usable.agg(F.collect_list(F.struct(F.col(condition).alias("c"), F.col("__n").alias("k"))).alias("__targets"))
    draws = with_scalars(rows, targets).withColumn("__t", F.explode("__targets")).filter(F.col(condition) != F.col("__t.c"))
    draws = draws.withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).select(
        "*", F.col("__t.c").alias("__for"), F.col("__t.k").alias("__k"), keyed_int(seed, "__rep", F.col("__t.c"), key).alias("__h"))
    drawn = numbered(draws.drop("__targets", "__t"), ["__for", "__rep"], ["__h", key], "__rn", fanout=reps).filter(F.col("__rn") <= F.col("__k"))
    beta = ln.solve(ln.gram(drawn, list(features), [target], ["__for", "__rep"]), lam).select(F.col("__for").alias(condition), "__rep", "beta")
    scored = mine.join(beta, condition).withColumn("__s", F.round(ln.linear_prediction(list(features)), 9))
    mixed = ag.elite_metrics(scored, "__s", target, key, [condition, "__rep"]).groupBy(condition).agg(F.avg("elite_auroc").alias("mixed_equal_n"))
    return attach(attach(within, mixed, [condition], "left"), pooled, [condition], "left")


def pooling_verdict(table: DataFrame, margin: float = POOL_MARGIN) -> DataFrame:
    """Pool unless a model from within one condition is better by more than the margin."""
    means = table.agg(F.avg("within").alias("within"), F.avg("mixed_equal_n").alias("mixed_equal_n"), F.avg("pooled").alias("pooled"))
    gain = F.col("pooled") - F.col("within")
    return means.select(
        "*", F.when(-gain > margin, "stratify").otherwise("pool").alias("verdict"),
        F.when(gain > margin, "pooling scores higher").when(-gain > margin, "one condition scores higher").otherwise("no measurable difference").alias("why"),
        F.coalesce(F.abs(F.col("within") - F.col("mixed_equal_n")) <= margin, F.lit(False)).alias("purity_worthless"))


def diagnose(df, cols: AuditColumns, features: Sequence[str], lam: float = 1.0, never_select: Sequence[str] = ()) -> DataFrame:
    """Per group and score (long): rho, enrichment and elite AUROC on measured rows, confound on the
    pool, with the group's supervised metrics and its best selectable score beside them."""
    group = cols.group
    measured = df.filter(finite(cols.target))
    sizes = df.groupBy(*group).agg(
        F.sum(finite(cols.target).cast("int")).alias("n_measured"), F.sum((~finite(cols.target)).cast("int")).alias("n_candidates"))
    # The pool is the candidates where a group has any, else its measured rows.
    tagged = attach(df, sizes.select(*group, "n_candidates"), group)
    pool = tagged.filter(~finite(cols.target) | (F.col("n_candidates") == 0))
    nuisance = pool.groupBy(*group).agg(F.min(cols.nuisance).alias("nuisance_lo"), F.max(cols.nuisance).alias("nuisance_hi"))
    keep = [*group, cols.key]
    long = ag.long_scores(measured, cols.scores, [*keep, cols.target])
    by = [*group, "score_name"]
    rho = ag.spearman(long, "score", cols.target, by, name="rho").drop("n")
    elite = ag.elite_metrics(long, "score", cols.target, cols.key, by).select(*by, "elite_auroc", "enrichment")
    confound = ag.spearman(ag.long_scores(pool, cols.scores, [*keep, cols.nuisance] if cols.nuisance not in keep else keep), "score", cols.nuisance, by, name="confound").drop("n")
    table = attach(attach(rho, elite, by, "left"), confound, by, "left")
    barred = [*never_select, cols.nuisance]
    best = table.filter(~F.col("score_name").isin(*barred) & F.col("elite_auroc").isNotNull()).groupBy(*group).agg(
        F.min_by(F.struct("score_name", "elite_auroc", "enrichment", "rho", "confound"), F.struct(-F.col("elite_auroc"), F.col("score_name"))).alias("__b"))
    sup = ln.supervised_metrics(measured, features, cols.target, cols.key, group, lam).select(
        *group, F.col("elite_auroc").alias("supervised_auroc"), F.col("enrichment").alias("supervised_enrichment"), F.col("rho").alias("supervised_rho"))
    heads = attach(attach(attach(sizes, nuisance, group), sup, group, "left" if group else "inner"), best, group, "left" if group else "inner")
    heads = heads.select(
        *group, "n_measured", "n_candidates", "nuisance_lo", "nuisance_hi", "supervised_auroc", "supervised_enrichment", "supervised_rho",
        F.col("__b.score_name").alias("best_score"), F.col("__b.elite_auroc").alias("best_auroc"), F.col("__b.enrichment").alias("best_enrichment"),
        F.col("__b.rho").alias("best_rho"), F.col("__b.confound").alias("best_confound"))
    return attach(table, heads, group)


def recommend(diagnosis: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per group: follow the model on own data, the best score, or spread the batch, with reasons."""
    group = list(group)
    heads = ["n_measured", "n_candidates", "nuisance_lo", "nuisance_hi", "supervised_auroc", "supervised_enrichment", "supervised_rho",
             "best_score", "best_auroc", "best_enrichment", "best_rho", "best_confound"]
    d = diagnosis.select(*group, *heads).dropDuplicates(group) if group else diagnosis.select(*heads).limit(1)
    few = F.col("n_measured") < MIN_FOR_TRUST
    sup_ok = F.coalesce(F.col("supervised_auroc") >= TRUST_AUROC, F.lit(False))
    best_ok = F.coalesce(F.col("best_auroc") >= TRUST_AUROC, F.lit(False))
    own = ~few & sup_ok & (~best_ok | (F.col("supervised_auroc") + TIE_AUROC >= F.col("best_auroc")))
    follow = ~few & ~own & best_ok
    mixed = F.col("nuisance_lo") < F.col("nuisance_hi")
    warned = follow & mixed & F.coalesce(F.abs("best_confound") >= CONFOUND_RHO, F.lit(False))
    weak = follow & F.coalesce(F.abs("best_rho") < 0.20, F.lit(False))
    note = lambda when, text: F.when(when, F.lit(text))
    reasons = F.filter(F.array(
        note(few, "too few measurements to trust any model"), note(own, "a model on own measurements clears the bar"),
        note(own & best_ok, "ties with the best score go to own measurements"), note(follow, "the best score clears the bar and own model does not match it"),
        note(weak, "weak overall ranker that still finds the top"), note(warned, "score follows the nuisance over a mixed pool"),
        note(~few & ~own & ~follow, "nothing has earned trust")), lambda v: v.isNotNull())
    policy = F.when(few, "diversity").when(own, "supervised").when(follow, "score").otherwise("diversity")
    return d.withColumn("policy", policy).withColumn("reasons", reasons)



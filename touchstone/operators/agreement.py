"""Ranking, correlation and agreement between scores, targets and labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.numeric import elite_size, finite, finite_or_null, safe_corr, spread_ok
from touchstone.functions.tails import binom_two_sided
from touchstone.operators.ranks import average_ranks, group_quantiles, rank_rows, share, top_flags, value_counts
from touchstone.operators.running import Total, attach, numbered, running, with_group_totals
from touchstone.settings import needs_split, once


def long_scores(df: DataFrame, scores: Sequence[str], keep: Sequence[str], name="score_name", value="score") -> DataFrame:
    """Wide score columns to long (one row per row and score), nulls dropped, non-finite dropped."""
    wide = df.select(*keep, *[finite_or_null(s).alias(s) for s in scores])
    long = wide.unpivot(list(keep), list(scores), name, value)
    return long.filter(F.col(value).isNotNull())


def spearman(
    df: DataFrame, x: str, y: str, group: Sequence[str] = (), min_n: int = 5, name="rho", split="auto"
) -> DataFrame:
    """Spearman rho of finite pairs per group; null below ``min_n`` or for a constant side."""
    group = list(group)
    pairs = df.filter(finite(x) & finite(y)).select(*group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    ranked = average_ranks(pairs, group, ["__x", "__y"], "__rk", split)
    return ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= min_n, safe_corr("__rk__x", "__rk__y")).alias(name),
    )


def rank_correlations(
    df: DataFrame, scores: Sequence[str], others: Sequence[str], group: Sequence[str], split="auto", level: str | None = None,
    min_n: int = 5, sizes: bool = False,
) -> DataFrame:
    """Per group and score (long): rows ``n`` that have the score, correlation ``rho_<i>`` of its ranks with those of the
    ``i``-th other column, and ``between`` of the first two others.  The others are finite in all rows.

    With ``level``, ``strata`` counts the values of that column with ``min_n`` rows or more, which cover ``covered`` rows, and
    ``within_rho`` is their mean correlation of ranks inside a level, score with first other.  ``sizes`` adds the ``rows`` of
    the group.  Where every row has every score, ranks of the others are the same for all scores: rows stay wide and each
    column is ranked once.  Else ranks are made among the rows that have the score.
    """
    group, within = list(group), ["__level"] if level else []
    held, beside = [f"__s{i}" for i in range(len(scores))], [f"__o{i}" for i in range(len(others))]
    rows = df.select(*group, *([F.col(level).alias("__level")] if level else []), *[finite_or_null(s).alias(h) for s, h in zip(scores, held, strict=True)],
                     *[F.col(o).cast("double").alias(b) for o, b in zip(others, beside, strict=True)])
    whole = False
    if split == "auto":
        rows, split, whole = rank_rows(rows, group, held)
    pairs = {f"rho_{i}": b for i, b in enumerate(beside)}

    def figures(x: str) -> dict:
        out = {name: (x, b) for name, b in pairs.items()}
        return out | ({"between": ("__o0", "__o1")} if len(beside) > 1 else {})

    def long(table: DataFrame, fields: Callable[[str], list]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(s).alias("score_name"), *fields(h)) for s, h in zip(scores, held, strict=True)])
        rest = [c for c in (*group, *within, *beside, "__rows") if c in table.columns]
        return table.select(*rest, F.explode(each).alias("__f")).select(*rest, "__f.*")

    def correlated(ranked: DataFrame, by: list[str], sides: list[str]) -> DataFrame:
        """One row of ``by``; figures of a side have its name behind theirs.  Levels are met on the way."""
        used = {v for h in sides for ab in figures(h).values() for v in ab}
        products = {tuple(sorted(ab)) for h in sides for ab in figures(h).values()}
        x = lambda v: F.col(f"__rk{v}")
        sums = {f"__1{v}": F.sum(x(v)) for v in used} | {f"__2{v}": F.sum(x(v) * x(v)) for v in used}
        sums |= {f"__x{a}{b}": F.sum(x(a) * x(b)) for a, b in products}
        ends = {f"__lo{v}": F.min(x(v)) for v in used}, {f"__hi{v}": F.max(x(v)) for v in used}
        inside = {f"__in{h}": safe_corr(f"__in{h}", "__in__o0") for h in sides} if level else {}
        cells = ranked.groupBy(*by, *within).agg(
            F.count(F.lit(1)).alias("__n"), *[f.alias(name) for name, f in (sums | ends[0] | ends[1] | inside).items()])
        kept = F.col("__n") >= min_n
        out = cells.groupBy(*by).agg(
            F.sum("__n").alias("__n"), *[F.sum(name).alias(name) for name in sums], *[F.min(name).alias(name) for name in ends[0]],
            *[F.max(name).alias(name) for name in ends[1]],
            *([F.count(F.when(kept, 1)).alias("__strata"), F.sum(F.when(kept, F.col("__n"))).alias("__covered")] if level else []),
            *[F.avg(F.when(kept, F.col(name))).alias(name) for name in inside])
        n = F.col("__n")
        spread = lambda v: n * F.col(f"__2{v}") - F.col(f"__1{v}") * F.col(f"__1{v}")

        def corr(a: str, b: str) -> Column:
            varies = (F.col(f"__lo{a}") < F.col(f"__hi{a}")) & (F.col(f"__lo{b}") < F.col(f"__hi{b}"))
            low, high = sorted((a, b))
            cov = n * F.col(f"__x{low}{high}") - F.col(f"__1{a}") * F.col(f"__1{b}")
            return F.when(varies, F.try_divide(cov, F.sqrt(spread(a)) * F.sqrt(spread(b))))

        levels = lambda h: {
            "strata": F.when(F.col("__strata") > 0, F.col("__strata")), "covered": F.col("__covered"), "within_rho": F.col(f"__in{h}")} if level else {}
        return out.select(*by, *[f.alias(f"{name}{h}") for h in sides for name, f in (
            {"n": n} | {name: corr(*ab) for name, ab in figures(h).items()} | levels(h)).items()])

    names = ["n", *figures(""), *(["strata", "covered", "within_rho"] if level else [])]
    if whole:
        ranked = average_ranks(rows, group, [*held, *beside], "__rk", split, within, "__in")
        wide = correlated(ranked, group, held).withColumn("__rows", F.col(f"n{held[0]}"))
        out = long(wide, lambda h: [F.col(f"{name}{h}").alias(name) for name in names]).filter(F.col("n") > 0)
    else:
        by = [*group, "score_name"]
        each = long(rows, lambda h: [F.col(h).alias("__s")]).filter(F.col("__s").isNotNull())
        out = correlated(average_ranks(each, by, ["__s", *beside], "__rk", split, within, "__in"), by, ["__s"])
        out = out.withColumnsRenamed({f"{name}__s": name for name in names})
        if sizes:
            out = attach(out, rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows")), group)
    return out.withColumnRenamed("__rows", "rows") if sizes else out.drop("__rows")


def within_group_rank(
    df: DataFrame, scores: Sequence[str], target: str, group: Sequence[str], min_n: int = 5, split="auto"
) -> DataFrame:
    """Spearman of every score against the target inside each study, long form.

    Only groups with at least ``min_n`` measured rows appear; a score with fewer than ``min_n``
    values or a constant side gets a null rho.  ``n`` counts measured rows, ``n_score`` pairs.
    """
    group = list(group)
    measured = df.filter(finite(target))
    out = rank_correlations(measured, scores, [target], group, split, sizes=True).filter(F.col("rows") >= min_n)
    return out.select(
        *group, "score_name", F.col("rows").alias("n"), F.col("n").alias("n_score"), F.when(F.col("n") >= min_n, F.col("rho_0")).alias("rho"))


def partial_rank(
    df: DataFrame, x: str, y: str, nuisance: str, group: Sequence[str] = (), min_n: int = 5, split="auto"
) -> DataFrame:
    """Rank correlation of x and y with a nuisance removed, in closed form on ranks.

    Equal to correlating the residuals of rank-on-rank linear fits.  Rows need all three.
    """
    group = list(group)
    rows = df.filter(finite(x) & finite(y) & finite(nuisance)).select(
        *group, *[F.col(c).cast("double").alias(a) for c, a in ((x, "__x"), (y, "__y"), (nuisance, "__z"))]
    )
    ranked = average_ranks(rows, group, ["__x", "__y", "__z"], "__rk", split)
    out = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        safe_corr("__rk__x", "__rk__y").alias("raw_rho"),
        safe_corr("__rk__x", "__rk__z").alias("score_vs_nuisance"),
        safe_corr("__rk__y", "__rk__z").alias("target_vs_nuisance"),
    )
    return with_partial(out.filter(F.col("n") >= min_n))


def with_partial(correlations: DataFrame) -> DataFrame:
    """Add ``partial_rho`` from ``raw_rho``, ``score_vs_nuisance`` and ``target_vs_nuisance``."""
    xz, yz = F.col("score_vs_nuisance"), F.col("target_vs_nuisance")
    scale = F.sqrt((1 - xz * xz) * (1 - yz * yz))
    return correlations.withColumn("partial_rho", F.when(scale > 1e-9, (F.col("raw_rho") - xz * yz) / scale))


def pooled_summary(per_group: DataFrame, rho="rho", n="n", by: Sequence[str] = ("score_name",)) -> DataFrame:
    """Across studies: n-weighted mean, median, number positive and exact sign test."""
    by = list(by)
    rows = once(per_group.filter(finite(rho) & F.col(n).isNotNull()).select(*by, rho, n))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("studies"),
        (F.sum(F.col(n) * F.col(rho)) / F.sum(n)).alias("weighted_mean_rho"),
        F.sum(F.when(F.col(rho) > 0, 1).otherwise(0)).alias("studies_positive"),
    )
    medians = group_quantiles(rows, by, rho, {"median_rho": 0.5})
    out = attach(out, medians, by)
    return out.withColumn("sign_test_p", binom_two_sided(F.col("studies_positive"), F.col("studies")))


def baseline_margin(
    summary: DataFrame, learned: Sequence[str], baselines: Sequence[str], by: Sequence[str] = (),
    name="score_name", value="weighted_mean_rho",
) -> DataFrame:
    """|rho| of each learned score less the largest |rho| among scores that know nothing."""
    by = list(by)
    best = (
        summary.filter(F.col(name).isin(*baselines) & F.col(value).isNotNull())
        .groupBy(*by)
        .agg(F.max_by(F.struct(F.col(name).alias("b"), F.col(value).alias("v")), F.struct(F.abs(value), F.col(name))).alias("__best"))
    )
    taught = summary.filter(F.col(name).isin(*learned)).select(
        *by, F.col(name).alias("learned"), F.col(value).alias("learned_rho")
    )
    joined = attach(taught, best, by, "left")
    best_rho = F.coalesce(F.col("__best.v"), F.lit(0.0))
    return joined.select(
        *by, "learned", "learned_rho", F.col("__best.b").alias("best_baseline"), best_rho.alias("best_baseline_rho"),
        (F.abs("learned_rho") - F.abs(best_rho)).alias("margin"),
    )


def stratified_view(
    df: DataFrame, scores: Sequence[str], target: str, stratum: str, group: Sequence[str] = (), min_n: int = 5,
    split="auto",
) -> DataFrame:
    """Mean rho inside fixed levels of a nuisance, beside the pooled rho, and whether sign flips."""
    group = list(group)
    measured = df.filter(finite(target) & F.col(stratum).isNotNull())
    out = rank_correlations(measured, scores, [target], group, split, stratum, min_n).select(
        *group, "score_name", "n", F.when(F.col("n") >= min_n, F.col("rho_0")).alias("pooled_rho"), "strata", "covered", "within_rho")
    flip = F.coalesce(F.signum("within_rho") != F.signum("pooled_rho"), F.lit(False))
    return out.withColumn("sign_flip", flip)


def readiness_survey(df, scores, target, nuisance, dataset: Sequence[str], min_n=5, split="auto") -> DataFrame:
    """Per data set: is the nuisance mixed, how it tracks the target, pooled and within rho."""
    dataset = list(dataset)
    view = stratified_view(df, scores, target, nuisance, dataset, min_n, split)
    mixed = (
        df.filter(finite(target)).groupBy(*dataset)
        .agg(F.min(nuisance).alias("__lo"), F.max(nuisance).alias("__hi"))
        .select(*dataset, (F.col("__lo") < F.col("__hi")).alias("mixed_stratum"))
    )
    nuisance_rho = spearman(df, nuisance, target, dataset, min_n, "nuisance_rho", split).drop("n")
    return view.join(mixed, dataset).join(nuisance_rho, dataset)


def auc_counts(hist: DataFrame, group, value: str, pos="n_pos", neg="n_neg", name="auc", split="auto", fanout=1) -> DataFrame:
    """AUC from a histogram of (value, positives, negatives): ties count half.

    Weighted counts are allowed, so resampled replicates only re-weight the histogram.
    """
    below = running(hist, group, [value], [Total("__below", neg)], split, fanout)
    wins = F.col(pos) * (F.coalesce("__below", F.lit(0)) + F.col(neg) / F.lit(2.0))
    return below.groupBy(*group).agg(
        F.sum(pos).alias("n_pos"), F.sum(neg).alias("n_neg"),
        F.try_divide(F.sum(wins), F.sum(pos).cast("double") * F.sum(neg)).alias(name),
    )


def label_histogram(df, group, score: str, label: str) -> DataFrame:
    """(group, score value) with counts of label 1 and label 0; other labels are ignored."""
    rows = df.filter(finite(score) & F.col(label).isin(0, 1)).withColumn("__v", F.col(score).cast("double"))
    counts = {"n_pos": F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), "n_neg": F.sum(F.when(F.col(label) == 0, 1).otherwise(0))}
    return value_counts(rows, group, "__v", counts)


def roc_auc(df, score: str, label: str, group: Sequence[str] = (), name="auc", split="auto") -> DataFrame:
    """Rank-sum AUC with average ties per group; null when a class is missing."""
    return auc_counts(label_histogram(df, group, score, label), group, "__v", name=name, split=split)


def macro_ovr_auc(df, class_scores: dict, label: str, group: Sequence[str] = (), split="auto") -> DataFrame:
    """Mean of one-vs-rest AUCs; ``class_scores`` maps a label value to its score column."""
    group = list(group)
    rows = df.withColumn(
        "__one", F.explode(F.array(*[
            F.struct(F.lit(c).alias("class"), F.col(s).cast("double").alias("s"), F.when(F.col(label) == c, 1).otherwise(0).alias("y"))
            for c, s in class_scores.items()
        ]))
    ).select(*group, F.col("__one.class").alias("class"), F.col("__one.s").alias("s"), F.col("__one.y").alias("y"))
    per_class = roc_auc(rows, "s", "y", [*group, "class"], split=split)
    return per_class.groupBy(*group).agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("classes"))


def _finite_pairs(df, score, target, group, key):
    return df.filter(finite(score) & finite(target)).select(
        *group, key, F.col(score).cast("double").alias("__s"), F.col(target).cast("double").alias("__t")
    )


def elite_metrics(
    df, score: str, target: str, key: str, group: Sequence[str] = (), fraction=0.10, floor=5, split="auto"
) -> DataFrame:
    """AUROC for membership of the target's top rows and fold enrichment of the score's top rows.

    Top means max(floor, half-even(fraction n)) rows, ties by key.  Null when n < 2 floor, when
    the top is everything or when a side is constant.
    """
    group = list(group)
    rows = _finite_pairs(df, score, target, group, key)
    if split == "auto":
        split = needs_split(rows, group)
    rows = top_flags(rows, group, key, {"__elite": "__t", "__picked": "__s"}, lambda n: elite_size(n, fraction, floor), split, "__n")
    k = elite_size("__n", fraction, floor)
    stats = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("__elite") & F.col("__picked"), 1).otherwise(0)).alias("hits"),
        F.max(k).alias("k"),
        (spread_ok("__s") & spread_ok("__t")).alias("__varied"),
    )
    labelled = rows.withColumn("__label", F.col("__elite").cast("int"))
    auc = roc_auc(labelled, "__s", "__label", group, "elite_auroc", split).drop("n_pos", "n_neg")
    usable = (F.col("n") >= 2 * floor) & (F.col("k") < F.col("n")) & F.col("__varied")
    out = attach(stats, auc, group)
    return out.select(
        *group, "n", "k", "hits",
        F.when(usable, F.col("elite_auroc")).alias("elite_auroc"),
        F.when(usable, F.col("hits") * F.col("n") / (F.col("k") * F.col("k").cast("double"))).alias("enrichment"),
    )


def topk_utility(df, score, target, key, group=(), fractions: Sequence[float] = (0.01, 0.10), floor=1, split="auto") -> DataFrame:
    """(mean target of the score's top - mean) / (mean of the target's own top - mean), per fraction."""
    group = list(group)
    rows = _finite_pairs(df, score, target, group, key)
    if split == "auto":
        split = needs_split(rows, group)
    rows = with_group_totals(rows, group, {"__n": F.count(F.lit(1))}, split)
    rows = numbered(rows, group, [("__s", "desc"), key], "__by_s", split)
    rows = numbered(rows, group, [("__t", "desc"), key], "__by_t", split)
    aggregates = [F.count(F.lit(1)).alias("n"), F.avg("__t").alias("__mean")]
    for i, f in enumerate(fractions):
        k = share(f, floor)(F.col("__n"))
        aggregates += [
            F.avg(F.when(F.col("__by_s") <= k, F.col("__t"))).alias(f"__got{i}"),
            F.avg(F.when(F.col("__by_t") <= k, F.col("__t"))).alias(f"__best{i}"),
        ]
    out = rows.groupBy(*group).agg(*aggregates)
    for i, f in enumerate(fractions):
        gain, room = F.col(f"__got{i}") - F.col("__mean"), F.col(f"__best{i}") - F.col("__mean")
        out = out.withColumn(f"utility_{_tag(f)}", F.when(F.abs(room) > 1e-12, gain / room))
    return out.select(*group, "n", *[f"utility_{_tag(f)}" for f in fractions])


def _tag(fraction: float) -> str:
    return f"{fraction * 100:g}pct".replace(".", "_")


def ndcg_at_k(df, score, target, key, k: int, group=(), split="auto") -> DataFrame:
    """Discounted gain with relevance = average-tie rank of the target / n, over its ideal."""
    group = list(group)
    rows = _finite_pairs(df, score, target, group, key)
    if split == "auto":
        split = needs_split(rows, group)
    rows = average_ranks(rows, group, ["__t"], "__rel", split)
    rows = with_group_totals(rows, group, {"__n": F.count(F.lit(1))}, split)
    rows = numbered(rows, group, [("__s", "desc"), key], "__by_s", split)
    rows = numbered(rows, group, [("__t", "desc"), key], "__by_t", split)
    relevance = F.col("__rel__t") / F.col("__n")
    gain = lambda place: F.sum(F.when(F.col(place) <= k, relevance / F.log2(F.col(place) + 1.0)))
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(gain("__by_s"), gain("__by_t")).alias("ndcg")
    )


def topk_recall(df, picked: str, target, key, group=(), fraction=0.01, split="auto") -> DataFrame:
    """Share of the target's top max(1, half-even(fraction n)) rows that a selection holds."""
    group = list(group)
    rows = top_flags(df.filter(finite(target)), group, key, {"__elite": target}, share(fraction), split, "__n")
    return rows.groupBy(*group).agg(
        F.max("__n").alias("n"),
        F.sum(F.when(F.col("__elite"), 1).otherwise(0)).alias("elite"),
        F.avg(F.when(F.col("__elite"), F.col(picked).cast("double"))).alias("recall"),
    )


def bulk_vs_elite(df, score, target, key, unit: Sequence[str], fractions=(0.01, 0.10), split="auto") -> DataFrame:
    """Per unit: rank correlation over everything beside utility at the top."""
    unit = list(unit)
    bulk = spearman(df, score, target, unit, name="bulk", split=split).drop("n")
    return topk_utility(df, score, target, key, unit, fractions, split=split).join(bulk, unit)


def pick_disagreement(df, a: str, b: str, key: str, k: int, group=(), split="auto") -> DataFrame:
    """1 - Jaccard of the top-k sets of two scorers."""
    rows = top_flags(df.filter(finite(a) & finite(b)), group, key, {"__a": a, "__b": b}, lambda n: F.lit(k), split, "__n")
    both = F.sum(F.when(F.col("__a") & F.col("__b"), 1).otherwise(0))
    either = F.sum(F.when(F.col("__a") | F.col("__b"), 1).otherwise(0))
    return rows.groupBy(*group).agg(both.alias("shared"), either.alias("picked"), (1 - F.try_divide(both, either)).alias("disagreement"))


def decision_flips(df, a, b, cut_a: str, cut_b: str, group=(), split="auto") -> DataFrame:
    """Pearson, Spearman, largest difference and how often two scorers decide differently."""
    group = list(group)
    rows = df.filter(finite(a) & finite(b))
    plain = rows.groupBy(*group).agg(
        safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"),
        F.max(F.abs(F.col(a) - F.col(b))).alias("max_abs_diff"),
        F.sum(F.when((F.col(a) >= F.col(cut_a)) != (F.col(b) >= F.col(cut_b)), 1).otherwise(0)).alias("flips"),
    )
    rho = spearman(rows, a, b, group, name="spearman", split=split)
    return attach(plain, rho, group)


def trend_rho(df, parameter: str, metric: str, by: Sequence[str], min_n=3) -> DataFrame:
    """Spearman between a sweep parameter and a metric, per scorer."""
    return spearman(df, parameter, metric, by, min_n, "trend")


def topk_accuracy(
    df, row: str, truth: str, candidate: str, score: str, ks=(1, 3, 5), by: Sequence[str] = (), split="auto"
) -> DataFrame:
    """Hit rate at k and mean reciprocal rank of the true class among scored candidates (long).

    Rows whose true class is not among the candidates count as misses.
    """
    by = list(by)
    ranked = numbered(df, [*by, row], [(score, "desc"), candidate], "__place", split)
    hit = ranked.groupBy(*by, row).agg(F.min(F.when(F.col(candidate) == F.col(truth), F.col("__place"))).alias("__at"))
    rates = [F.avg(F.when(F.col("__at") <= k, 1.0).otherwise(0.0)).alias(f"top{k}") for k in ks]
    return hit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *rates, F.avg(F.coalesce(1.0 / F.col("__at"), F.lit(0.0))).alias("mrr")
    )


def confusion_mcc(df, label: str, score: str, cut: str, group=()) -> DataFrame:
    """Matthews correlation of score >= cut against a 0/1 label."""
    flag, y = F.col(score) >= F.col(cut), F.col(label) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    out = df.groupBy(*group).agg(
        count(flag & y).alias("tp"), count(flag & ~y).alias("fp"), count(~flag & y).alias("fn"), count(~flag & ~y).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    scale = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return out.withColumn("mcc", F.coalesce(F.try_divide(tp * tn - fp * fn, scale), F.lit(0.0)))


def median_cut_mcc(df, label, score, group=(), split="auto") -> DataFrame:
    """Matthews correlation when the score is cut at its own group median."""
    group = list(group)
    medians = group_quantiles(df.filter(finite(score)), group, score, {"__cut": 0.5}, split)
    rows = df.filter(finite(score))
    rows = attach(rows, medians, group)
    return confusion_mcc(rows, label, score, "__cut", group)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

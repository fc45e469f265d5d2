"""Group statistics, duplicate handling and audits of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.numeric import finite, safe_corr, t_critical
from touchstone.functions.text import is_degenerate, longest_run_fraction
from touchstone.operators.agreement import spearman
from touchstone.operators.ranks import group_quantiles, value_counts
from touchstone.operators.running import Total, attach, numbered, running, with_group_totals, with_scalars
from touchstone.settings import cut_lineage, needs_split

# ---- scaling and conditions


def minmax_within(df, value: str, group: Sequence[str], name: str, sd: str | None = None, split="auto") -> DataFrame:
    """Scale a value to 0..1 inside each group; an attached deviation goes to the same units."""
    if split == "auto":
        split = needs_split(df, list(group))
    out = with_group_totals(df, group, {"__lo": F.min(value), "__hi": F.max(value)}, split)
    width = F.col("__hi") - F.col("__lo")
    out = out.withColumn(name, F.try_divide(F.col(value) - F.col("__lo"), width))
    if sd:
        out = out.withColumn(sd, F.try_divide(F.col(sd), width))
    return out.drop("__lo", "__hi")


def zscore_within(df, value: str, group: Sequence[str], name: str, split="auto") -> DataFrame:
    """(x - mean) / population deviation inside a group; centred only where the deviation is nil."""
    if split == "auto":
        split = needs_split(df, list(group))
    out = with_group_totals(df, group, {"__mean": F.avg(value), "__sd": F.stddev_pop(value)}, split)
    centred = F.col(value) - F.col("__mean")
    return out.withColumn(name, F.when(F.col("__sd") > 1e-12, centred / F.col("__sd")).otherwise(centred)).drop("__mean", "__sd")


def condition_levels(df, target: str, columns: Sequence[str], max_levels: int = 12, max_unique: float = 0.5) -> DataFrame:
    """Per column: distinct non-null levels among measured rows and whether it acts as a condition.

    Roles: "constant" (one level), "condition", or "ignored" (too fine to be a condition).
    """
    measured = df.filter(finite(target))
    wide = measured.agg(F.count(F.lit(1)).alias("__n"), *[F.count_distinct(F.col(c)).alias(c) for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("levels")) for c in columns])).alias("c")
    out = wide.select("__n", cells).select("__n", "c.*")
    fine = (F.col("levels") > max_levels) | (F.col("levels") > max_unique * F.col("__n"))
    return out.select("column", "levels", F.when(F.col("levels") <= 1, "constant").when(fine, "ignored").otherwise("condition").alias("role"))


def select_stratum(df, target: str, label: str, declared: Column, wanted: str | None = None) -> DataFrame:
    """Rows of the most frequent condition among measured rows (or the one that matches ``wanted``),
    with candidates that declare no condition.  Ties go to the first label in order."""
    measured = finite(target)
    counts = df.filter(measured).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    if wanted is not None:
        counts = counts.filter(F.contains(F.lower(F.col(label)), F.lit(wanted.lower())))
    top = counts.orderBy(F.desc("__n"), label).limit(1).select(F.col(label).alias("__chosen"))
    return with_scalars(df, top).filter((F.col(label) == F.col("__chosen")) | (~measured & ~declared)).drop("__chosen")


# ---- duplicates


def content_key(text) -> Column:
    """128-bit digest of a string, the grouping key for exact copies."""
    return F.md5(F.col(text) if isinstance(text, str) else text)


def dedup_units(df, key: str, content: Column) -> DataFrame:
    """One row per distinct content: the smallest key and the number of copies.

    Copies are reduced on the map side; a text that makes up a third of the table costs one row
    per task, and no list of its copies is ever gathered.
    """
    return df.select(F.col(key), content.alias("content")).groupBy("content").agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def dedup_effect(df, key: str, content: Column, metrics: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """The same aggregates before and after keeping one unit per distinct content."""
    group = list(group)
    marked = df.withColumn("__content", content)
    kept = marked.groupBy("__content").agg(F.min(key).alias(key)).select(key)
    before = df.groupBy(*group).agg(F.count(F.lit(1)).alias("units"), *[m.alias(n) for n, m in metrics.items()])
    after = df.join(kept, key, "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("units"), *[m.alias(n) for n, m in metrics.items()])
    return before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))


def dedup_conflicts(df, key: str, content: Column, label: str) -> DataFrame:
    """One row per content whose copies carry a single label: smallest key, label, copies."""
    per = df.withColumn("content", content).groupBy("content").agg(
        F.min(key).alias(key), F.min(label).alias("__lo"), F.max(label).alias("__hi"), F.count(F.lit(1)).alias("copies"))
    return per.filter(F.col("__lo") == F.col("__hi")).select("content", key, F.col("__lo").alias(label), "copies")


def conflict_counts(df, content: Column, label: str) -> DataFrame:
    """How many contents and rows agree on a label, and how many are dropped for conflict."""
    per = df.select(content.alias("content"), label).groupBy("content").agg(
        F.min(label).alias("__lo"), F.max(label).alias("__hi"), F.count(F.lit(1)).alias("__n"))
    clash = F.col("__lo") != F.col("__hi")
    return per.agg(
        F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("contents"),
        F.sum(F.when(clash, 1).otherwise(0)).alias("conflicting"),
        F.sum(F.when(~clash, 1).otherwise(0)).alias("kept"))


def collapse_duplicates(df, keys: Sequence[str], values: Sequence[str], split="auto") -> DataFrame:
    """Median of each value per key."""
    keys = list(keys)
    if split == "auto":
        split = needs_split(df, keys)
    if not split:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *[F.percentile(v, F.lit(0.5)).alias(v) for v in values])
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    for v in values:
        out = attach(out, group_quantiles(df, keys, v, {v: 0.5}, True), keys, "left")
    return out


def keep_first(df, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in an order, by a partial-aggregating minimum (no sort)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__f"))
    return first.select(*keys, "__f.*")


# ---- audits of result tables


def result_self_audit(df, a: str, b: str, profile: str, significant: str, order: str) -> DataFrame:
    """Duplicate rows, self pairs, hit rates before and after cleaning, most frequent winners."""
    pair = F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    rows = df.withColumn("pair", pair)
    per = rows.groupBy("pair", profile).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(significant).cast("int")).alias("__hits"),
        F.min_by(significant, order).alias("__sig"), F.min(F.col(a) == F.col(b)).alias("__self"))
    clean = per.filter(~F.col("__self"))
    totals = per.agg(
        F.sum("__n").alias("n_rows"), F.sum(F.col("__n") - 1).alias("n_duplicate_rows"),
        F.sum(F.col("__self").cast("int")).alias("n_self_rows"), F.sum("__hits").alias("hits_raw"),
        F.sum((~F.col("__self")).cast("int")).alias("experiments_clean"),
        F.sum((~F.col("__self") & F.col("__sig")).cast("int")).alias("hits_clean"))
    hits = clean.filter("__sig")
    by_pair = hits.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    by_profile = hits.groupBy(profile).agg(F.count(F.lit(1)).alias("n"))
    top_pair = by_pair.agg(F.min_by("pair", F.struct(-F.col("n"), F.col("pair"))).alias("top_pair"), F.max("n").alias("top_pair_hits"))
    top_profile = by_profile.agg(F.min_by(profile, F.struct(-F.col("n"), F.col(profile))).alias("top_profile"))
    out = with_scalars(with_scalars(totals, top_pair), top_profile)
    return out.withColumn("hit_rate_raw", 100.0 * F.col("hits_raw") / F.col("n_rows")).withColumn(
        "hit_rate_clean", F.try_divide(100.0 * F.col("hits_clean"), F.col("experiments_clean")))


def modal_target(df, signature: Sequence[str], target: str, wanted=None, delta: str | None = None) -> DataFrame:
    """Per signature: rows, share that hits a wanted target, modal target and its share, mean delta."""
    signature = list(signature)
    sums = [F.sum(delta).alias("__d")] if delta else []
    counts = df.groupBy(*signature, target).agg(F.count(F.lit(1)).alias("__n"), *sums)
    out = counts.groupBy(*signature).agg(
        F.sum("__n").alias("n"),
        F.min_by(target, F.struct(-F.col("__n"), F.col(target))).alias("modal_target"), F.max("__n").alias("__top"),
        *([F.sum(F.when(F.col(target) == F.lit(wanted), F.col("__n")).otherwise(0)).alias("__hit")] if wanted is not None else []),
        *([F.sum("__d").alias("__dsum")] if delta else []))
    out = out.withColumn("modal_share", F.col("__top") / F.col("n"))
    if wanted is not None:
        out = out.withColumn("target_share", F.col("__hit") / F.col("n"))
    if delta:
        out = out.withColumn("mean_delta", F.col("__dsum") / F.col("n"))
    return out.drop("__top", "__hit", "__dsum")


def hub_enrichment(df, signature: Sequence[str], target: str) -> DataFrame:
    """Concentration on the modal target over that target's overall frequency, with both ranks."""
    signature = list(signature)
    counts = df.groupBy(*signature, target).agg(F.count(F.lit(1)).alias("__n"))
    overall = counts.groupBy(target).agg(F.sum("__n").alias("__hub"))
    total = overall.agg(F.sum("__hub").alias("__all"))
    modal = counts.groupBy(*signature).agg(
        F.sum("__n").alias("n"), F.max("__n").alias("__top"), F.min_by(target, F.struct(-F.col("__n"), F.col(target))).alias(target))
    joined = with_scalars(modal.join(overall, target), total)
    out = joined.select(
        *signature, F.col(target).alias("modal_target"), "n",
        (F.col("__top") / F.col("n")).alias("concentration"), (F.col("__hub") / F.col("__all")).alias("hubness"))
    out = out.withColumn("enrichment", F.col("concentration") / F.col("hubness"))
    ranked = running(
        out.groupBy("enrichment").agg(F.count(F.lit(1)).alias("__c")), [], [("enrichment", "desc")], [Total("__b", "__c")])
    ranked = ranked.select("enrichment", (F.coalesce("__b", F.lit(0)) + 1).alias("rank_enrichment"))
    raw = running(
        out.groupBy("concentration").agg(F.count(F.lit(1)).alias("__c")), [], [("concentration", "desc")], [Total("__b", "__c")])
    raw = raw.select("concentration", (F.coalesce("__b", F.lit(0)) + 1).alias("rank_concentration"))
    return out.join(ranked, "enrichment").join(raw, "concentration")


def category_gap(df, entity: Sequence[str], category: str, value: str, focus) -> DataFrame:
    """Per entity: mean of one category minus the mean of the means of the others."""
    entity = list(entity)
    means = df.groupBy(*entity, category).agg(F.avg(value).alias("__m"))
    mine = F.col(category) == F.lit(focus)
    out = means.groupBy(*entity).agg(
        F.avg(F.when(mine, F.col("__m"))).alias("focus_mean"), F.avg(F.when(~mine, F.col("__m"))).alias("others_mean"))
    return out.withColumn("gap", F.col("focus_mean") - F.col("others_mean"))


def quality_profile(df, text: str, group: Sequence[str], limit: float = 0.3, valid: Column | None = None, split="auto") -> DataFrame:
    """Rows, degenerate count and rate, mean and median longest-run share, rate of valid rows."""
    group = list(group)
    valid = valid if valid is not None else F.length(text) > 0
    # Texts are read once: what is counted and what is ranked come from the same few numbers of a row.
    shares = df.select(*group, F.col(text).alias("__t"), longest_run_fraction(text).alias("__f"), valid.cast("int").alias("__v"))
    rows = shares.select(*group, is_degenerate("__t", limit, F.col("__f")).cast("int").alias("__d"), "__f", "__v")
    if split == "auto":
        split = needs_split(rows, group)
    figures = [
        F.count(F.lit(1)).alias("n"), F.sum("__d").alias("degenerate"), F.avg("__d").alias("degenerate_rate"),
        F.avg("__f").alias("mean_run_fraction"), F.avg("__v").alias("valid_rate")]
    if not split:
        return rows.groupBy(*group).agg(*figures, F.percentile("__f", F.lit(0.5)).alias("median_run_fraction"))
    rows = cut_lineage(rows)
    return attach(rows.groupBy(*group).agg(*figures), group_quantiles(rows, group, "__f", {"median_run_fraction": 0.5}, True), group, "left")


def filter_inflation(df, kept: Column, amounts: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """Totals of each method with and without a filter, and the ratio by which it inflates."""
    aggregates = []
    for name, amount in amounts.items():
        aggregates += [F.sum(amount).alias(f"{name}_all"), F.sum(F.when(kept, amount).otherwise(0)).alias(f"{name}_kept")]
    out = df.groupBy(*group).agg(*aggregates)
    return out.withColumns({f"{n}_ratio": F.try_divide(F.col(f"{n}_all"), F.col(f"{n}_kept")) for n in amounts})


# ---- shapes of score distributions


def score_geometry(df, value: str, group: Sequence[str] = (), min_n: int = 20, split="auto") -> DataFrame:
    """Top separation, tie share, skew, excess kurtosis and IQR over range of a score."""
    group = list(group)
    rows = df.filter(finite(value)).select(*group, F.col(value).cast("double").alias("__z"))
    if split == "auto":
        split = needs_split(rows, group)
    base = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.skewness("__z").alias("skew"), F.kurtosis("__z").alias("excess_kurtosis"),
        (F.max("__z") - F.min("__z")).alias("__range")).filter(F.col("n") >= min_n)
    quart = group_quantiles(rows, group, "__z", {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75}, split)
    ties = value_counts(rows.withColumn("__r", F.round("__z", 9)), group, "__r")
    ties = ties.groupBy(*group).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("__tied"))
    # Mean of the k largest from the value counts: a running count from the top.
    hist = running(value_counts(rows, group, "__z"), group, [("__z", "desc")], [Total("__before", "n")], split)
    hist = attach(hist.withColumnRenamed("n", "__n"), base.select(*group, "n"), group)
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 100))
    taken = F.greatest(F.lit(0), F.least(F.col("__n"), k - F.coalesce("__before", F.lit(0))))
    top = hist.groupBy(*group).agg((F.sum(taken * F.col("__z")) / F.sum(taken)).alias("__top"))
    out = attach(attach(attach(base, quart, group), ties, group), top, group)
    iqr = F.col("__q3") - F.col("__q1")
    return out.select(
        *group, "n", F.try_divide(F.col("__top") - F.col("__q2"), iqr).alias("top_separation"),
        (F.col("__tied") / F.col("n")).alias("tie_share"), "skew", "excess_kurtosis", F.try_divide(iqr, F.col("__range")).alias("iqr_over_range"))


def otsu_split(df, value: str, group: Sequence[str] = (), bins: int = 256, min_n: int = 20) -> DataFrame:
    """Histogram threshold that maximises between-class variance, and the share below it.

    Only ``bins`` counts per group leave the first aggregation.
    """
    group = list(group)
    rows = df.filter(finite(value)).select(*group, F.col(value).cast("double").alias("__y"))
    ends = rows.groupBy(*group).agg(F.min("__y").alias("__lo"), F.max("__y").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    ends = ends.filter((F.col("__n") >= min_n) & (F.col("__lo") < F.col("__hi")))
    placed = attach(rows, ends, group)
    bucket = F.least(F.width_bucket("__y", "__lo", "__hi", F.lit(bins)), F.lit(bins))
    hist = placed.groupBy(*group, "__lo", "__hi", "__n", bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    hist = hist.withColumn("__centre", F.col("__lo") + (F.col("__b") - 0.5) * width).withColumn("__w", F.col("__c") / F.col("__n"))
    hist = hist.withColumn("__wc", F.col("__w") * F.col("__centre"))
    # At most ``bins`` rows per group: one task each.
    run = running(hist, group, ["__b"], [Total("__w0", "__w", inclusive=True), Total("__m0", "__wc", inclusive=True)], split=False)
    run = with_group_totals(run, group, {"__mt": F.sum("__wc")}, split=False)
    spread = F.col("__w0") * (1 - F.col("__w0"))
    between = F.when(spread > 1e-12, F.pow(F.col("__mt") * F.col("__w0") - F.col("__m0"), 2) / spread).otherwise(-1.0)
    cut = run.withColumn("__v", between).groupBy(*group).agg(
        F.max_by("__centre", F.struct(F.round("__v", 12), -F.col("__b"))).alias("threshold"))
    below = attach(rows, cut, group)
    return below.groupBy(*group, "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("__y") < F.col("threshold")).cast("double")).alias("share_below"))


# ---- linear trends on unit tables


def trend_residual(units: DataFrame, x: str, y: str, group: Sequence[str] = (), fit_on: Column | None = None, name="residual") -> DataFrame:
    """y less its linear fit on x, per group; the fit may use a reference subset only."""
    keep = fit_on if fit_on is not None else F.lit(True)
    xs, ys = F.when(keep, F.col(x)), F.when(keep, F.col(y))
    fit = units.groupBy(*group).agg(F.regr_slope(ys, xs).alias("__s"), F.regr_intercept(ys, xs).alias("__i"))
    return attach(units, fit, group).withColumn(name, F.col(y) - (F.col("__s") * F.col(x) + F.col("__i"))).drop("__s", "__i")


def explain_gap(units: DataFrame, bulk: str, utility: str, candidate: str, side: str) -> DataFrame:
    """Does a candidate explain the utility gap between two sides left after a trend on bulk?

    rho(candidate, residual); gap of mean residual between the sides (side 1 minus side 0) before
    and after adding the candidate to the fit; rho inside each side; spread inside each side.
    """
    rows = trend_residual(units.filter(finite(bulk) & finite(utility) & finite(candidate)), bulk, utility)
    rho = spearman(rows, candidate, "residual", name="rho").select("n", "rho")
    b, u, c, s = (F.col(v).cast("double") for v in (bulk, utility, candidate, side))
    # Two-predictor least squares in closed form from second moments.
    m = rows.agg(
        F.avg(b).alias("mb"), F.avg(c).alias("mc"), F.avg(u).alias("mu"),
        F.var_pop(b).alias("vb"), F.var_pop(c).alias("vc"), F.covar_pop(b, c).alias("bc"),
        F.covar_pop(b, u).alias("bu"), F.covar_pop(c, u).alias("cu"))
    det = F.col("vb") * F.col("vc") - F.col("bc") * F.col("bc")
    m = m.withColumn("kb", F.try_divide(F.col("bu") * F.col("vc") - F.col("cu") * F.col("bc"), det)).withColumn(
        "kc", F.try_divide(F.col("cu") * F.col("vb") - F.col("bu") * F.col("bc"), det))
    both = with_scalars(rows, m.select("mb", "mc", "mu", "kb", "kc"))
    left = u - F.col("mu") - F.col("kb") * (b - F.col("mb")) - F.col("kc") * (c - F.col("mc"))
    gap = lambda v: F.avg(F.when(s == 1, v)) - F.avg(F.when(s == 0, v))
    gaps = both.agg(
        gap(F.col("residual")).alias("gap_before"), gap(left).alias("gap_after"),
        F.stddev_pop(F.when(s == 1, c)).alias("spread_1"), F.stddev_pop(F.when(s == 0, c)).alias("spread_0"))
    inside = spearman(rows, candidate, "residual", [side], name="r")
    inside = inside.agg(F.max(F.when(F.col(side) == 1, F.col("r"))).alias("rho_1"), F.max(F.when(F.col(side) == 0, F.col("r"))).alias("rho_0"))
    return with_scalars(with_scalars(rho, gaps), inside)


def scaling_trend(units, size: str, metric: str, at: float, group: Sequence[str] = ()) -> DataFrame:
    """Line of a metric on log10(size), its value extrapolated to a size, and the largest size seen."""
    x = F.log10(size)
    out = units.groupBy(*group).agg(
        F.count(F.lit(1)).alias("points"), F.regr_slope(F.col(metric), x).alias("slope"), F.regr_intercept(F.col(metric), x).alias("intercept"),
        F.max_by(metric, size).alias("actual_at_largest"), F.max(size).alias("largest"))
    return out.withColumn("extrapolated", F.col("intercept") + F.col("slope") * F.log10(F.lit(float(at))))


# ---- sampling, noise and agreement


def sampling_profile(df, group: Sequence[str], position: str, wt: str, mut: str, letter: str = "A") -> DataFrame:
    """How a set of edits samples positions: counts, shares to and from a letter, top share, Gini.

    The Gini term needs positions in count order; equal counts make one row each of a histogram
    of counts, which is what gets ordered.
    """
    group = list(group)
    base = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(mut) == letter).cast("double")).alias("share_to"),
        F.avg((F.col(wt) == letter).cast("double")).alias("share_from"), F.count_distinct(mut).alias("distinct_letters"))
    counts = df.groupBy(*group, position).agg(F.count(F.lit(1)).alias("__c"))
    hist = counts.groupBy(*group, "__c").agg(F.count(F.lit(1)).alias("__k"))
    hist = hist.withColumn("__mass", F.col("__c") * F.col("__k"))
    run = running(hist, group, ["__c"], [Total("__before", "__mass")])
    # Sum over k equal counts of the cumulative totals: k*before + c*k(k+1)/2.
    cum = F.col("__k") * F.coalesce("__before", F.lit(0)) + F.col("__c") * F.col("__k") * (F.col("__k") + 1) / 2
    per = run.groupBy(*group).agg(
        F.sum("__k").alias("n_positions"), F.max("__c").alias("__top"), F.sum(cum).alias("__cum"), F.sum("__mass").alias("__all"))
    out = attach(base, per, group)
    gini = (F.col("n_positions") + 1 - 2 * F.col("__cum") / F.col("__all")) / F.col("n_positions")
    return out.select(
        *group, "n", "n_positions", "share_to", "share_from", (F.col("__top") / F.col("n")).alias("top_position_share"),
        F.when(F.col("n_positions") > 1, gini).otherwise(1.0).alias("gini"),
        (F.col("n") / F.col("n_positions")).alias("per_position"), "distinct_letters")


def chunk_aggregate(df, group: Sequence[str], chunk: str, value: str) -> DataFrame:
    """Mean, median, max, min, nearest and farthest of a value over chunks."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("chunks"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.max(value).alias("max"), F.min(value).alias("min"),
        F.min_by(value, chunk).alias("nearest"), F.max_by(value, chunk).alias("farthest"))


def t_summary(df, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean, standard error, t interval and number positive per group."""
    out = df.filter(finite(value)).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("__sd"),
        F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).alias("positive"))
    se = F.col("__sd") / F.sqrt("n")
    half = t_critical(F.col("n") - 1) * se
    return out.withColumn("se", se).withColumn("lo", F.col("mean") - half).withColumn("hi", F.col("mean") + half).drop("__sd")


def two_grain_summary(df, value: str, unit: Sequence[str], cluster: str) -> DataFrame:
    """t summaries over units, and over cluster means of unit means."""
    units = df.groupBy(*unit, cluster).agg(F.avg(value).alias("__u"))
    clusters = units.groupBy(cluster).agg(F.avg("__u").alias("__u"))
    a = t_summary(units, "__u").withColumn("grain", F.lit("unit"))
    return a.unionByName(t_summary(clusters, "__u").withColumn("grain", F.lit("cluster")))


def category_breakdown(df, category: Sequence[str], value: str, below: float, split="auto") -> DataFrame:
    """Mean, median and count below a threshold per category."""
    category = list(category)
    out = df.groupBy(*category).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(F.when(F.col(value) < below, 1).otherwise(0)).alias("below"))
    return attach(out, group_quantiles(df, category, value, {"median": 0.5}, split), category, "left")


def noise_model(df, partner: Sequence[str], published: str, enrichment: str, difference: str, depth: str, key: str, split="auto") -> DataFrame:
    """Per row: measuring deviation in published units.

    Replicate differences are fit as a + b / sqrt(depth), clipped to [1e-3, 99th percentile] and
    scaled by the slope of the published value on log-enrichment; missing ones take the median.
    """
    partner = list(partner)
    spread = F.abs(F.col(difference)) / F.sqrt(F.lit(2.0))
    rows = df.withColumn("__y", F.when(F.col(depth) > 0, spread)).withColumn("__x", F.when(F.col(depth) > 0, 1 / F.sqrt(depth)))
    fits = rows.groupBy(*partner).agg(
        F.abs(F.regr_slope(F.col(published), F.col(enrichment))).alias("__unit"),
        F.regr_slope(F.col("__y"), F.col("__x")).alias("__b"), F.regr_intercept(F.col("__y"), F.col("__x")).alias("__a"))
    caps = group_quantiles(rows, partner, "__y", {"__cap": 0.99, "__mid": 0.5}, split)
    out = attach(attach(rows, fits, partner), caps, partner)
    raw = F.coalesce(F.col("__a") + F.col("__b") * F.col("__x"), F.col("__mid"))
    return out.select(*partner, key, (F.least(F.greatest(raw, F.lit(1e-3)), F.col("__cap")) * F.col("__unit")).alias("noise_sd"))


def reproduction_check(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Compare two runs by shared keys: matched, missing on either side, largest difference."""
    left = a.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    both = left.join(right, list(keys), "full_outer")
    gap = F.abs(F.col("__a") - F.col("__b"))
    return both.agg(
        F.count_if(F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()).alias("matched"),
        F.count_if(F.col("__in_b").isNull()).alias("only_a"), F.count_if(F.col("__in_a").isNull()).alias("only_b"),
        F.max(gap).alias("max_abs_diff"), F.count_if(gap > tolerance).alias("differ"))


def level_agreement(df, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Rank agreement and mean absolute difference of two versions of one level."""
    gap = df.filter(finite(a) & finite(b)).groupBy(*group).agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_diff"))
    return attach(spearman(df, a, b, group), gap, group)


def attenuation_ceiling(df, value: str, label: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """sqrt(max(b^2 - w^2, 0)) / b from mean within-label and between-row deviations."""
    group = list(group)
    inner = df.groupBy(*group, *label).agg(F.stddev_samp(value).alias("__w")).groupBy(*group).agg(F.avg("__w").alias("within_sd"))
    outer = df.groupBy(*group).agg(F.stddev_samp(value).alias("between_sd"))
    room = F.greatest(F.col("between_sd") ** 2 - F.col("within_sd") ** 2, F.lit(0.0))
    return attach(inner, outer, group).withColumn("ceiling", F.try_divide(F.sqrt(room), F.col("between_sd")))


def draw_variance(df, by: Sequence[str], seed: str, delta: str) -> DataFrame:
    """Mean delta per (contrast, seed), then deviation and range over seeds."""
    means = df.groupBy(*by, seed).agg(F.avg(delta).alias("__m"))
    return means.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("seed_sd"),
        (F.max("__m") - F.min("__m")).alias("seed_range"))


def partner_margins(df, entity: Sequence[str], partner: str, key: str, value: str, min_shared: int = 3) -> DataFrame:
    """Pairs of partners (a < b) of an entity with enough shared keys: margins b - a.

    Repeats are averaged first, so a key joins at most the entity's partners with each other.
    """
    entity = list(entity)
    one = df.groupBy(*entity, partner, key).agg(F.avg(value).alias("v"))
    a = one.select(*entity, key, F.col(partner).alias("a"), F.col("v").alias("va"))
    b = one.select(*entity, key, F.col(partner).alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, [*entity, key]).filter(F.col("a") < F.col("b"))
    out = pairs.groupBy(*entity, "a", "b").agg(
        F.count(F.lit(1)).alias("shared"), F.avg(F.col("vb") - F.col("va")).alias("mean_margin"), safe_corr("va", "vb").alias("corr"))
    return out.filter(F.col("shared") >= min_shared)


def present_everywhere(df, item: str, partner: str) -> DataFrame:
    """Items measured for every partner."""
    partners = df.agg(F.count_distinct(partner).alias("__k"))
    per = df.select(item, partner).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("__n"))
    return with_scalars(per, partners).filter(F.col("__n") == F.col("__k")).select(item)


def baseline_pairing(df, key: Sequence[str], config: str, baseline, value: str) -> DataFrame:
    """Each configuration's difference to the same key's baseline configuration."""
    base = df.filter(F.col(config) == F.lit(baseline)).select(*key, F.col(value).alias("baseline_value"))
    return df.filter(F.col(config) != F.lit(baseline)).join(base, list(key)).withColumn("delta", F.col(value) - F.col("baseline_value"))


def fallback_lookup(df, origin: str, specific: DataFrame, general: DataFrame, value: str) -> DataFrame:
    """A per-origin value, or the general one-row value where the origin is unknown."""
    out = df.join(specific.select(origin, F.col(value).alias("__s")), origin, "left")
    out = with_scalars(out, general.select(F.col(value).alias("__g")))
    return out.withColumn(value, F.coalesce("__s", "__g")).drop("__s", "__g")


def histogram_match(df, side: str, value: str, width: float, key: str, seed: int = 0, group: Sequence[str] = ()) -> DataFrame:
    """Trim two pools (side 0 and 1) to identical histograms of a value.

    Each bin keeps as many rows of each side as the smaller side has, chosen by keyed hash.
    """
    from touchstone.functions.numeric import keyed_int

    group = list(group)
    rows = df.withColumn("bin", F.floor(F.col(value) / width)).withColumn("__h", keyed_int(seed, key))
    sizes = rows.groupBy(*group, "bin").agg(
        F.least(F.sum(F.when(F.col(side) == 0, 1).otherwise(0)), F.sum(F.when(F.col(side) == 1, 1).otherwise(0))).alias("__m"))
    placed = numbered(rows, [*group, "bin", side], ["__h", key], "__rn")
    return attach(placed, sizes, [*group, "bin"]).filter(F.col("__rn") <= F.col("__m")).drop("__rn", "__m", "__h")

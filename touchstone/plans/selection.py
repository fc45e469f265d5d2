"""Choosing batches and replaying campaigns, set-based over all cells at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchstone.functions.numeric import finite, half_even, keyed_int
from touchstone.operators import agreement as ag
from touchstone.operators import linear as ln
from touchstone.operators.ranks import share, top_flags
from touchstone.operators.running import Total, attach, numbered, ordering, running, with_group_totals
from touchstone.operators.vectors import farthest_points, top_matches
from touchstone.settings import BROADCAST_BYTES, cut_lineage, needs_split, setting


def select_by_score(df, score: str, target: str, key: str, budget: int, group: Sequence[str] = ()) -> DataFrame:
    """Top ``budget`` candidates (rows without a target) by a score."""
    pool = df.filter(~finite(target) & finite(score)).withColumn("pick_score", F.col(score).cast("double"))
    placed = numbered(pool, list(group), [("pick_score", "desc"), key], "place")
    return placed.filter(F.col("place") <= budget)


def select_by_model(df, features: Sequence[str], target: str, key: str, budget: int, group: Sequence[str] = (), lam: float = 1.0, beta: float = 0.0) -> DataFrame:
    """Top candidates by a ridge on own measurements, optionally plus beta * sd * relative novelty.

    Novelty is the L1 distance to the nearest measured row of the group (:func:`novelties`).
    """
    group = list(group)
    scored = ln.ridge_by_group(df, features, target, group, lam)
    pool = scored.filter(~finite(target)).withColumn("pick_score", F.round("prediction", 9))
    if beta > 0:
        pool = attach(pool, novelties(df, features, target, key, group), [*group, *features])
        sds = df.filter(finite(target)).groupBy(*group).agg(F.stddev_pop(target).alias("__sd"))
        tops = pool.groupBy(*group).agg(F.max("novelty").alias("__top"))
        pool = attach(attach(pool, sds, group), tops, group)
        bonus = F.lit(beta) * F.col("__sd") * F.col("novelty") / (F.col("__top") + 1e-9)
        pool = pool.withColumn("pick_score", F.round(F.col("prediction") + bonus, 9)).drop("__sd", "__top")
    placed = numbered(pool, group, [("pick_score", "desc"), key], "place")
    return placed.filter(F.col("place") <= budget)


def novelties(df, features: Sequence[str], target: str, key: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, features, novelty): L1 distance of every distinct unmeasured vector to the nearest measured one of its group.

    Of one feature it is the gap to the next smaller or larger measured value, from running totals; of more, equal vectors
    meet the blocked exact matcher once.
    """
    group, features = list(group), list(features)
    known = F.lit(True)
    for f in features:
        known = known & finite(f)
    seen = F.max(finite(target)).alias("__seen")
    kinds = df.filter(known).groupBy(*group, *features).agg(seen, F.min(finite(target)).alias("__all"), F.min(key).alias("__k"))
    if len(features) == 1:
        x = F.col(features[0]).cast("double")
        marked = kinds.withColumn("__up", F.when(F.col("__seen"), x)).withColumn("__down", F.col("__up"))
        out = running(marked, group, [features[0]], [Total("__below", "__up", "max", inclusive=True)])
        out = running(out, group, [(features[0], "desc")], [Total("__above", "__down", "min", inclusive=True)])
        out = out.withColumn("novelty", F.round(F.least(x - F.col("__below"), F.col("__above") - x), 12))
        return out.filter(~F.col("__all") & F.col("novelty").isNotNull()).select(*group, *features, "novelty")
    if group:  # without a measured row in its group a vector has no novelty
        kinds = attach(kinds, kinds.groupBy(*group).agg(F.max("__seen").alias("__any")), group).filter("__any").drop("__any")
    # Rows of different groups never match: the group is made a far-away component of its own.
    tag = [(F.xxhash64(*group) % 1_000_003).cast("double") * 1e12] if group else []
    vec = F.array(*[F.col(f).cast("double") for f in features], *tag)
    near = top_matches(
        kinds.filter(~F.col("__all")).select("__k", vec.alias("__v")), "__k", "__v",
        kinds.filter("__seen").select(F.col("__k").alias("__m"), vec.alias("__w")), "__m", "__w", 1, "l1")
    near = near.select("__k", (-F.col("closeness")).alias("novelty"))
    return kinds.filter(~F.col("__all")).join(near, "__k").select(*group, *features, "novelty")


def select_diverse(df, features: Sequence[str], target: str, key: str, budget: int, group: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Farthest-point batch of the candidates."""
    pool = df.filter(~finite(target)).select(*group, key, F.array(*[F.col(f).cast("double") for f in features]).alias("__v"))
    return farthest_points(pool, key, "__v", budget, group, seed)


STATIC, ADAPTIVE = ("random", "score"), ("ridge", "ucb", "epsilon", "planner")


def backtest_grid(
    df, features: Sequence[str], target: str, scores: Sequence[str], key: str, group: Sequence[str] = (), policies: Sequence[str] = ("random", "score", "ridge"),
    seeds: int = 3, budget: int = 10, rounds: int = 3, lam: float = 1.0, beta: float = 1.0, epsilon: float = 0.1, top_fraction: float = 0.01,
) -> DataFrame:
    """Per (group, policy): mean and deviation over seeds of top recall and of the best value found.

    Every measured row may be ordered in any order.  Rank-only policies are one cut at budget * rounds; adaptive ones
    advance all (group, policy, seed) cells together, one round per step.  What is kept of a round are its picks, at most
    ``budget`` rows of a cell: the candidates are the measured rows, which are written once, without them.
    """
    group = list(group)
    cell = [*group, "policy", "seed"]
    spark = df.sparkSession
    base = df.filter(finite(target)).withColumn("__y", F.col(target).cast("double"))
    base = top_flags(base, group, key, {"__elite": "__y"}, share(top_fraction), total_name="__pool")
    keep = [*group, key, "__y", "__elite", "__pool", *dict.fromkeys([*features, *scores])]
    # Groups leave few tasks; rows are dealt out before there are ``seeds`` of each and policy.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    base = cut_lineage(base.select(*keep).repartition(tasks, key).withColumn("__id", F.monotonically_increasing_id()))
    groups = cut_lineage(base.groupBy(*group).agg(
        F.sum(F.col("__elite").cast("double")).alias("__elites"), F.min("__y").alias("__lo"), F.max("__y").alias("__hi")).filter("__lo IS NOT NULL"))
    seeded = base.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    parts = []
    fixed = [p for p in policies if p in STATIC]
    if fixed:
        rows = seeded.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in fixed]))).withColumn("__h", keyed_int(0, "seed", key))
        order = F.when(F.col("policy") == "score", -F.col(scores[0]).cast("double")).otherwise(F.col("__h").cast("double"))
        parts.append(_first(rows.withColumn("__o", order), cell, ["__o", key], budget * rounds).select(*cell, "__y", "__elite"))
    moving = [p for p in policies if p in ADAPTIVE]
    if moving:
        rows = seeded.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in moving])))
        bytes_of_picks = groups.count() * len(moving) * seeds * budget * rounds * 8 * (len(keep) + 4)
        held = F.broadcast if bytes_of_picks <= setting(spark, BROADCAST_BYTES) else lambda table: table
        parts.append(_replay(rows, features, scores, key, cell, budget, rounds, lam, beta, epsilon, set(moving), held).select(*cell, "__y", "__elite"))
    found = ag.union_all(parts).groupBy(*cell).agg(F.sum(F.col("__elite").cast("double")).alias("__hits"), F.max("__y").alias("__best"))
    cells = groups.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in (*fixed, *moving)]))).withColumn(
        "seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    outcome = attach(cells, found, cell, "left").withColumn("__recall", F.try_divide(F.coalesce("__hits", F.lit(0.0)), F.col("__elites")))
    norm = F.when(F.col("__hi") > F.col("__lo"), (F.col("__best") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.col("__best") - F.col("__lo"))
    return outcome.groupBy(*group, "policy").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("__recall").alias("top_recall"), F.stddev_pop("__recall").alias("top_recall_sd"), F.avg(norm).alias("best_norm"))


_LIMITED = 1000  # first rows of a cell up to which every task hands on only its own first ones


def _first(df: DataFrame, cell: Sequence[str], order, k: int) -> DataFrame:
    """The first ``k`` rows of each cell.  Of a small ``k`` tasks send only their own first rows, whatever the cell's size."""
    if k > _LIMITED:
        return numbered(df, cell, order, "__place", "auto").filter(F.col("__place") <= k).drop("__place")
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(*ordering(order)))
    return df.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def _estimates(seen: DataFrame, features, scores, key, cell, lam) -> DataFrame:
    """Per cell: elite AUROC of the leave-one-out ridge and of every score on what was measured."""
    sup = ln.supervised_metrics(seen, features, "__y", key, cell, lam).select(*cell, F.col("elite_auroc").alias("__sup"))
    long = ag.long_scores(seen, list(scores), [*cell, key, "__y"])
    per = ag.elite_metrics(long, "score", "__y", key, [*cell, "score_name"])
    best = per.filter("elite_auroc IS NOT NULL").groupBy(*cell).agg(
        F.min_by(F.struct("score_name", "elite_auroc"), F.struct(-F.col("elite_auroc"), F.col("score_name"))).alias("__b"))
    return attach(sup, best, cell, "left").select(*cell, "__sup", F.col("__b.score_name").alias("__best_score"), F.col("__b.elite_auroc").alias("__best"))


def _decision(n):
    from touchstone.plans.planner import MIN_FOR_TRUST, TIE_AUROC, TRUST_AUROC

    sup_ok = F.coalesce(F.col("__sup") >= TRUST_AUROC, F.lit(False))
    best_ok = F.coalesce(F.col("__best") >= TRUST_AUROC, F.lit(False))
    enough = n >= MIN_FOR_TRUST
    return (
        F.when(~enough, "explore").when(sup_ok & (~best_ok | (F.col("__sup") + TIE_AUROC >= F.col("__best"))), "supervised")
        .when(best_ok, F.col("__best_score")).otherwise("explore"))


def _facts(seen, features, scores, key, cell, lam, with_planner) -> DataFrame:
    """Per cell with picks: how many, their spread, the ridge on them and, for the planner, its estimates."""
    known = seen.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.stddev_pop("__y").alias("__sd"))
    fit = ln.solve(ln.gram(seen, list(features), ["__y"], cell), lam).select(*cell, "beta")
    out = attach(known, fit, cell, "left")
    if with_planner:
        out = attach(out, _estimates(seen.filter(F.col("policy") == "planner"), features, scores, key, cell, lam), cell, "left")
    return out


def _wanted(free, facts, features, scores, key, cell, round_no, beta, with_planner, with_ucb, held=lambda table: table):
    """Rows with the policy's value ``__want``, null where hashes ``__h`` decide, and whether the policy is ``__ready``."""
    out = attach(free, held(facts), cell, "left")
    out = out.withColumn("__p", F.round(ln.linear_prediction(list(features)), 9)).drop("beta")
    out = out.withColumn("__h", keyed_int(0, "seed", F.lit(round_no), key) / float(1 << 60))
    out = out.withColumn("__ready", F.coalesce((F.col("__n") >= 3) & (F.col("__sd") >= 1e-9), F.lit(False)))
    ready = F.col("__ready")
    want = F.when(ready, F.col("__p"))
    if with_ucb:
        tops = free.filter(F.col("policy") == "ucb").groupBy(*cell).agg(F.max("__novelty").alias("__top"))
        out = attach(out, held(tops), cell, "left")
        bonus = F.lit(beta) * F.col("__sd") * F.col("__novelty") / (F.col("__top") + 1e-9)
        want = F.when(ready & (F.col("policy") == "ucb"), F.round(F.col("__p") + bonus, 9)).otherwise(want)
    if with_planner:
        out = out.withColumn("__call", F.when(F.col("policy") == "planner", _decision(F.coalesce("__n", F.lit(0)))))
        chosen = F.lit(None).cast("double")
        for s in scores:
            chosen = F.when(F.col("__call") == s, F.col(s).cast("double")).otherwise(chosen)
        want = F.when(F.col("policy") == "planner", F.when(F.col("__call") == "supervised", F.col("__p")).otherwise(chosen)).otherwise(want)
    return out.withColumn("__want", want)


def _step(state, features, scores, key, cell, budget, round_no, lam, split):
    """The planner's state with the rows picked in this round marked."""
    facts = _facts(state.filter(F.col("round").isNotNull()), features, scores, key, cell, lam, True)
    out = _wanted(state, facts, features, scores, key, cell, round_no, 0.0, True, False)
    free = F.col("round").isNull().cast("int")
    # Unmeasured rows first, by the policy's value, then by hash (which decides where it has none).
    out = numbered(out.withColumn("__free", free), cell, [("__free", "desc"), ("__want", "desc"), "__h", key], "__rn", split)
    return out.withColumn("__take", F.col("round").isNull() & (F.col("__rn") <= budget))


def _batch(out, key, cell, budget, epsilon):
    """The rows each cell picks: its first ones by value, of which ``epsilon`` leaves a share to the hash."""
    order = [("__want", "desc"), "__h", key]
    extra = int(round(epsilon * budget))
    if not extra:
        return _first(out, cell, order, budget)
    # Its first rows by hash hold those that are picked by hash, however many of them the value picks.
    drawn = _first(out.filter(F.col("policy") == "epsilon"), cell, ["__h", key], budget)
    few = _first(out, cell, order, budget).union(drawn).dropDuplicates(["policy", "seed", "__id"])
    few = numbered(few, cell, order, "__rn", False)
    few = few.withColumn("__rest", F.when(F.col("__rn") > budget - extra, 1).otherwise(0))
    few = numbered(few, cell, [("__rest", "desc"), "__h", key], "__er", False)
    mixed = (F.col("__rest") == 0) | (F.col("__er") <= extra)
    return few.filter(F.when((F.col("policy") == "epsilon") & F.col("__ready"), mixed).otherwise(F.col("__rn") <= budget))


def _replay(rows, features, scores, key, cell, budget, rounds, lam, beta, epsilon, policies, held):
    """The picks of all rounds; ``held`` may broadcast what is known of cells and picks."""
    columns = rows.columns
    picks = rows.filter(F.lit(False))
    vector = F.array(*[F.col(f).cast("double") for f in features])
    apart = lambda v: sum((F.abs(F.get(v, F.lit(i)) - F.col(f).cast("double")) for i, f in enumerate(features)), F.lit(0.0))
    for r in range(rounds):
        free = rows
        novelty = F.lit(None).cast("double")
        if r:
            free = rows.join(held(picks.select("policy", "seed", "__id")), ["policy", "seed", "__id"], "left_anti")
            if "ucb" in policies:
                # At most ``budget`` vectors of a cell and round.
                old = picks.filter(F.col("policy") == "ucb").groupBy(*cell).agg(F.collect_set(vector).alias("__old"))
                free = attach(free, held(old), cell, "left")
                novelty = F.array_min(F.transform("__old", apart))
        facts = cut_lineage(_facts(picks, features, scores, key, cell, lam, "planner" in policies))
        out = _wanted(free.withColumn("__novelty", novelty).drop("__old"), facts, features, scores, key, cell, r, beta, "planner" in policies, r > 0 and "ucb" in policies, held)
        taken = cut_lineage(_batch(out, key, cell, budget, epsilon if "epsilon" in policies else 0.0).select(*columns))
        picks = picks.union(taken) if r else taken
    return picks


def decision_trace(
    df, features, target, scores, key, group: Sequence[str] = (), seeds=2, budget=12, rounds=3, lam=1.0, top_fraction=0.05,
) -> DataFrame:
    """Per (group, seed, round): the planner's call, what every action would have captured of the
    elite, the best action and the regret.  Exploring is credited with its expected value.
    """
    group = list(group)
    cell = [*group, "policy", "seed"]
    base = df.filter(finite(target)).withColumn("__y", F.col(target).cast("double"))
    base = top_flags(base, group, key, {"__elite": "__y"}, share(top_fraction), total_name="__pool")
    state = base.select(*group, key, "__y", "__elite", *dict.fromkeys([*features, *scores])).withColumn(
        "seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("policy", F.lit("planner")).withColumn("round", F.lit(None).cast("int"))
    columns = state.columns
    split = needs_split(base, group)
    traces = []
    for r in range(rounds):
        picked = cut_lineage(_step(state, features, scores, key, cell, budget, r, lam, split))
        pool = picked.filter(F.col("round").isNull())
        actions = {"supervised": F.col("__p"), **{s: F.col(s).cast("double") for s in scores}}
        long = pool.select(*cell, key, "__elite", F.explode(F.array(*[
            F.struct(F.lit(a).alias("action"), F.round(v, 9).alias("value")) for a, v in actions.items()])).alias("__a")).select(*cell, key, "__elite", "__a.*")
        placed = numbered(long.filter("value IS NOT NULL"), [*cell, "action"], [("value", "desc"), key], "__rn", split)
        got = placed.filter(F.col("__rn") <= budget).groupBy(*cell, "action").agg(F.sum(F.col("__elite").cast("double")).alias("captured"))
        chance = pool.groupBy(*cell).agg((F.lit(float(budget)) * F.avg(F.col("__elite").cast("double"))).alias("captured")).withColumn("action", F.lit("explore"))
        yields = got.unionByName(chance)
        called = picked.groupBy(*cell).agg(F.max("__call").alias("chosen"), F.max(F.coalesce("__n", F.lit(0))).alias("n_seen"))
        best = yields.groupBy(*cell).agg(F.min_by(F.struct("action", "captured"), F.struct(-F.col("captured"), F.col("action"))).alias("__best"))
        row = attach(attach(called, best, cell), yields.withColumnsRenamed({"action": "chosen", "captured": "got"}), [*cell, "chosen"], "left")
        traces.append(row.select(
            *group, "seed", F.lit(r).alias("round"), "n_seen", "chosen", F.col("__best.action").alias("best_action"), "got",
            F.col("__best.captured").alias("best_possible"), (F.col("__best.captured") - F.col("got")).alias("regret")))
        state = picked.withColumn("round", F.when(F.col("__take"), F.lit(r)).otherwise(F.col("round"))).select(*columns)
    return ag.union_all(traces)


def rule_compare(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often the rule picked a best action and its mean regret."""
    return trace.groupBy(*by).agg(
        F.count(F.lit(1)).alias("decisions"), F.avg((F.col("regret") <= 1e-12).cast("double")).alias("best_rate"), F.avg("regret").alias("mean_regret"),
        F.avg((F.col("chosen") == "explore").cast("double")).alias("explore_rate"))


def audit_fraction_yield(df, score: str, target: str, key: str, fractions: Sequence[float], group: Sequence[str] = (), seeds: int = 3, budget: int = 48, top_fraction=0.01, split="auto") -> DataFrame:
    """Elite rows per batch against random when a share f of the batch is picked at random.

    Per seed, ``budget`` hashed rows are set aside as measured; the rest is the pool.
    """
    group = list(group)
    base = df.filter(finite(target) & finite(score)).select(*group, key, F.col(target).cast("double").alias("__y"), F.col(score).cast("double").alias("__s"))
    base = top_flags(base, group, key, {"__elite": "__y"}, share(top_fraction), split, "__n")
    cell = [*group, "seed"]
    rows = base.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("__h", keyed_int(1, "seed", key))
    rows = numbered(rows, cell, ["__h", key], "__o", fanout=seeds).filter(F.col("__o") > budget)
    rows = numbered(rows, cell, [("__s", "desc"), key], "__rn", fanout=seeds).withColumn("__g", keyed_int(2, "seed", key))
    wide = rows.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("__x", half_even(F.col("fraction") * budget))
    wide = wide.withColumn("__rest", (F.col("__rn") > F.lit(budget) - F.col("__x")).cast("int"))
    wide = numbered(wide, [*cell, "fraction"], [("__rest", "desc"), "__g", key], "__er", fanout=seeds * len(list(fractions)))
    take = (F.col("__rest") == 0) | (F.col("__er") <= F.col("__x"))
    per = wide.groupBy(*cell, "fraction").agg(
        F.sum((take & F.col("__elite")).cast("int")).alias("__got"), (F.lit(float(budget)) * F.avg(F.col("__elite").cast("double"))).alias("__rand"))
    return per.groupBy(*group, "fraction").agg(F.avg("__got").alias("yield"), F.avg("__rand").alias("random"), F.avg(F.col("__got") - F.col("__rand")).alias("advantage"))


def ranker_yield(df, scores: Sequence[str], features: Sequence[str], target: str, key: str, study: str, seeds: int = 5, elite_fraction=0.20, take_fraction=0.25, lam=1.0, replicates=200) -> DataFrame:
    """Per ranker: elite rows among the top quarter of the unmeasured half above random expectation,
    averaged over seeds and studies, with a study bootstrap interval.

    The rankers are the given scores, a ridge on the measured half, and a random order.
    """
    from touchstone.operators.resample import bootstrap_mean

    base = df.filter(finite(target)).withColumn("__y", F.col(target).cast("double"))
    base = top_flags(base, [study], key, {"__elite": "__y"}, share(elite_fraction), total_name="__n")
    cell = [study, "seed"]
    rows = base.select(study, key, "__y", "__elite", "__n", *dict.fromkeys([*scores, *features])).withColumn(
        "seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("__h", keyed_int(3, "seed", key))
    rows = numbered(rows, cell, ["__h", key], "__o", fanout=seeds).withColumn("__seen", F.col("__o") <= F.floor(F.col("__n") / 2))
    fit = ln.solve(ln.gram(rows.filter("__seen"), list(features), ["__y"], cell), lam).select(*cell, "beta")
    pool = attach(rows.filter("NOT __seen"), fit, cell)
    rankers = {"own_ridge": F.round(ln.linear_prediction(list(features)), 9), "random": (keyed_int(4, "seed", key) / float(1 << 60)), **{s: F.col(s).cast("double") for s in scores}}
    long = pool.select(*cell, key, "__elite", F.explode(F.array(*[F.struct(F.lit(n).alias("ranker"), v.alias("v")) for n, v in rankers.items()])).alias("__r")).select(*cell, key, "__elite", "__r.*")
    by = [*cell, "ranker"]
    placed = numbered(long, by, [("v", "desc"), key], "__rn", fanout=seeds * len(rankers))
    placed = with_group_totals(placed, by, {"__m": F.count(F.lit(1)), "__e": F.sum(F.col("__elite").cast("int"))})
    batch = F.greatest(F.lit(2), half_even(F.lit(take_fraction) * F.col("__m")))
    adv = placed.groupBy(*by).agg(
        (F.sum((F.col("__elite") & (F.col("__rn") <= batch)).cast("int")) - F.max(batch * F.col("__e") / F.col("__m"))).alias("__adv"), F.max("__e").alias("__e"))
    per = adv.filter(F.col("__e") > 0).groupBy(study, "ranker").agg(F.avg("__adv").alias("advantage"))
    return bootstrap_mean(per, "advantage", study, ["ranker"], replicates, 5)



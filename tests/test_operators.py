"""Unit cases, brute force on small fixtures, and properties."""

import math
import random
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchstone.functions import edits as ed
from touchstone.functions import numeric as nu
from touchstone.functions import tails
from touchstone.functions import text as tx
from touchstone.operators import agreement as ag
from touchstone.operators import contrasts as co
from touchstone.operators import graph as gp
from touchstone.operators import groups as gr
from touchstone.operators import hypothesis as hy
from touchstone.operators import linear as ln
from touchstone.operators import operating as op
from touchstone.operators import perturb as pt
from touchstone.operators import ranks
from touchstone.operators import sequences as sq
from touchstone.operators import spectra as sp
from touchstone.operators import vectors as ve
from touchstone.operators.running import Total, running
from touchstone.plans import selection as se


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute_ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, with ties, nulls, NaN and infinities."""
    rng = random.Random(3)
    rows = [(i, "big" if i % 10 else f"g{i % 3}", float(rng.randint(0, 9)), rng.random(), int(rng.random() < 0.4)) for i in range(160)]
    rows += [(900, "big", float("nan"), 0.1, 1), (901, "big", None, 0.2, 0), (902, "big", float("inf"), 0.3, 1)]
    return spark.createDataFrame(rows, "k long, g string, x double, y double, label int").repartition(5)


def table(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def test_ranks_and_rank_sum(spark, skewed):
    out = ranks.average_ranks(skewed.filter(nu.finite("x")), ["g"], ["x"]).toPandas()
    for _, part in out.groupby("g"):
        assert list(part.rank_x) == brute_ranks(list(part.x))
        assert part.rank_x.sum() == len(part) * (len(part) + 1) / 2


@pytest.mark.parametrize("op_name", ["spearman", "auc", "elite", "quantiles", "points", "partial", "bh", "geometry", "wilcoxon", "risk", "topk", "ndcg", "runs"])
def test_split_path_agrees(spark, skewed, op_name):
    """Operators answer alike whether a group is one task or range-partitioned over many."""
    from touchstone.settings import SMALL_BYTES, SPLIT_ROWS

    calls = {
        "spearman": lambda: ag.spearman(skewed, "x", "y", ["g"]),
        "auc": lambda: ag.roc_auc(skewed, "x", "label", ["g"]),
        "elite": lambda: ag.elite_metrics(skewed, "x", "y", "k", ["g"]),
        "quantiles": lambda: ranks.group_quantiles(skewed.filter(nu.finite("x")), ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.97}),
        "points": lambda: op.operating_points(skewed, "x", "label", [0.3, 0.001], ["g"]),
        "partial": lambda: ag.partial_rank(skewed, "x", "y", "label", ["g"]),
        "bh": lambda: hy.adjust_pvalues(skewed, "y", ["k"], ["g"]).select("g", "k", "y_fdr", "y_bonf"),
        "geometry": lambda: gr.score_geometry(skewed, "x", ["g"], 5),
        "wilcoxon": lambda: hy.wilcoxon_signed(skewed.withColumn("d", F.col("x") - 4.5), "d", ["g"]),
        "risk": lambda: op.risk_coverage(skewed, "x", "y", "k", [1.0, 0.5], ["g"]),
        "topk": lambda: ag.topk_utility(skewed, "x", "y", "k", ["g"]),
        "ndcg": lambda: ag.ndcg_at_k(skewed, "x", "y", "k", 7, ["g"]),
        "runs": lambda: op.longest_miss_run(skewed, "x", "label", ["k"], 0.3, ["g"]),
    }
    keys = {"points": ["g", "fpr_budget"], "bh": ["g", "k"], "risk": ["g", "coverage"]}.get(op_name, ["g"])
    plain = table(calls[op_name](), *keys)
    spark.conf.set(SMALL_BYTES, "0")
    spark.conf.set(SPLIT_ROWS, "3")
    try:
        halved = table(calls[op_name](), *keys)
    finally:
        spark.conf.unset(SMALL_BYTES)
        spark.conf.unset(SPLIT_ROWS)
    pd.testing.assert_frame_equal(plain, halved, rtol=1e-9, check_dtype=False)


def test_running_min_max_split(spark, split):
    rows = frame(spark, [(g, i, float((i * 7) % 11)) for g in ("a", "b") for i in range(40)], "g string, i int, v double")
    out = running(rows, ["g"], ["i"], [Total("lo", "v", "min"), Total("hi", "v", "max", inclusive=True), Total("s", "v")]).toPandas()
    for _, part in out.groupby("g"):
        part = part.sort_values("i")
        v = list(part.v)
        assert list(part.hi) == [max(v[: i + 1]) for i in range(len(v))]
        assert part.lo.isna().iloc[0] and list(part.lo)[1:] == [min(v[:i]) for i in range(1, len(v))]
        assert list(part.s)[1:] == [sum(v[:i]) for i in range(1, len(v))]


def test_auc_symmetry_and_monotone_invariance(spark, skewed):
    base = skewed.filter(nu.finite("x"))
    one = table(ag.roc_auc(base, "x", "label", ["g"]), "g").auc
    flipped = table(ag.roc_auc(base.withColumn("x", -F.col("x")), "x", "label", ["g"]), "g").auc
    cubed = table(ag.roc_auc(base.withColumn("x", F.pow("x", 3)), "x", "label", ["g"]), "g").auc
    assert np.allclose(one + flipped, 1) and np.allclose(one, cubed)
    for parts in (1, 7, 40):
        assert np.allclose(one, table(ag.roc_auc(base.repartition(parts), "x", "label", ["g"]), "g").auc)


def test_degenerate_inputs_are_null(spark):
    flat = frame(spark, [(i, 1.0, float(i), 1) for i in range(30)], "k int, x double, y double, label int")
    assert ag.spearman(flat, "x", "y").first().rho is None
    assert ag.roc_auc(flat, "x", "label").first().auc is None
    row = ag.elite_metrics(flat, "x", "y", "k").first()
    assert row.elite_auroc is None and row.enrichment is None
    assert ag.spearman(flat.limit(4), "y", "y").first().rho is None


def test_elite_only_scorer(spark):
    """A score that only finds the top: low rank correlation, high enrichment."""
    rng = np.random.default_rng(0)
    y = rng.normal(size=200)
    s = rng.normal(size=200)
    top = np.argsort(-y)[:20]
    s[top] = 5 + rng.normal(size=20)
    df = frame(spark, [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(s, y))], "k int, s double, y double")
    row = ag.elite_metrics(df, "s", "y", "k").first()
    assert row.enrichment > 3 and abs(ag.spearman(df, "s", "y").first().rho) < 0.5


def test_operating_point_zero_budget(spark):
    df = frame(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, label int")
    row = op.operating_points(df, "s", "label", [0.1]).first()
    assert row.above_max and row.threshold == 0.8 and row.tpr == 0.5 and row.realised_fpr == 0.0 and not row.estimable


def test_permuted_labels_land_at_the_nominal_rate(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), nu.keyed_unit(1, "id").alias("s"), (nu.keyed_unit(2, "id") < 0.5).cast("int").alias("label"))
    row = op.operating_points(df, "s", "label", [0.1]).first()
    assert abs(row.tpr - 0.1) < 0.03


def test_objective_cases(spark):
    df = frame(spark, [(0.9, 0.8, 0.1)], "a double, b double, c double")
    got = df.select(nu.objective("margin", "a", ["b", "c"]).alias("m"), nu.objective("gated", "a", ["b", "c"]).alias("g"), nu.objective("lagrangian", "a", ["b"]).alias("l")).first()
    assert got.m == pytest.approx(0.1) and got.g == -1.0 and got.l < 0
    with pytest.raises(ValueError):
        nu.objective("nothing", "a", ["b"])


def test_golden_pooled_summary(spark):
    """n-weighted mean, median, sign count and exact p of a hand-computed set of studies."""
    rows = frame(spark, [("s", 10, 0.5), ("s", 20, -0.1), ("s", 30, 0.2), ("s", 40, None)], "score_name string, n int, rho double")
    row = ag.pooled_summary(rows).first()
    assert row.studies == 3 and row.studies_positive == 2
    assert row.weighted_mean_rho == pytest.approx((5 - 2 + 6) / 60) and row.median_rho == pytest.approx(0.2) and row.sign_test_p == pytest.approx(1.0)


def test_tails_known_values():
    assert tails.t_two_sided_np(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.binom_two_sided_np(np.array([8.0]), np.array([10.0]))[0] == pytest.approx(2 * sum(math.comb(10, i) for i in range(3)) / 1024)
    got = tails.fisher_two_sided_np([8], [2], [1], [5])[0]
    assert got == pytest.approx(0.0349650349, abs=1e-9)


def test_t_critical_and_sql_functions(spark):
    df = frame(spark, [(1,), (2,), (9,), (23,)], "v int")
    got = [r[0] for r in df.select(nu.t_critical("v")).collect()]
    assert got == pytest.approx([12.706204736, 4.302652730, 2.262157163, 2.068657610], abs=1e-7)
    nu.register_sql_functions(spark)
    row = spark.sql("select binom_two_sided(8, 10) as p, t_crit(23D) as t, enrichment(3D, 5D, 50D) as e").first()
    assert row.p == pytest.approx(0.109375) and row.t == pytest.approx(2.068657610, abs=1e-7) and row.e == pytest.approx(6.0)


def test_inverse_normal(spark):
    from statistics import NormalDist

    ps = [0.001, 0.02, 0.3, 0.5, 0.77, 0.99]
    got = [r[0] for r in frame(spark, [(p,) for p in ps], "p double").select(nu.inverse_normal("p")).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-6)


def test_wilcoxon_exact_by_enumeration(spark):
    d = [0.3, -1.1, 2.2, 0.9, -0.4, 1.7]
    row = hy.wilcoxon_signed(frame(spark, [(v,) for v in d], "d double"), "d", method="exact").first()
    r = brute_ranks([abs(v) for v in d])
    low = min(sum(x for x, v in zip(r, d) if v > 0), sum(x for x, v in zip(r, d) if v < 0))
    all_sums = [sum(x for x, s in zip(r, signs) if s) for signs in product((0, 1), repeat=len(d))]
    assert row.p == pytest.approx(min(1.0, 2 * sum(s <= low for s in all_sums) / len(all_sums)))


def test_loo_ridge_equals_refits(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(25, 3)), rng.normal(size=25)
    df = frame(spark, [(i, *map(float, x[i]), float(y[i])) for i in range(25)], "k int, a double, b double, c double, y double")
    got = table(ln.loo_ridge(df, ["a", "b", "c"], "y", lam=2.0), "k").loo
    for i in range(25):
        keep = np.arange(25) != i
        xb = np.column_stack([np.ones(24), x[keep]])
        w = np.linalg.solve(xb.T @ xb + 2.0 * np.diag([0, 1, 1, 1]), xb.T @ y[keep])
        assert got[i] == pytest.approx(w[0] + x[i] @ w[1:])


def test_wide_gram_equals_narrow(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=60)
    df = frame(spark, [(i % 3, [float(v) for v in x[i]], float(y[i])) for i in range(60)], "g int, v array<double>, y double")
    flat = df.select("g", "y", *[F.get("v", F.lit(i)).alias(f"f{i}") for i in range(4)])
    a = table(ln.gram(flat, [f"f{i}" for i in range(4)], ["y"], ["g"]), "g")
    b = table(ln.gram(df, "v", ["y"], ["g"], size=4), "g")
    for c in ("xtx", "xty", "yty"):
        assert np.allclose(np.vstack(a[c]), np.vstack(b[c]))
    with pytest.raises(ValueError):
        ln.gram(df, "v", ["y"], size=ln.MAX_FEATURES + 1)


def test_nnls_conditions():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.random((30, 6)), rng.normal(size=30)
        x = sp.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-8).all() and np.allclose(slope[x > 1e-10], 0, atol=1e-8)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(55)] + [(500, i) for i in range(501, 540)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = frame(spark, [(v,) for v in [*parent, 999]], "node int")
    got = {r.node: r.component for r in gp.connected_components(frame(spark, edges, "src int, dst int"), nodes=nodes).collect()}
    assert got == {**{v: root(v) for v in parent}, 999: 999}


def test_top_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(37, 5)), rng.normal(size=(53, 5))
    left = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(a)], "i int, v array<double>")
    right = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(b)], "j int, w array<double>")
    for metric, fn in (("l1", lambda x, y: -np.abs(x - y).sum()), ("l2", lambda x, y: -np.linalg.norm(x - y))):
        got = table(ve.top_matches(left, "i", "v", right, "j", "w", 3, metric, block_rows=10), "i", "place")
        for i in range(37):
            order = sorted(range(53), key=lambda j: (-fn(a[i], b[j]), j))[:3]
            assert list(got[got.i == i].match_j) == order


def test_farthest_points_brute_force(spark):
    pts = [(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [0.0, 9.0]), (3, [1.0, 1.0]), (4, [9.0, 9.0])]
    got = table(ve.farthest_points(frame(spark, pts, "k int, v array<double>"), "k", "v", 5, cut_every=2), "pick")
    chosen, coords = [int(got.k[0])], dict(pts)
    while len(chosen) < 5:
        rest = [k for k in coords if k not in chosen]
        chosen.append(max(rest, key=lambda k: (min(sum(abs(p - q) for p, q in zip(coords[k], coords[c])) for c in chosen), -k)))
    assert list(got.k) == chosen


def test_runs_brute_force(spark):
    texts = ["", "aab", "abc", "zzzz\n\n", "éééa", "x" * 50]
    df = frame(spark, [(t,) for t in texts], "t string")

    def longest(t):
        best = run = 0
        for i, c in enumerate(t):
            run = run + 1 if i and t[i - 1] == c else 1
            best = max(best, run)
        return best

    rows = df.select("t", tx.longest_run("t").alias("r"), tx.is_degenerate("t").alias("d")).collect()
    for row in rows:
        assert row.r == longest(row.t) and row.d == (not row.t or longest(row.t) / len(row.t) > 0.3)


def test_parse_variant_cases(spark):
    df = frame(spark, [("S214H/I168R",), ("WT",), ("S214H;bad",), (None,), ("s1a+D2*",)], "v string")
    got = [None if r[0] is None else [(e.wt, e.pos, e.mut) for e in r[0]] for r in df.select(ed.parse_edits("v")).collect()]
    assert got == [[("S", 214, "H"), ("I", 168, "R")], [], None, [], [("S", 1, "A"), ("D", 2, "*")]]


def test_edits_round_trip(spark):
    df = frame(spark, [("ACDEF", "A1G/E4K"), ("ACDEF", "A2G")], "ref string, v string").withColumn("e", ed.parse_edits("v"))
    df = df.withColumn("out", ed.apply_edits("ref", "e"))
    rows = df.select("out", ed.agrees("ref", "e").alias("ok"), ed.revert_edit("out", "e").alias("back"), F.size(ed.difference_edits("ref", "out")).alias("n")).collect()
    assert (rows[0].out, rows[0].ok, rows[0].back, rows[0].n) == ("GCDKF", True, "ACDEF", 2)
    assert rows[1].out is None and not rows[1].ok


@pytest.fixture(scope="module")
def coding(spark):
    rng = random.Random(7)
    return spark.createDataFrame([(f"s{i}", "".join(rng.choice("ACGT") for _ in range(300))) for i in range(6)], "key string, text string")


def test_perturbations_keep_what_they_declare(spark, coding):
    made = pt.perturb(coding, "key", "text", list(pt.REGISTRY), seed=3, keep=["text"]).collect()
    for row in made:
        for name in pt.REGISTRY[row.perturbation].keeps:
            assert pt.INVARIANTS[name](row.text, row.perturbed), (row.perturbation, name)
        assert row.text != row.perturbed
        broken = [name for name, holds in pt.INVARIANTS.items() if not holds(row.text, row.perturbed)]
        assert broken or row.perturbation == "stop out of frame", row.perturbation
        if row.perturbation == "stop in frame":
            assert not pt.INVARIANTS["stops"](row.text, row.perturbed) or "*" in pt._translated(row.text)
    twice = coding.select(tx.reverse_complement(tx.reverse_complement("text")).alias("t"), "text").collect()
    assert all(r.t == r.text for r in twice)


def test_draws_depend_on_key_only(spark, coding):
    names = ["mononucleotide shuffle", "dinucleotide shuffle"]
    a = {(r.key, r.perturbation): r.perturbed for r in pt.perturb(coding, "key", "text", names, 1).collect()}
    b = {(r.key, r.perturbation): r.perturbed for r in pt.perturb(coding.repartition(5).filter("key <> 's0'"), "key", "text", names, 1).collect()}
    c = {(r.key, r.perturbation): r.perturbed for r in pt.perturb(coding, "key", "text", names, 2).collect()}
    assert all(a[k] == v for k, v in b.items()) and a != c


def test_order_one_model_is_blind_to_pair_shuffle(spark, coding):
    """Known answer: a first-order chain fitted on each text cannot see what keeps its pairs."""
    real = sq.markov_scores(coding, "key", "text", 1, fit="self")
    shuffled = pt.perturb(coding, "key", "text", ["dinucleotide shuffle"]).select("key", F.col("perturbed").alias("text"))
    other = sq.markov_scores(shuffled, "key", "text", 1, fit="self")
    gap = real.join(other.withColumnRenamed("score", "s2"), "key").agg(F.max(F.abs(F.col("score") - F.col("s2")))).first()[0]
    assert gap < 1e-9


def test_battery_verdicts(spark):
    rows = [(f"u{i}", n, v + 0.01 * (i % 5)) for i in range(20) for n, v in (("ref", 1.0), ("strong", 0.5), ("none", -0.02), ("inverse", -0.6))]
    deltas = frame(spark, rows, "key string, perturbation string, delta double")
    expect = frame(spark, [("ref", "real_higher"), ("strong", "real_higher"), ("none", "no_preference"), ("inverse", "real_higher")], "perturbation string, expect string")
    got = {r.perturbation: r.verdict for r in co.contrast_battery(deltas, expect, "ref").collect()}
    assert got == {"ref": "REPRESENTS", "strong": "REPRESENTS", "none": "INVARIANT", "inverse": "INVERTED"}
    with pytest.raises(ValueError):
        pt.Rewrite("bad", None, frozenset({"length"}), "length")


def test_auc_permutation_exact(spark):
    from touchstone.operators.resample import auc_permutation

    s, y = [0.1, 0.4, 0.35, 0.8, 0.7, 0.2], [0, 0, 1, 1, 1, 0]
    df = frame(spark, [(i, s[i], y[i]) for i in range(6)], "k int, s double, y int")
    row = auc_permutation(df, "s", "y", "k", method="exact").first()
    r = brute_ranks(s)
    seen = sum(r[i] for i in range(6) if y[i])
    sums = [sum(r[i] for i in c) for c in combinations(range(6), 3)]
    assert row.method == "exact" and row.p == pytest.approx(sum(v >= seen for v in sums) / len(sums))


def test_copies_of_one_text_stay_whole(spark):
    """A text that is a third of the table: counted in full, one row per task."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"))
    out = gr.dedup_units(df, "id", gr.content_key("t"))
    assert out.agg(F.sum("copies")).first()[0] == 3000 and out.filter("copies > 1").first().copies == 1000


def test_signature_recovers_mixture(spark):
    from touchstone.functions.tables import context_grid

    grid = [r[0] for r in context_grid(spark).collect()]
    assert len(grid) == len(set(grid)) == 96
    rng = np.random.default_rng(8)
    prof = rng.random((96, 3))
    prof /= prof.sum(0)
    profiles = frame(spark, [(f"p{j}", c, float(prof[i, j])) for i, c in enumerate(grid) for j in range(3)], "profile string, context string, share double")
    mix = prof @ np.array([0.2, 0.0, 0.8]) * 1e6
    spectra = frame(spark, [("g", c, float(mix[i])) for i, c in enumerate(grid)], "g string, context string, n double")
    got = {r.profile: r.exposure for r in sp.signature_exposure(spectra, profiles, ["g"], "profile").collect()}
    assert got["p0"] == pytest.approx(0.2, abs=1e-6) and got["p1"] == pytest.approx(0, abs=1e-6) and got["p2"] == pytest.approx(0.8, abs=1e-6)


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_ridge_keeps_its_digits_at_large_offsets(spark, offset):
    rows = [(i, offset + i, 2.0 * i + i % 3, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double, y double, fold int")
    near = spark.createDataFrame([(k, x - offset, y, f) for k, x, y, f in rows], "k int, x double, y double, fold int")

    def by_key(out, column):
        return [r[column] for r in out.orderBy("k").collect()]

    for run, column in ((lambda d: ln.loo_ridge(d, ["x"], "y"), "loo"), (lambda d: ln.out_of_fold(d, ["x"], "y", "fold", standardise=True), "oof"),
                        (lambda d: ln.ridge_by_group(d, ["x"], "y"), "prediction")):
        assert by_key(run(df), column) == pytest.approx(by_key(run(near), column), abs=1e-6)


def test_linear_keeps_the_callers_columns(spark):
    """Working names never collide with columns of the input, whatever they are called."""
    rows = [(i, float(i % 5), 3.0 * (i % 5) + i % 3, "kept") for i in range(12)]
    df = spark.createDataFrame(rows, "k int, __x1 double, __y1 double, beta string")
    loo = ln.loo_ridge(df, ["__x1"], "__y1", lam=0.5)
    assert loo.columns == ["k", "__x1", "__y1", "beta", "loo"]
    plain = ln.loo_ridge(df.toDF("k", "x", "y", "b"), ["x"], "y", lam=0.5)
    assert [round(r["loo"], 9) for r in loo.orderBy("k").collect()] == [round(r["loo"], 9) for r in plain.orderBy("k").collect()]
    fitted = ln.ridge_by_group(df, ["__x1"], "__y1", [])
    assert fitted.columns == ["k", "__x1", "__y1", "beta", "prediction"]
    held = ln.out_of_fold(df.withColumn("f", F.col("k") % 3), ["__x1"], "__y1", "f")
    assert held.columns == ["k", "__x1", "__y1", "beta", "f", "oof"]


def test_array_features_keep_their_digits_at_a_large_offset(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=60) * 0.1

    def fit(offset):
        df = spark.createDataFrame([(i, [float(v) + offset for v in x[i]], float(y[i])) for i in range(60)], "k int, v array<double>, y double")
        return np.array([r["loo"] for r in ln.loo_ridge(df, "v", "y", lam=0.1).orderBy("k").collect()])

    assert np.allclose(fit(0.0), fit(1e9), atol=1e-5)


def test_cross_map_and_within_background_at_a_large_offset(spark):
    rows = [(f"{a}{b}", float(i), (3.0 * i) % 7, (5.0 * i) % 11) for i, (a, b) in enumerate((a, b) for a in "ABCDEFGH" for b in "ABCDEFGH")]
    near = spark.createDataFrame(rows, "t string, x double, y double, z double")
    far = near.withColumn("x", F.col("x") + 1e9).withColumn("z", F.col("z") + 1e9)
    train = F.col("y") < 5
    one, two = (ln.cross_map_r2(d, ["x"], ["y", "z"], train).orderBy("target").collect() for d in (near, far))
    assert all(abs(a["r2"] - b["r2"]) < 1e-6 for a, b in zip(one, two))
    one, two = (ln.within_background(d, "t", "t", ["x"], "z", "ABCDEFGH", 2, 1.0, min_train=5).first() for d in (near, far))
    assert one["backgrounds"] == two["backgrounds"] > 0 and abs(one["weighted_rho"] - two["weighted_rho"]) < 1e-9


def test_wilcoxon_exact_with_ties_and_refusal(spark):
    rng = random.Random(2)
    for _ in range(30):
        d = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(1, 9))]
        doubled = [int(2 * r) for r in brute_ranks([abs(v) for v in d])]
        low = min(sum(x for x, v in zip(doubled, d) if v > 0), sum(x for x, v in zip(doubled, d) if v < 0))
        sums = [sum(x for x, s in zip(doubled, signs) if s) for signs in product((0, 1), repeat=len(d))]
        ranks_ = sorted(set(doubled))
        got = hy.signed_rank_tail(ranks_, [doubled.count(r) for r in ranks_], low)
        assert got == pytest.approx(min(1.0, 2 * sum(s <= low for s in sums) / len(sums)))
    many = spark.range(30).selectExpr("cast(id - 7.5 as double) as d")
    assert hy.wilcoxon_signed(many, "d", method="exact").first().method == "exact"
    with pytest.raises(Exception, match="no exact null"):
        hy.wilcoxon_signed(many, "d", method="exact", most=20).collect()


@pytest.mark.parametrize("threshold,block", [(0.7, 1024), (0.5, 3), (0.9, 4), (1.0, 5), (0.0, 4)])
def test_identity_clusters_are_exact(spark, threshold, block):
    """Components of all pairs, for segments that few or most strings share, in blocks of any size."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 3, 7, 10, 10, 10, 23) for _ in range(12)]
    texts += ["é" + t[1:] for t in texts[:20]] + [t[:-1] + "b" for t in texts[-30:]] + ["", "abcabcabcX", "abcabcabcY"]
    got = {}
    for r in gp.identity_clusters(frame(spark, list(enumerate(texts)), "k int, t string"), "k", "t", threshold, block).collect():
        got.setdefault(r["component"], set()).add(texts[r["k"]])
    distinct = sorted(set(texts))
    parent = {t: t for t in distinct}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in combinations(distinct, 2):
        if a and len(a) == len(b) and sum(x == y for x, y in zip(a, b)) / len(a) >= threshold - 1e-12:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {}
    for t in distinct:
        want.setdefault(root(t), set()).add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_condition_number_of_many_profiles(spark):
    rng = np.random.default_rng(8)
    for count in (500, 7):
        m = rng.random((count, 12)) + np.eye(12)[np.arange(count) % 12]
        rows = [(f"p{i}", f"c{j:02d}", float(m[i, j])) for i in range(count) for j in range(12)]
        df = frame(spark, rows, "profile string, context string, share double")
        got = sp.profile_collinearity(df, "profile", "context", "share").first()
        assert got["condition_number"] == pytest.approx(np.linalg.cond(m), rel=1e-7)
        assert got["pairs"] == count * (count - 1) // 2
    twice = frame(spark, [(p, c, v) for p in "ab" for c, v in (("x", 1.0), ("y", 2.0), ("z", 0.0))], "profile string, context string, share double")
    assert sp.profile_collinearity(twice, "profile", "context", "share").first()["condition_number"] is None


def test_tails_without_trials_or_degrees_of_freedom():
    """No trial (every pair tied) has p = 1 beside rows that have some; no degree of freedom has no quantile."""
    assert tails.binom_two_sided_np([0, 1, 0], [0, 2, 3]).tolist() == pytest.approx([1.0, 1.0, 0.25])
    assert np.isnan(tails.t_quantile_np(0.975, [0.0, 5.0])).tolist() == [True, False]
    assert np.isnan(tails.t_two_sided_np([1.0], [0.0])).all()


@pytest.mark.parametrize("features", [["a"], ["a", "b"]])
def test_novelties_brute_force(spark, features, monkeypatch):
    """Distance to the nearest measured row of the own group; a group without one has no novelty."""
    if len(features) == 1:  # one feature needs no pairs of rows
        monkeypatch.setattr(se, "top_matches", None)
    rng = random.Random(4)
    rows = [(rng.choice("uvw"), i, rng.randrange(-9, 9) / 2, float(rng.randrange(4)), rng.random() if rng.random() < 0.4 else None) for i in range(200)]
    rows = [(g, i, a, b, None if g == "w" else y) for g, i, a, b, y in rows] + [("u", 900, None, 1.0, None), (None, 901, 1.0, 1.0, None), (None, 902, 4.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, a double, b double, y double")
    got = {tuple(r[c] for c in ["g", *features]): r["novelty"] for r in se.novelties(df, features, "y", "k", ["g"]).collect()}
    want = {}
    cut = lambda r: tuple(r[2:2 + len(features)])
    for r in rows:
        near = [sum(abs(x - z) for x, z in zip(cut(r), cut(m))) for m in rows if m[0] == r[0] and m[4] is not None] if None not in cut(r) else []
        if r[4] is None and near:
            want[(r[0], *cut(r))] = min(near)
    assert got == want


def test_top_matches_broadcasts_no_blocks(spark):
    """Packed blocks look small to Spark, so the block join and that of the labels are named merges."""
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(40)], "i int, v array<double>, label int")
    near = ve.knn_vote(df.filter("i % 5 > 0"), df.filter("i % 5 = 0"), "i", "v", "label", 3, block_rows=8)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2 and near.count() > 0


def test_letter_vectors_by_place_and_substitutions_by_once_cut_letters(spark):
    """Cells come from one look-up a place; both texts of a pair are split once, not once a letter."""
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(1, "ab?"), (2, None), (3, ""), (4, "cABa")], "k int, t string")
    out = sq.letter_vectors(df, "k", "t", alphabet="abc")
    got = {r["k"]: r["v"] for r in out.select("k", vector_to_array("features").alias("v")).collect()}
    assert got == {k: [float(c == a) for c in (t or "").ljust(4, "#") for a in "abc"] for k, t in [(1, "ab?"), (2, None), (3, ""), (4, "cABa")]}
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
    pairs = spark.createDataFrame([("ACGTA", "AGGTC"), ("AC", "AG"), ("ACG", "ACGT"), ("ANGTA", "AGGCA")], "a string, b string")
    found = pairs.select("a", tx.substitutions("a", "b").alias("s"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    # Only the second letter of the first pair differs between plain neighbours.
    assert {r["a"]: r["s"] for r in found.collect()} == {"ACGTA": ["A[C>G]G"], "AC": [], "ACG": [], "ANGTA": ["G[T>C]A"]}


def test_group_quantiles_hold_values_once(spark):
    """All quantiles of a group come from one buffer; a group without values has none."""
    df = spark.createDataFrame([("a", float(i * 7 % 11)) for i in range(11)] + [("b", None)], "g string, x double")
    out = ranks.group_quantiles(df, ["g"], "x", {"lo": 0, "mid": 0.5, "hi": 0.95})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == 1
    assert {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in out.collect()} == {"a": (0.0, 5.0, 9.5), "b": (None, None, None)}


def test_ranks_by_stretch_sort_only_between_bounds(spark, split):
    """Large groups are cut at values: ties need no sort, no group is one task, and levels are ranked on the way."""
    spark.conf.set("spark.touchstone.groupSplitRows", "800")  # 50 rows in a stretch
    rng = random.Random(5)
    rows = [("big" if i % 8 else f"s{i % 16}", i % 3, float(rng.randint(0, 4)), rng.choice([None, rng.random(), 0.5])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, z int, few double, many double").repartition(3)
    out = ranks.average_ranks(df, ["g"], ["few", "many"], "r_", within=["z"], inner="i_")
    assert "Window" not in ranks.average_ranks(df.filter("g = 'big'"), ["g"], ["few"])._jdf.queryExecution().optimizedPlan().toString().replace("WindowGroup", "").split("Join")[0]
    got = out.toPandas()
    assert len(got) == len(rows)
    for by, name in ((["g"], "r_"), (["g", "z"], "i_")):
        for _, part in got.groupby(by):
            assert list(part[f"{name}few"]) == brute_ranks(list(part.few))
            some = part[part.many.notna()]
            assert list(some[f"{name}many"]) == brute_ranks(list(some.many)) and part[part.many.isna()][f"{name}many"].isna().all()

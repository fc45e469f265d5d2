"""Replicate weights inside tasks against plain loops."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchstone.operators import contrasts as co
from touchstone.operators import resample as rs
from touchstone.operators import weights as wt


def plain_weight(seed, b, *keys):
    a, c = wt._keyed(seed, "a", b) % (wt.PRIME - 1) + 1, wt._keyed(seed, "c", b) % wt.PRIME
    v = (a * (wt._keyed(seed, *keys) % wt.PRIME) + c) % wt.PRIME >> 11
    return sum(v >= cut for cut in wt.poisson_cuts())


def test_weights_are_poisson():
    seen = Counter(plain_weight(3, b, k) for b in range(40) for k in range(500))
    for k in range(4):
        assert abs(seen[k] / 20_000 - math.exp(-1) / math.factorial(k)) < 0.012
    per_row = [sum(plain_weight(3, b, k) for b in range(40)) for k in range(500)]
    per_replicate = [sum(plain_weight(3, b, k) for k in range(500)) for b in range(40)]
    assert 0.7 < np.var(per_row) / 40 < 1.3 and 0.5 < np.var(per_replicate) / 500 < 1.6


@pytest.fixture()
def rows(spark):
    rng = np.random.default_rng(2)
    data = [(["a", "b", None][i % 3], i, float(rng.integers(0, 12)), int(rng.random() < 0.4), float(rng.normal())) for i in range(240)]
    return data, spark.createDataFrame(data, "g string, k int, s double, y int, x double").repartition(5)


def test_weighted_sums_by_group(rows):
    data, df = rows
    out = wt.weighted_sums(df, "k", {"sx": F.col("x"), "n": F.lit(1)}, ["g"], 15, 7).collect()
    assert len(out) == 45
    for r in out:
        mine = [(plain_weight(7, r["replicate"], k), x) for g, k, _, _, x in data if g == r["g"]]
        assert r["n"] == sum(w for w, _ in mine) and abs(r["sx"] - sum(w * x for w, x in mine)) < 1e-9


def plain_auc(weighted):
    won = sum(wp * wq * (1.0 if p > q else 0.5 if p == q else 0.0) for p, y, wp in weighted if y for q, z, wq in weighted if not z)
    below = sum(w for _, y, w in weighted if y) * sum(w for _, y, w in weighted if not y)
    return won / below if below else None


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_weighted_auc_with_ties_over_blocks_and_partitions(spark, rows, monkeypatch, cells):
    data, df = rows
    monkeypatch.setattr(wt, "_CELLS", cells)
    pos, neg = F.col("y").cast("double"), 1.0 - F.col("y")
    out = wt.weighted_auc(df, "s", pos, neg, ["g"], 6, 1, "k").collect()
    assert len(out) == 18
    for r in out:
        want = plain_auc([(s, y, plain_weight(1, r["replicate"], k)) for g, k, s, y, _ in data if g == r["g"]])
        assert abs(r["auc"] - want) < 1e-12


def test_cluster_auc_equals_copied_rows(spark, rows):
    data, df = rows
    df = df.withColumn("c", F.col("k") % 11)
    drawn = rs.resample(df.select("c").distinct(), "c", [], 8, 4).collect()
    aucs = []
    for b in range(8):
        w = {r["c"]: r["w"] for r in drawn if r["replicate"] == b}
        aucs.append(plain_auc([(s, y, w.get(k % 11, 0)) for _, k, s, y, _ in data]))
    got = rs.cluster_bootstrap_auc(df, ["s"], "y", "c", (), 8, 4).first()
    assert abs(got["lo"] - np.quantile(aucs, 0.025)) < 1e-9 and abs(got["hi"] - np.quantile(aucs, 0.975)) < 1e-9
    both = rs.cluster_bootstrap_auc(df, ["s", "x"], "y", "c", (), 8, 4, draws="poisson").first()
    assert both["lo"] <= both["auc_difference"] <= both["hi"] or both["hi"] - both["lo"] < 1


def test_bootstrap_mean_kinds_and_edges(spark):
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(400)] + [("b", 1000, 5.0), ("c", 1001, None)], "g string, k int, __x double")
    poisson = {r["g"]: r for r in rs.bootstrap_mean(df, "__x", "k", ["g"], 400, 1).collect()}
    units = {r["g"]: r for r in rs.bootstrap_mean(df, "__x", "k", ["g"], 200, 1, draws="units").collect()}
    assert set(poisson) == set(units) == {"a", "b"} and poisson["b"]["lo"] == poisson["b"]["hi"] == 5.0
    for side in ("lo", "hi"):
        assert abs(poisson["a"][side] - units["a"][side]) < 0.08
    assert rs.bootstrap_mean(df.filter("false"), "__x", "k", ["g"], 20).count() == 0
    with pytest.raises(ValueError):
        rs.bootstrap_mean(df, "__x", "k", draws="twice")


def test_battery_has_both_intervals(spark):
    rng = np.random.default_rng(1)
    rows = [("shuffle", i, float(2 + rng.normal())) for i in range(60)] + [("reverse", i, float(0.05 * rng.normal())) for i in range(60)]
    deltas = spark.createDataFrame(rows, "perturbation string, k int, delta double")
    expect = spark.createDataFrame([("shuffle", "real_higher"), ("reverse", "no_preference")], "perturbation string, expect string")
    out = {r["perturbation"]: r for r in co.contrast_battery(deltas, expect, "shuffle", key="k", replicates=2000).collect()}
    for r in out.values():
        half = (r["ci_hi"] - r["ci_lo"]) / 2
        assert abs(r["boot_lo"] - r["ci_lo"]) < 0.3 * half and abs(r["boot_hi"] - r["ci_hi"]) < 0.3 * half
    assert out["shuffle"]["verdict"] == "REPRESENTS" and out["reverse"]["verdict"] == "INVARIANT"
    assert "boot_lo" not in co.contrast_battery(deltas, expect, "shuffle").columns


def plain_draw(seed, b, *keys):
    a, c = wt._keyed(seed, "a", b) % (wt.PRIME - 1) + 1, wt._keyed(seed, "c", b) % wt.PRIME
    return (a * (wt._keyed(seed, *keys) % wt.PRIME) + c) % wt.PRIME


def test_permuted_sums_take_the_smallest_draws(spark):
    """A band narrower than the table, a group all in its band, one-sided groups."""
    data = [("big", k, (k * 37 % 101) / 7, 1200) for k in range(6000)] + [("small", k, float(k), 3) for k in range(9)] + [("none", 1, 5.0, 0), ("all", 2, 6.0, 1)]
    totals = {"big": 6000, "small": 9, "none": 1, "all": 1}
    df = spark.createDataFrame([(*r, totals[r[0]]) for r in data], "g string, k int, x double, m long, n long").repartition(6)
    out = wt.permuted_sums(df, "k", "x", "m", "n", ["g"], 4, 9).collect()
    assert len(out) == 16
    for r in out:
        mine = sorted((plain_draw(9, r["replicate"], g, k), k, x) for g, k, x, _ in data if g == r["g"])
        m = next(m for g, _, _, m in data if g == r["g"])
        assert abs(r["permuted"] - sum(x for _, _, x in mine[:m])) < 1e-6


def test_permutation_p_of_a_shift(spark):
    df = spark.createDataFrame([(g, i, float(i // 2 % 10) + (3 if g == "far" and i % 2 else 0), i % 2) for g in ("far", "same") for i in range(200)], "g string, k int, x double, y int")
    out = {r["g"]: r for r in rs.permutation_test(df, "x", "y", "k", ["g"], 300, 1, "greater").collect()}
    assert out["far"]["p"] < 0.01 and out["same"]["p"] > 0.02 and out["far"]["n1"] == 100
    single = rs.permutation_test(df.filter("y = 1"), "x", "y", "k", ["g"], 10).collect()
    assert all(r["p"] is None and r["observed"] is None for r in single)


def test_rank_sum_null_by_counting():
    from itertools import combinations

    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 11))
        s = rng.integers(0, 4, n)
        doubled = [int(2 * ((s < v).sum() + ((s == v).sum() + 1) / 2)) for v in s]
        k = int(rng.integers(1, n))
        seen = int(rng.choice([sum(doubled[i] for i in c) for c in combinations(range(n), k)]))
        sums = [sum(doubled[i] for i in c) for c in combinations(range(n), k)]
        ranks = sorted(set(doubled))
        got = rs.rank_sum_tail(ranks, [doubled.count(r) for r in ranks], k, seen)
        assert got == pytest.approx(sum(v >= seen for v in sums) / len(sums), abs=1e-12)
    # A balanced table of 120 rows: the upper half and the centre of a symmetric null.
    ranks = [2 * i for i in range(1, 121)]
    centre = 60 * 121
    upper, above = (rs.rank_sum_tail(ranks, [1] * 120, 60, v) for v in (centre, centre + 1))
    assert upper + above == pytest.approx(1.0, abs=1e-9)


def test_auc_permutation_methods(spark):
    data = [(g, i, float((i * 7) % n), int(i % 3 == 0)) for g, n in (("a", 30), ("b", 90)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, k int, s double, y int")
    exact = {r["g"]: r for r in rs.auc_permutation(df, "s", "y", "k", ["g"], "exact").collect()}
    drawn = {r["g"]: r for r in rs.auc_permutation(df, "s", "y", "k", ["g"], "drawn", 2000, 1).collect()}
    for g in "ab":
        assert exact[g]["method"] == "exact" and drawn[g]["method"] == "drawn" and abs(exact[g]["p"] - drawn[g]["p"]) < 0.05
    with pytest.raises(Exception, match="no exact null"):
        rs.auc_permutation(df, "s", "y", "k", ["g"], "exact", most=50).collect()


def test_sampled_pairs_are_distinct_and_as_many_as_asked(spark):
    from touchstone.operators.sampling import sample_pairs

    df = spark.createDataFrame([(g, i) for g, n in (("one", 1), ("few", 5), ("many", 300)) for i in range(n)], "g string, k int")
    for want in (1, 7, 10, 30_000, 50_000):
        rows = [tuple(r) for r in sample_pairs(df, "k", want, ["g"], 3).collect()]
        assert len(rows) == len(set(rows)) == min(want, 10) + min(want, 300 * 299 // 2) and all(a < b for _, a, b in rows)
    big = sample_pairs(spark.range(1_000_000), "id", 20_000, seed=1)
    assert big.distinct().count() == 20_000
    spread = big.agg(F.avg("a"), F.avg("b")).first()
    assert abs(spread[0] / 1e6 - 1 / 3) < 0.02 and abs(spread[1] / 1e6 - 2 / 3) < 0.02


def test_draws_of_units_are_dealt_out_and_never_broadcast(spark):
    """Slots look as small as the units to Spark; the table of them stays a shuffle, spread before it is made."""
    df = spark.createDataFrame([(g, i, float(i)) for g, n in (("a", 40), (None, 7)) for i in range(n)], "g string, k int, x double")
    drawn = rs.resampled_rows(df, "k", ["g"], 50, 3)
    for made in (drawn, rs.resample(df, "k", ["g"], 50, 3)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan
    counted = {(r["g"], r["k"], r["replicate"]): r["count"] for r in drawn.groupBy("g", "k", "replicate").count().collect()}
    assert counted == {(r["g"], r["k"], r["replicate"]): r["w"] for r in rs.resample(df, "k", ["g"], 50, 3).collect()}
    sizes = {(r["g"], r["replicate"]): r["count"] for r in drawn.groupBy("g", "replicate").count().collect()}
    assert sizes == {(g, b): n for g, n in (("a", 40), (None, 7)) for b in range(50)}


def test_query_bootstrap_mean_draws_as_many_rows_as_there_are():
    """The query and its SQL make n draws of n rows in every replicate."""
    import inspect

    from touchstone.plans import resample_queries as rq
    from touchstone.plans.registry import ORACLES

    assert "range(100)" in ORACLES["bootstrap_mean"] and "% n + 1 as rn" in ORACLES["bootstrap_mean"]
    assert 'draws="units"' in inspect.getsource(rq.bootstrap_mean)


def test_cluster_permuted_null_reads_rows_once(spark, monkeypatch):
    """Equal to ranking the copied rows of every replicate, without ranking any."""
    rng = np.random.default_rng(5)
    data = [(i, None if i % 29 == 0 else f"c{int(rng.integers(0, 9))}", float(rng.integers(0, 12)), float(rng.integers(0, 30))) for i in range(300)]
    df = spark.createDataFrame(data, "k int, c string, f double, y double")
    frame = pd.DataFrame(data, columns=["k", "c", "f", "y"])
    frame["c"] = frame["c"].fillna("")
    means = frame.groupby("c")["y"].mean().sort_index()  # the null cluster, here "", is permuted and its rows are left out
    inside = frame[frame["c"] != ""]
    rho, null = frame["f"].rank().corr(frame["y"].rank()), []
    for b in range(20):
        order = sorted(means.index, key=lambda c: (wt._keyed(2, b, c), c))
        null.append(inside["f"].rank().corr(inside["c"].map(dict(zip(order, means))).rank()))
    real = rs.spearman
    monkeypatch.setattr(rs, "spearman", lambda rows, *a, **k: real(rows, *a, **k) if len(a) == 2 else pytest.fail("replicates are ranked as rows"))
    got = rs.cluster_permuted_null(df, "f", "y", "c", "k", 20, 2).first()
    assert got["n"] == 300 and abs(got["rho"] - rho) < 1e-12 and got["p"] == pytest.approx(np.mean(np.abs(null) >= abs(rho) - 1e-12))

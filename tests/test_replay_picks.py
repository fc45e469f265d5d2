"""A replay keeps its picks, not the rows of every cell, and its cuts do not depend on how they are made."""

from pyspark.sql import functions as F

from touchstone.plans import selection as se

POLICIES = ["random", "score", "ridge", "ucb", "epsilon", "planner"]


def grid(spark):
    k = F.col("id")
    rows = spark.range(400).select(
        (k % 2).alias("g"), k.alias("k"), ((k * 37 % 101) / 10 + k % 13).alias("y"), (k % 13).cast("double").alias("x1"),
        (k % 5).cast("double").alias("x2"), F.when(k % 11 > 0, (k % 7).cast("double")).alias("s"))
    return se.backtest_grid(rows, ["x1", "x2"], "y", ["s", "x2"], "k", ["g"], POLICIES, 2, 10, 2, top_fraction=0.05)


def test_only_picks_are_kept_of_a_round(spark, monkeypatch):
    kept = []

    def counted(df, cut=se.cut_lineage):
        kept.append(cut(df))
        return kept[-1]

    monkeypatch.setattr(se, "cut_lineage", counted)
    out = grid(spark).collect()
    sizes = [df.count() for df in kept]
    cells = 2 * 2 * 4
    assert max(sizes) == 400 and sorted(sizes)[-3:-1] == [cells * 10] * 2
    assert len(out) == 2 * len(POLICIES) and all(r.seeds == 2 and 0 <= r.top_recall <= 1 for r in out)
    monkeypatch.setattr(se, "_LIMITED", 0)
    assert sorted(grid(spark).collect()) == sorted(out)

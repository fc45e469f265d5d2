"""Longest runs without a string per character; texts of a quality profile are read once."""

import re

import pytest

from touchstone.functions import text as tx
from touchstone.operators import groups as gr

TEXTS = [None, "", "a", "ab", "aab", "\n\n\n", "éééb", "😀😀😀x😀", "\r\n\r\n", "x" * 200_000 + "yy", "abc" * 5]


def longest(t):
    return max((len(m[0]) for m in re.finditer(r"(?s)(.)\1*", t or "")), default=0)


def test_only_runs_of_two_or_more_leave_the_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in df.select("t", tx.longest_run("t").alias("r")).collect():
        assert row.r == longest(row.t)
    plan = df.select(tx.longest_run("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "\\1*" not in plan and "\\2*" not in plan


def profile(spark, folder):
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(TEXTS * 3)], "g int, t string")
    df.write.parquet(str(folder))
    return gr.quality_profile(spark.read.parquet(str(folder)), "t", ["g"])


def check(out):
    for row in out.collect():
        texts = [t for i, t in enumerate(TEXTS * 3) if i % 2 == row.g]
        shares = sorted(longest(t) / len(t) for t in texts if t)
        bad = sum(not t or longest(t) / len(t) > 0.3 for t in texts)
        middle = (shares[(len(shares) - 1) // 2] + shares[len(shares) // 2]) / 2
        assert (row.n, row.degenerate) == (len(texts), bad)
        assert (row.degenerate_rate, row.mean_run_fraction, row.median_run_fraction) == pytest.approx((bad / len(texts), sum(shares) / len(shares), middle))


def test_a_profile_reads_its_texts_once(spark, tmp_path):
    out = profile(spark, tmp_path / "d")
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    check(out)


def test_a_profile_of_large_groups_reads_its_texts_once(spark, split, tmp_path):
    out = profile(spark, tmp_path / "d")
    assert "parquet" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    check(out)

"""The running AUC of a stream against a batch job over all rows so far, round by round and over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from touchstone.operators.agreement import roc_auc
from touchstone.streaming import ordered_state as os_
from touchstone.streaming import streams as st

SCHEMA = "g string, s double, y int"


@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get(os_.PROVIDER)
    spark.conf.set(os_.PROVIDER, os_.ROCKSDB)
    yield
    spark.conf.set(os_.PROVIDER, before)


def test_equals_batch_after_every_round_and_after_a_restart(spark, tmp_path, rocksdb):
    rng = random.Random(5)

    def some(n, part):
        values = [-2.5, -0.0, 0.0, 1e-300, 0.5, 0.5000001, 3.0, 7e9, None, float("nan"), float("inf")]
        return [(rng.choice(["a", "b", None] if part else ["a"]), rng.choice(values) if rng.random() < 0.7 else rng.gauss(0, 1), rng.choice([0, 0, 1, 1, None])) for _ in range(n)]

    batches = [some(120, 0), some(1, 1), some(200, 1), some(80, 1)]
    source, report, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def add(i):
        spark.createDataFrame(batches[i], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = st.replay_source(spark, source, SCHEMA, files_per_trigger=1)
        os_.running_auc_stream(stream, "s", "y", ["g"], report, checkpoint).awaitTermination()

    for i in (0, 1):
        add(i)
        run()
    for i in (2, 3):  # two rounds in one run, from the checkpoint
        add(i)
    run()
    rounds = spark.read.parquet(report)
    order = [{r["g"]: r for r in rounds.filter(F.col("round") == i).collect()} for i in range(4)]
    check(spark, order[0], batches[0], batches[0])
    check(spark, order[1], batches[0] + batches[1], batches[1])
    # The two files of the last run may come in either order; together they touch every group.
    check(spark, {**order[2], **order[3]}, sum(batches, []), batches[2] + batches[3])


def check(spark, got, rows, touched):
    want = {r["g"]: r for r in roc_auc(spark.createDataFrame(rows, SCHEMA), "s", "y", ["g"]).collect()}
    usable = {g for g, s, y in touched if s is not None and s == s and abs(s) != float("inf") and y is not None}
    assert usable == set(got)
    for g in usable:
        if g in want and want[g]["auc"] is not None:
            assert (got[g]["n_pos"], got[g]["n_neg"]) == (want[g]["n_pos"], want[g]["n_neg"])
            assert got[g]["auc"] == pytest.approx(want[g]["auc"], abs=1e-12)
        else:
            assert got[g]["auc"] is None


def test_needs_the_state_store(spark, tmp_path):
    (tmp_path / "x").mkdir()
    if spark.conf.get(os_.PROVIDER) != os_.ROCKSDB:
        with pytest.raises(ValueError):
            os_.running_auc(st.replay_source(spark, str(tmp_path / "x"), SCHEMA), "s", "y", ["g"])

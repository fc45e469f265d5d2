"""The bucketed sink: what it holds, what it reads, and what a failed append leaves."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from touchstone.sources import bucketed as bk
from touchstone.streaming import streams as st

SCHEMA = "k string, j int, v double"


def rows(spark, keys, value):
    return spark.createDataFrame([(k, j, value) for k, j in keys], SCHEMA)


def held(spark, path):
    return sorted(((r["k"] or "", r["j"] or 0, r["v"]) for r in bk.read_bucketed(spark, path, SCHEMA).collect()))


def test_appends_unseen_keys_and_reads_few_parts(spark, tmp_path):
    path = str(tmp_path / "sink")
    first = [(f"a{i}", i) for i in range(3000)]
    assert bk.append_bucketed(rows(spark, [*first, first[0]], 1.0), path, ["k", "j"], 32) == []
    # Unseen keys: hardly a filter answers yes, so hardly a directory is read.
    second = [(f"b{i}", i) for i in range(40)]
    assert len(bk.append_bucketed(rows(spark, second, 2.0), path, ["k", "j"], 32)) <= 4
    # Three known keys among new ones: their parts are read, few others of the 64.
    third = [first[5], first[6], second[3], ("c", 1), (None, 2), (None, None), (None, None)]
    read = bk.append_bucketed(rows(spark, third, 3.0), path, ["k", "j"], 32)
    assert 1 <= len(read) <= 8
    assert {e for e, _ in read} <= {0, 1}
    again = bk.append_bucketed(rows(spark, third, 4.0), path, ["k", "j"], 32)
    assert again
    want = {(k, j, 1.0) for k, j in first} | {(k, j, 2.0) for k, j in second} | {("c", 1, 3.0), ("", 2, 3.0), ("", 0, 3.0)}
    got = held(spark, path)
    assert len(got) == len(want) and set(got) == want


def test_a_failed_append_is_passed_over_and_written_over(spark, tmp_path):
    path = str(tmp_path / "sink")
    bk.append_bucketed(rows(spark, [("a", 1)], 1.0), path, ["k", "j"], 4)
    bk.append_bucketed(rows(spark, [("b", 1)], 2.0), path, ["k", "j"], 4)
    shutil.rmtree(os.path.join(path, "filters", "epoch=1"))  # data were written, the epoch was not committed
    assert bk.committed_epochs(spark, path) == [0] and held(spark, path) == [("a", 1, 1.0)]
    bk.append_bucketed(rows(spark, [("a", 1), ("b", 1)], 3.0), path, ["k", "j"], 4)
    assert held(spark, path) == [("a", 1, 1.0), ("b", 1, 3.0)]
    bk.append_bucketed(rows(spark, [], 9.0), path, ["k", "j"], 4)
    assert bk.committed_epochs(spark, path) == [0, 1, 2] and len(held(spark, path)) == 2
    with pytest.raises(ValueError):
        bk.append_bucketed(rows(spark, [("a", 1)], 1.0).withColumn("bucket", F.lit(1)), path, ["k", "j"], 4)


def test_stream_into_the_bucketed_sink(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "sink")
    for part in range(3):
        rows(spark, [(f"k{i}", 0) for i in range(part * 10, part * 10 + 15)], float(part)).coalesce(1).write.mode("append").parquet(source)
    stream = st.replay_source(spark, source, SCHEMA)
    st.append_new_stream(stream, path, ["k", "j"], str(tmp_path / "cp"), buckets=8).awaitTermination()
    got = held(spark, path)
    assert len(got) == len({k for k, _, _ in got}) == 35
    assert len(bk.committed_epochs(spark, path)) == 3

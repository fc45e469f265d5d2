"""Which labelled documents teach, and which of them fit the linear weights."""

import pytest
from pyspark.sql import functions as F

from touchstone.llm.common import held_out
from touchstone.llm.nb_linear import labelled, sampled


@pytest.fixture()
def tables(spark):
    docs = spark.range(-300, 3000).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("t"), "id")).alias("text"))
    labels = spark.range(-300, 3000, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 != 0, (F.col("id") % 3 == 0).cast("int")).alias("toxic"))
    return docs.union(docs.where("doc_id % 100 = 0")), labels.union(labels.select("doc_id", F.lit(1)).where("doc_id % 8 = 0"))


def test_only_texts_with_a_label_are_joined(tables):
    docs, labels = tables
    marks = labels.where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("y"))
    want = docs.where(~held_out("doc_id", 3, 1)).join(marks, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    got = labelled(docs, labels)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "bitmap_construct_agg" in got._jdf.queryExecution().toString()


def test_sample_takes_the_smallest_hashes_and_sorts_few_texts(tables):
    teach = labelled(*tables)
    for rows in (1, 60, 10_000):
        got = sampled(teach, rows)
        order = [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")]
        want = [r for side in (True, False) for r in teach.where(F.col("y") == side).orderBy(*order).limit(rows).collect()]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    # Only rows up to the last leading bits that the sample needs are sorted.
    assert "shiftright" in sampled(teach, 60)._jdf.queryExecution().toString()

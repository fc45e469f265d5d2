"""Rows that several steps of a summary read are made once where the inputs are large."""

import pytest
from pyspark.sql import functions as F

from touchstone.operators import agreement as ag
from touchstone.operators import operating as op


def test_pooled_summary_reads_its_inputs_once(spark, split, tmp_path):
    spark.range(40).select(F.lit("s").alias("score_name"), (F.col("id") % 7 - 2.5).alias("rho"), (F.col("id") + 5).alias("n")).write.parquet(str(tmp_path / "t"))
    out = ag.pooled_summary(spark.read.parquet(str(tmp_path / "t")))
    assert "parquet" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    row = out.first()
    rho = sorted(i % 7 - 2.5 for i in range(40))
    assert (row.studies, row.median_rho, row.studies_positive) == (40, (rho[19] + rho[20]) / 2, sum(r > 0 for r in rho))
    assert row.weighted_mean_rho == pytest.approx(sum((i + 5) * (i % 7 - 2.5) for i in range(40)) / sum(i + 5 for i in range(40)))


def test_operating_report_reads_its_inputs_once(spark, split, tmp_path):
    points = spark.range(9).select(F.col("id").alias("u"), F.lit(0.1).alias("fpr_budget"), (F.col("id") / 10).alias("tpr"), (F.col("id") != 4).alias("estimable"))
    points.write.parquet(str(tmp_path / "p"))
    bulk = spark.range(9).select(F.col("id").alias("u"), (F.col("id") * 2.0).alias("rho"))
    out = op.operating_report(spark.read.parquet(str(tmp_path / "p")), bulk, ["u"])
    assert str(tmp_path) not in out._jdf.queryExecution().toString()
    row = out.first()
    assert (row.n_estimable, row.median_tpr) == (8, pytest.approx(0.4)) and row.bulk_predicts_tpr == pytest.approx(1)

"""File readers and sinks on small literal files, and the streaming forms against their batch forms."""

import gzip

import pytest
from pyspark.sql import functions as F

from touchstone.operators.agreement import spearman
from touchstone.sources import readers as rd
from pyspark.errors import AnalysisException

from touchstone.sources import writers as wr
from touchstone.streaming import streams as st


def test_campaign_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("variant,fitness,pH\nA1G,1.5,7\nWT,,7\nzz,2,8\nA1G/C2D,0.5,8\n")
    rows, notes = rd.read_campaign(spark, str(tmp_path / "c.csv"))
    n = notes.first()
    assert (n["mode"], n.unparseable, n.n_measured, n.n_candidates, list(n.conditions)) == ("variant", 1, 2, 1, ["pH"])
    assert sorted(r.n_mut for r in rows.collect()) == [0, 1, 2]
    (tmp_path / "s.csv").write_text("id,sequence\na,ACD\nb,AC\n")
    rows, notes = rd.read_campaign(spark, str(tmp_path / "s.csv"))
    assert notes.first()["mode"] == "sequence" and notes.first().n_candidates == 2 and {r.seq_len for r in rows.collect()} == {2, 3}
    with pytest.raises(ValueError):
        rd.campaign(spark.createDataFrame([(1,)], "x int"))


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first record\nACG\nTT\n>two\nGG\n")
    got = {r.id: (r.description, r.seq) for r in rd.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"one": ("first record", "ACGTT"), "two": ("", "GG")}
    (tmp_path / "b.fasta").write_text(">s1 binds A->B weakly\nAC\n>s2\nG>T\n")
    assert {r.id: (r.description, r.seq) for r in rd.read_fasta(spark, str(tmp_path / "b.fasta")).collect()} == {"s1": ("binds A->B weakly", "AC"), "s2": ("", "G>T")}
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("a;b\n1;2\n3;4\n")
    assert rd.read_delimited(spark, str(tmp_path / "z.csv.gz"), ";", "a int, b int", partitions=2).agg(F.sum("b")).first()[0] == 6
    (tmp_path / "x.gff").write_text("##gff\nc1\tsrc\tCDS\t11\t20\t.\nc1\tsrc\tgene\t1\t30\t.\n")
    assert [tuple(r) for r in rd.read_gff(spark, str(tmp_path / "x.gff")).collect()] == [("c1", 10, 20)]
    raw = spark.createDataFrame([("k", "join(1..10,<21..>30)")], "k string, loc string")
    assert sorted((r.start, r.end) for r in rd.range_intervals(raw, "k", "loc").collect()) == [(0, 10), (20, 30)]
    matrix = spark.createDataFrame([("# note",), ("   A  C",), ("A  4 -1",), ("C -1  9",)], "value string")
    assert {(r.a, r.b): r.score for r in rd.substitution_matrix(matrix).collect()} == {("A", "A"): 4.0, ("A", "C"): -1.0, ("C", "A"): -1.0, ("C", "C"): 9.0}


def test_study_files_profiles_and_splits(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("muts,act\nA1G,1\n")
    (tmp_path / "s2.csv").write_text("muts,tm\nC2D,40\n")
    (tmp_path / "s3.csv").write_text("other\n1\n")
    rows, skipped = rd.read_study_files(spark, [str(tmp_path / f"s{i}.csv") for i in (1, 2, 3)], "muts")
    assert {r.study for r in rows.collect()} == {"s1", "s2"} and [r.study for r in skipped.collect()] == ["s3"]
    from touchstone.functions.tables import context_grid

    grid = [r[0] for r in context_grid(spark).collect()]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "SBS1_PROFILE.txt").write_text("Type\tW\n" + "".join(f"{c}\t{i}\n" for i, c in enumerate(grid)))
    got = rd.read_profiles(spark, str(tmp_path))
    assert got.count() == 96 and got.agg(F.sum("share")).first()[0] == pytest.approx(1.0) and got.first().profile == "SBS1"
    (tmp_path / "deep" / "BAD_PROFILE.txt").write_text(f"{grid[0]}\t1\n")
    with pytest.raises(ValueError):
        rd.read_profiles(spark, str(tmp_path))
    for name in ("train", "test"):
        spark.createDataFrame([("chr1:5-9", "acgt", 1)], "name string, sequence string, label int").write.parquet(str(tmp_path / name))
    rows = rd.read_splits(spark, str(tmp_path / "train"), str(tmp_path / "test")).collect()
    assert {r.split for r in rows} == {"train", "test"} and rows[0].chrom == "chr1" and rows[0].end == 9 and rows[0].sequence == "ACGT"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    sink = str(tmp_path / "sink")
    for _ in range(2):
        wr.append_new(rows, sink, ["k"])
    assert spark.read.parquet(sink).count() == 2
    for fmt in ("parquet", "csv", "json"):
        wr.write_report(rows, str(tmp_path / fmt), fmt, files=1)
    assert wr.merge_files(spark, str(tmp_path / "csv" / "*.csv")).count() == 3


@pytest.fixture()
def event_files(spark, tmp_path):
    """Events in three files, with a repeated key across files."""
    rows = [(i, f"2024-01-01 {i // 6:02d}:{(i % 6) * 10:02d}:00", "a" if i % 2 else "b", float(i % 7), float((i * 3) % 11)) for i in range(60)]
    for part in range(3):
        data = rows[part * 20 : part * 20 + 20] + rows[:2]
        df = spark.createDataFrame(data, "id int, ts string, g string, x double, y double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_append_stream_equals_batch(spark, event_files, tmp_path):
    schema = spark.read.parquet(event_files).schema
    stream = st.replay_source(spark, event_files, schema)
    st.append_new_stream(stream, str(tmp_path / "out"), ["id"], str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("id").distinct().count() == 60


def test_rolling_stream_equals_batch(spark, event_files, tmp_path):
    schema = spark.read.parquet(event_files).schema
    stream = st.deduplicated(st.replay_source(spark, event_files, schema, 10), "ts", ["id"], "0 minutes")
    st.rolling_audit_stream(stream, "ts", "x", "y", ["g"], "2 hours", None, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = {(r.window_start, r.g): (r.n, round(r.pearson, 9)) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    batch = st.pearson_from_sums(st.rolling_sums(spark.read.parquet(event_files).dropDuplicates(["id"]), "ts", "x", "y", ["g"], "2 hours"))
    want = {(r.window.start, r.g): (r.n, round(r.pearson, 9)) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_exact_rounds_stream(spark, event_files, tmp_path):
    schema = spark.read.parquet(event_files).schema
    stream = st.replay_source(spark, event_files, schema)
    st.exact_audit_stream(stream, "x", "y", ["g"], str(tmp_path / "store"), str(tmp_path / "rep"), str(tmp_path / "c2"), ["id"]).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "rep"))
    final = last.filter(F.col("round") == last.agg(F.max("round")).first()[0])
    want = {r.g: r.rho for r in spearman(spark.read.parquet(event_files).dropDuplicates(["id"]), "x", "y", ["g"]).collect()}
    assert {r.g: r.rho for r in final.collect()} == pytest.approx(want)


def test_forward_join_stream_and_batch(spark, event_files, tmp_path):
    rows = spark.read.parquet(event_files).dropDuplicates(["id"])
    scores = rows.filter("g = 'a'").select(F.lit(1).alias("e"), F.col("ts").alias("score_ts"), F.col("x").alias("score"))
    outcomes = rows.filter("g = 'b'").select(F.lit(1).alias("e"), F.col("ts").alias("outcome_ts"), "id")
    got = {r.id: r.score_ts for r in st.forward_pairs(scores, outcomes, "e", "score_ts", "outcome_ts", "score", "id").collect()}
    pairs = st.forward_join_stream(scores, outcomes, "e", "score_ts", "outcome_ts", "1 hour", "7 days")
    want = {r.id: r.t for r in pairs.groupBy("id").agg(F.max("score_ts").alias("t")).collect()}
    assert got == want


def test_append_reads_every_file_of_the_sink(spark, tmp_path):
    sink = str(tmp_path / "sink")
    spark.createDataFrame([(9,)], "other int").write.parquet(sink)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(AnalysisException):  # no file has the key: not taken for an empty sink
        wr.append_new(rows, sink, ["k"])
    rows.limit(1).write.mode("append").parquet(sink)
    for _ in range(2):
        wr.append_new(rows, sink, ["k"])
    assert spark.read.option("mergeSchema", True).parquet(sink).where("k is not null").count() == 2


def test_rolling_correlation_keeps_its_digits(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:%02d" % i, 1e9 + i, 1e9 + 2 * i + i % 2, "g") for i in range(50)], "ts string, x double, y double, g string")
    out = st.pearson_from_sums(st.rolling_sums(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "x", "y", ["g"], "2 hours")).first()
    x = [float(i) for i in range(50)]
    y = [2.0 * i + i % 2 for i in range(50)]
    mx, my = sum(x) / 50, sum(y) / 50
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert abs(out.pearson - want) < 1e-9

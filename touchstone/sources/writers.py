"""Sinks: reports, resumable appends and merging of result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", files: int | None = None, partition_by: Sequence[str] = ()) -> None:
    """Result table as parquet, csv or json.  ``files`` sets the file count of small reports."""
    out = df.coalesce(files) if files else df
    writer = out.write.mode(mode).partitionBy(*partition_by) if partition_by else out.write.mode(mode)
    writer = writer.option("header", True) if fmt == "csv" else writer
    writer.format(fmt).save(path)


def new_rows(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in the sink yet, one per key."""
    return rows.dropDuplicates(list(keys)).join(done.select(*keys).distinct(), list(keys), "left_anti")


def sink_has_data(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds a file that is neither hidden nor a marker."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return False
    found = files.listFiles(where, True)
    while found.hasNext():
        if not found.next().getPath().getName().startswith(("_", ".")):
            return True
    return False


def append_new(rows: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> None:
    """Append only rows with unseen keys; rerunning after a failure adds nothing twice."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(list(keys))
    if sink_has_data(spark, path):
        reader = spark.read.option("mergeSchema", True) if fmt in ("parquet", "orc") else spark.read
        fresh = new_rows(rows, reader.format(fmt).load(path).select(*keys), keys)
    fresh.write.mode("append").format(fmt).save(path)


def merge_files(spark: SparkSession, pattern: str, fmt: str = "csv") -> DataFrame:
    """All result files that match a glob as one table, aligned by column name."""
    if fmt == "parquet":
        return spark.read.option("mergeSchema", True).parquet(pattern)
    reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
    return reader.format(fmt).option("enforceSchema", False).load(pattern)

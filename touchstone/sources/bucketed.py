"""A sink that appends unseen keys and reads only the parts that may hold one.

Rows lie in ``data/epoch=<n>/bucket=<b>`` by a hash of their keys; each bucket of an epoch has a Bloom filter in
``filters/epoch=<n>``, whose success marker commits the epoch.  An append asks the filters first and then reads the keys of
the buckets that answer yes; the anti join on real keys decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 10
PROBES = 7
FILTERS = "bucket int, bits binary"


def _hashes(keys: Sequence[str]) -> tuple[Column, Column]:
    return F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)


def _places(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key, one line per probe."""
    step = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((a.view(np.uint64) + step * (b.view(np.uint64) | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed_epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs whose filters are complete; data of any other epoch are the remains of a failed append."""
    where, files = _files(spark, f"{path}/filters")
    if not files.exists(where):
        return []
    out = []
    for entry in files.listStatus(where):
        name = entry.getPath().getName()
        marker, _ = _files(spark, f"{path}/filters/{name}/_SUCCESS")
        if name.startswith("epoch=") and files.exists(marker):
            out.append(int(name.removeprefix("epoch=")))
    return sorted(out)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of buckets that come one after the other."""
    at, a, b = None, [], []

    def closed() -> pa.RecordBatch:
        x, y = np.concatenate(a), np.concatenate(b)
        bits = np.zeros(-(-max(64, BITS_PER_KEY * len(x)) // 8) * 8, bool)
        bits[_places(x, y, len(bits)).ravel()] = True
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits).tobytes()])], ["bucket", "bits"])

    for batch in batches:
        bucket = batch["bucket"].to_numpy()
        x, y = batch["a"].to_numpy(), batch["b"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]) if len(bucket) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
            if at is not None and bucket[lo] != at:
                yield closed()
                a, b = [], []
            at = int(bucket[lo])
            a.append(x[lo:hi])
            b.append(y[lo:hi])
    if at is not None:
        yield closed()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(epoch, bucket) of the filters that may hold a key: a bucket's filters come before its keys."""
    at, filters, hit = None, {}, set()
    for batch in batches:
        bucket, epoch = batch["bucket"].to_numpy(), batch["epoch"].to_pylist()
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]) if len(bucket) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
            if bucket[lo] != at:
                at, filters = int(bucket[lo]), {}
            keys = [i for i in range(lo, hi) if epoch[i] is None]
            for i in range(lo, hi):
                if epoch[i] is not None:
                    filters[epoch[i]] = np.unpackbits(np.frombuffer(batch["bits"][i].as_py(), np.uint8)).astype(bool)
            if not keys:
                continue
            x, y = batch["a"].take(pa.array(keys)).to_numpy(), batch["b"].take(pa.array(keys)).to_numpy()
            for number, bits in filters.items():
                if (number, at) not in hit and bits[_places(x, y, len(bits))].all(0).any():
                    hit.add((number, at))
    if hit:
        epochs, buckets = zip(*sorted(hit))
        yield pa.RecordBatch.from_arrays([pa.array(epochs, pa.int64()), pa.array(buckets, pa.int32())], ["epoch", "bucket"])


def _keyed(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    a, b = _hashes(keys)
    return rows.select(F.pmod(a, F.lit(buckets)).cast("int").alias("bucket"), a.alias("a"), b.alias("b"))


def parts_to_read(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> list[tuple[int, int]]:
    """(epoch, bucket) of the sink that may hold a key of ``rows``: at most one entry per directory of the sink."""
    spark = rows.sparkSession
    epochs = committed_epochs(spark, path)
    if not epochs:
        return []
    stored = spark.read.schema(f"{FILTERS}, epoch bigint").parquet(f"{path}/filters").filter(F.col("epoch").isin(epochs))
    none = F.lit(None)
    asked = stored.select("bucket", "epoch", "bits", none.cast("long").alias("a"), none.cast("long").alias("b")).unionByName(
        _keyed(rows, keys, buckets).select("bucket", none.cast("long").alias("epoch"), none.cast("binary").alias("bits"), "a", "b"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = asked.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("epoch").asc_nulls_last())
    found = placed.mapInArrow(_asked, "epoch bigint, bucket int").distinct()
    return sorted((r["epoch"], r["bucket"]) for r in found.collect())


def append_bucketed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> list[tuple[int, int]]:
    """Append rows with unseen keys (one per key); returns the parts of the sink that were read.

    A failed append leaves an uncommitted epoch that readers pass over and the next append writes over.  ``buckets`` is the
    sink's for all its life.  Null keys are keys.
    """
    spark, keys = rows.sparkSession, list(keys)
    parts = parts_to_read(rows, path, keys, buckets)
    fresh = rows.dropDuplicates(keys)
    if parts:
        old = spark.read.option("basePath", f"{path}/data").schema(rows.select(*keys).schema).parquet(*[f"{path}/data/epoch={e}/bucket={b}" for e, b in parts])
        old = old.select(*[F.col(k).alias(f"__old_{k}") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__old_{k}"))
        fresh = fresh.join(old, same, "left_anti")
    epoch = max(committed_epochs(spark, path), default=-1) + 1
    a, _ = _hashes(keys)
    if "bucket" in rows.columns or "epoch" in rows.columns:
        raise ValueError("the sink's own columns bucket and epoch are taken")
    placed = fresh.withColumn("bucket", F.pmod(a, F.lit(buckets)).cast("int")).repartition("bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/data/epoch={epoch}")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filters = _keyed(written, keys, buckets).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_built, FILTERS)
    filters.write.mode("overwrite").parquet(f"{path}/filters/epoch={epoch}")
    return parts


def read_bucketed(spark: SparkSession, path: str, schema) -> DataFrame:
    """All committed rows."""
    epochs = committed_epochs(spark, path)
    empty = spark.createDataFrame([], schema)
    if not epochs:
        return empty
    stored = spark.read.option("basePath", f"{path}/data").schema(empty.schema)
    return stored.parquet(*[f"{path}/data/epoch={e}" for e in epochs]).select(*empty.columns)

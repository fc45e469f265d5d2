"""What the corpus operators share: written intermediate tables, vectorised words and shingles, components of links."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACES = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]


# ---- intermediate tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A folder of the machine serves only a local master, whose executors are on that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps neither recompute nor lose it.

    Shuffle files of the job go when it ends.  The table stays until the shared folder is cleared, like a checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a settled table that nothing reads any more."""
    path = getattr(df, "_settled_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the user sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_text(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into ``fold``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds)) == fold


# ---- words of whole Arrow batches, as numpy arrays

CHUNK = 2 << 20  # bytes of text handled at once; one longer document is one chunk

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = _BASE if name == "up" else _INVERSE
        have = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have, dtype=np.uint64)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (of one more than the rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes of text each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of each word ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased, in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power("up", n)[:n], out=total[1:])
    h = (total[end] - total[start]) * _power("down", n)[start]
    h = mixed(h + (end - start).astype(np.uint64))
    return h, np.searchsorted(offsets, start, side="right") - 1


_STEP = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words; a row with fewer words has its whole sequence as one run."""
    n = len(h)
    if n == 0:
        return h, row
    acc = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        acc[:n - k] += h[k:] * _STEP[k]
    whole = np.zeros(n, dtype=bool)
    if n >= width:
        whole[:n - width + 1] = row[:n - width + 1] == row[width - 1:]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[begin, n])
    short = begin[length < width]
    for s, m in zip(short, length[length < width], strict=True):
        acc[s] = np.r_[h[s:s + m] * _STEP[:m], _STEP[40 + m]].sum(dtype=np.uint64)
    whole[short] = True
    at = np.flatnonzero(whole)
    return mixed(acc[at]), row[at]


def distinct_per_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, rows in order."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from values laid out row by row."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, type=kind))


# ---- components


def components(links: DataFrame) -> DataFrame:
    """Component of each node of the links (``a``, ``b`` long, a != b): ``node``, ``root``, the smallest node reachable.

    Each round hooks every node to its smallest neighbour and contracts; hubs are combined on the map side and joins on a
    hub's key are split by adaptive execution.  Nodes and links are written each round and the round before is removed.
    """
    links = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    nodes = settle(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")))
    while links.limit(1).count():
        both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
        hook = settle(both.groupBy("x").agg(F.min("y").alias("p")).where("p < x"))
        far = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        hook2 = hook.join(far, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))

        def up(df: DataFrame, column: str, hook2: DataFrame = hook2) -> DataFrame:
            return (df.join(hook2.withColumnRenamed("x", column), column, "left")
                    .withColumn(column, F.coalesce("p", column)).drop("p"))

        moved = up(up(links, "a"), "b").where("a <> b")
        next_links = settle(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        next_nodes = settle(up(nodes, "root").select("node", "root"))
        for old in (links, nodes, hook):
            discard(old)
        links, nodes = next_links, next_nodes
    discard(links)
    return nodes

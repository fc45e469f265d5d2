"""Session settings and the size checks that choose between physical strategies."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one group that a single task may sort; larger groups take the range-partitioned path.
SPLIT_ROWS = "spark.touchstone.groupSplitRows"
# Leaf bytes below which no group can be large, so that no counting job is needed.
SMALL_BYTES = "spark.touchstone.smallInputBytes"
# Bytes of a side that may be broadcast explicitly.
BROADCAST_BYTES = "spark.touchstone.broadcastBytes"

_PARTITIONS = "spark.sql.shuffle.partitions"
_JOINED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_DEFAULTS = {SPLIT_ROWS: 5_000_000, SMALL_BYTES: 256 << 20, BROADCAST_BYTES: 64 << 20}


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(_DEFAULTS[name])))


@contextmanager
def tasks_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of jobs that run inside have a task for every eighth of the rows that a group may have in one task, and never
    fewer than the session's number; adaptive execution joins only small ones.  What a task holds does not grow with the table."""
    usual = spark.conf.get(_PARTITIONS)
    tasks = rows // max(1, setting(spark, SPLIT_ROWS) // 8)
    if tasks <= int(usual):
        yield
        return
    joined = spark.conf.get(_JOINED, None)
    spark.conf.set(_PARTITIONS, str(tasks))
    spark.conf.set(_JOINED, str(8 << 20))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, usual)
        if joined is None:
            spark.conf.unset(_JOINED)
        else:
            spark.conf.set(_JOINED, joined)


def leaf_bytes(df: DataFrame) -> int:
    """Catalyst's size of the plan's distinct inputs; reads statistics only and runs no job.

    A table that a plan scans several times counts once, at its largest.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes: dict[str, int] = {}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        try:
            name = str(leaf.relation().location().rootPaths().mkString(","))
        except Exception:  # not a file scan
            name = f"leaf {i}"
        sizes[name] = max(sizes.get(name, 0), _size(leaf))
    return sum(sizes.values())


def _size(plan) -> int:
    """Size estimate of a plan node; estimates through many joins can be too long to convert."""
    try:
        return int(plan.stats().sizeInBytes())
    except ValueError:
        return 1 << 62


def is_small(df: DataFrame, fanout: int = 1) -> bool:
    """True when the inputs are so small that one task could hold all of the output.

    ``fanout`` is the number of output rows the plan makes from one input row.
    """
    return leaf_bytes(df) * max(1, fanout) <= setting(df.sparkSession, SMALL_BYTES)


def needs_split(df: DataFrame, group: list[str], fanout: int = 1) -> bool:
    """Whether some group is too large for one task.

    Settled from statistics where they suffice, else by one count over the group columns.
    """
    if is_small(df, fanout):
        return False
    limit = setting(df.sparkSession, SPLIT_ROWS)
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0]
    return (largest or 0) > limit


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before letter-by-letter work.

    A row group is one task, so a few text files can leave most cores idle.  Inputs that already
    fill the cores with splits are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = int(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", str(128 << 20)).rstrip("bB") or 0)
    return df.repartition(2 * cores) if leaf_bytes(df) < cores * split else df


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder, set from ``spark.checkpoint.dir``; one of this machine only serves a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{_shared(spark)}/tables-{uuid.uuid4().hex}"


def settled(df: DataFrame, always: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, where later steps would repeat a join or an
    aggregation; a plain scan is left alone, unless ``always``.  Steps then read only the columns that they use."""
    if not always and df._jdf.queryExecution().optimizedPlan().collectLeaves().size() < 2:
        return df
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def once(df: DataFrame) -> DataFrame:
    """``df``, made once where its inputs are not small: several steps read it, and few rows come of much work."""
    return df if is_small(df) else cut_lineage(df)


def local_session(cores: int | str = 8, name: str = "touchstone", **conf) -> SparkSession:
    """A session for tests and for the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session

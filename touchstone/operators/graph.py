"""Neighbour joins, connected components, clusters, intervals and pointer chasing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from touchstone.operators.operating import flag_rows
from touchstone.operators.running import attach, islands_by_gap, with_scalars
from touchstone.settings import cut_lineage, is_small, settled, tasks_for


def hamming_neighbours(df, text: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, src, dst) of distinct strings that differ at exactly one place, both directions.

    Strings meet on a key with one place blanked out.  At most one string per letter shares such a
    key, so a key never holds more rows than the alphabet.
    """
    group = list(group)
    distinct = df.select(*group, text).distinct()
    keyed = distinct.withColumn("__p", F.explode(F.sequence(F.lit(1), F.length(text)))).select(
        *group, F.col(text), F.col("__p"), F.overlay(text, F.lit("\x00"), F.col("__p")).alias("__k"))
    other = keyed.select(*group, F.col(text).alias("dst"), "__p", "__k")
    pairs = keyed.withColumnRenamed(text, "src").join(other, [*group, "__p", "__k"])
    return pairs.filter("src <> dst").select(*group, "src", "dst")


_LINKS = 1 << 21  # links that a task joins at once
_LAST = 1 << 20  # links that are left to a single task


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, sorted, and the smallest node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, a, b = np.arange(len(nodes)), at[:len(a)], at[len(a):]
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def _joined(most: int):
    """For ``most`` links of a partition at a time: each node with its smallest; the first row has the number of links."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(side) for side in zip(*held, strict=True))
        if not len(a):
            return
        nodes, roots = _roots(a, b)
        links = np.zeros(len(nodes), np.int64)
        links[0] = len(a)
        for lo in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + (1 << 16)]) for x in (nodes, roots, links)], ["node", "root", "links"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch["a"].to_numpy(zero_copy_only=False), batch["b"].to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= most:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return go


def _contracted(current: DataFrame) -> DataFrame:
    """(a, b): each node and the smallest of its component, for whole numbers as nodes.

    Tasks join the links that they read, so a node has a row for each lot of links that it occurs in.  Its smallest root of
    all lots is its root so far, and its other roots are links between roots.  Where lots lie together in the graph these are
    few, and one task joins them; else they are contracted again, or go through stars when that no longer makes them fewer.
    """
    spark, levels, solved = current.sparkSession, [], None
    while solved is None:
        found = settled(current.mapInArrow(_joined(_LINKS), "node bigint, root bigint, links bigint"), always=True)
        links = found.agg(F.sum("links")).first()[0] or 0
        lots = Window.partitionBy("node").orderBy("root")
        with tasks_for(spark, 2 * links):
            placed = settled(found.select("node", "root", F.first("root").over(lots).alias("m"), F.row_number().over(lots).alias("lot")), always=True)
            current = cut_lineage(placed.filter("root <> m").select(F.col("root").alias("a"), F.col("m").alias("b")).distinct())
        levels.append(placed.filter("lot = 1").select("node", "m"))
        left = current.count()
        if left <= _LAST:
            solved = F.broadcast(cut_lineage(current.coalesce(1).mapInArrow(_joined(left), "node bigint, root bigint, links bigint")).select(
                F.col("node").alias("m"), F.col("root").alias("r")))
        elif 2 * left > links:
            solved = _starred(current, left).select(F.col("a").alias("m"), F.col("b").alias("r"))
    for members in reversed(levels):
        solved = members.join(solved, "m", "left").select(F.col("node").alias("m"), F.coalesce("r", "m").alias("r"))
    return solved.select(F.col("m").alias("a"), F.col("r").alias("b"))


def _starred(current: DataFrame, links: int) -> DataFrame:
    """(a, b): each node and the smallest of its component.

    Alternating large-star and small-star steps: every node links its larger neighbours, then its
    smaller ones, to the smallest it knows.  A step is a minimum per node (combined on the map
    side, so a hub is cheap) and a join back; lineage is cut every round and the loop ends when
    the edge set stops changing.
    """
    with tasks_for(current.sparkSession, 2 * links):  # both directions of a link
        current = cut_lineage(current.distinct())
        seen = None
        while True:
            both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
            large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            # Nodes whose only links are to smaller ones keep them.
            large = large.unionByName(low.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()
            mins = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(mins, "a")
            linked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
            current = cut_lineage(linked.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
            mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if mark == seen:
                break
            seen = mark
    return current.unionByName(current.select("b").distinct().select(F.col("b").alias("a"), "b"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, node: str = "node") -> DataFrame:
    """(node, component) with the smallest member as component name.

    Links between whole numbers are contracted where they are read; others go through alternating stars.
    """
    current = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    current = current.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    kind = current.schema["a"].dataType
    if isinstance(kind, IntegralType):
        out = _contracted(current.select(F.col("a").cast("long"), F.col("b").cast("long")))
    else:
        links = 0
        if not is_small(edges):
            current = cut_lineage(current)
            links = current.count()
        out = _starred(current, links)
    out = out.select(F.col("a").cast(kind).alias(node), F.col("b").cast(kind).alias("component"))
    if nodes is not None:
        alone = nodes.select(F.col(node)).distinct().join(out.select(node), node, "left_anti")
        out = out.unionByName(alone.withColumn("component", F.col(node)))
    return out


def component_shape(components: DataFrame, node: str = "node") -> DataFrame:
    """Component count, largest size and share, singletons.  Members are not returned."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("__n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_components"), F.max("__n").alias("largest"), F.try_divide(F.max("__n"), F.sum("__n")).alias("largest_share"),
        F.sum(F.when(F.col("__n") == 1, 1).otherwise(0)).alias("singletons"))


def missed_set_shape(df, text: str, score: str, label: str, budget: float) -> DataFrame:
    """Shape of the unflagged positives under one-substitution links, as counts only."""
    missed = flag_rows(df, score, label, budget).filter((F.col(label) == 1) & ~F.col("flagged")).select(F.col(text).alias("node")).distinct()
    edges = hamming_neighbours(missed, "node")
    return component_shape(connected_components(edges, nodes=missed))


_CELLS = 1 << 24  # letters compared at once


def _alike(threshold: float):
    """Of rows sorted by ``bucket``: links (``a``, ``b``) of a star per set of texts that alike pairs of a bucket connect.

    Row i is compared with row i + d for d = 1, 2, ... while any two lie in one bucket, all buckets of a batch at once.
    """

    def pairs(bucket: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = letters.shape[1]
        step = max(1, _CELLS // max(1, length))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, len(bucket)):
            near = np.flatnonzero(bucket[d:] == bucket[:-d])
            if not len(near):
                break
            for at in range(0, len(near), step):
                i = near[at:at + step]
                same = (letters[i] == letters[i + d]).mean(1) >= threshold - 1e-12
                left.append(i[same])
                right.append(i[same] + d)
        return np.concatenate(left), np.concatenate(right)

    def stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        root = np.arange(n)
        while True:
            low = np.minimum(root[left], root[right])
            new = root.copy()
            np.minimum.at(new, left, low)
            np.minimum.at(new, right, low)
            new = new[new]
            if (new == root).all():
                return root
            root = new

    def linked(part: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = part["bucket"].to_numpy()
        texts = np.array(part["t"].to_pylist(), object)
        length = np.array([len(t) for t in texts])
        for size in np.unique(length).tolist():
            mine = np.flatnonzero(length == size)
            letters = np.frombuffer("".join(texts[mine]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(mine), size)
            left, right = pairs(bucket[mine], letters)
            root = stars(len(mine), left, right)
            moved = np.flatnonzero(root != np.arange(len(mine)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(texts[mine[moved]], pa.string()), pa.array(texts[mine[root[moved]]], pa.string())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            bucket = held["bucket"].to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if whole:
                yield from linked(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from linked(held)

    return run


def identity_links(texts: DataFrame, threshold: float = 0.70, block_rows: int = 1024) -> DataFrame:
    """Links (``a``, ``b``) among distinct texts ``t`` whose components are those of all pairs of equal length with enough
    equal places.

    Two texts of length n with at most m differing places agree on one of m + 1 segments, so texts meet on (length, segment,
    letters of the segment) only, and each meeting is compared letter by letter: exact, without a join of all blocks.  A
    segment value that many texts share is dealt to pairs of blocks of ``block_rows``, so no task takes all of it; a task
    emits fewer links than it has rows.
    """
    rows = texts.select("t", F.length("t").alias("n")).filter("n > 0")
    apart = F.floor((1 - threshold) * F.col("n") + 1e-9).cast("int")
    rows = rows.withColumn("parts", F.least(apart + 1, F.col("n"))).withColumn("every", apart >= F.col("n"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("every"), 0).otherwise(F.col("parts") - 1))))
    begin, end = (F.floor(F.col("n") * (F.col("i") + k) / F.col("parts")).cast("int") for k in (0, 1))
    segment = F.when(F.col("every"), "").otherwise(F.substring("t", begin + 1, end - begin))
    rows = rows.select("t", F.xxhash64("n", "i", segment).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("k") / block_rows).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("t"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = met.select("t", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "t").mapInArrow(_alike(threshold), "a string, b string")


def identity_clusters(df, key: str, text: str, threshold: float = 0.70, block_rows: int = 1024) -> DataFrame:
    """(key, component): single-linkage clusters of equal-length strings with enough equal places (:func:`identity_links`).

    Equal strings are compared once; a null string has no cluster.
    """
    texts = df.filter(F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct()
    comp = connected_components(identity_links(texts, threshold, block_rows), "a", "b", nodes=texts.select(F.col("t").alias("node")))
    return df.select(key, text).join(comp.withColumnRenamed("node", text), text).select(key, "component")


def prefix_then_identity_clusters(df, key: str, text: str, prefix_length: int, threshold: float = 0.70) -> DataFrame:
    """Cluster by an id prefix, then unite prefixes whose representatives are alike.

    The representative of a prefix is its smallest key.
    """
    rows = df.withColumn("__prefix", F.substring(F.col(key).cast("string"), 1, prefix_length))
    reps = rows.groupBy("__prefix").agg(F.min_by(text, key).alias("__text"))
    united = identity_clusters(reps, "__prefix", "__text", threshold)
    named = united.groupBy("component").agg(F.min("__prefix").alias("cluster"))
    return rows.join(united, "__prefix").join(named, "component").select(key, "cluster")


def ruggedness(df, text: str, value: str) -> DataFrame:
    """Local optima, share of greedy ascents that reach the global optimum, mean peak value.

    Every string points to its best neighbour when that is higher; pointers are doubled until
    they stop moving, so the number of rounds is logarithmic in the longest ascent.
    """
    best = df.groupBy(text).agg(F.max(value).alias("v"))
    edges = hamming_neighbours(best, text)
    scored = edges.join(best.select(F.col(text).alias("dst"), F.col("v").alias("dv")), "dst")
    top = scored.groupBy("src").agg(F.min_by(F.struct("dst", "dv"), F.struct(-F.col("dv"), F.col("dst"))).alias("b"))
    state = best.join(top.withColumnRenamed("src", text), text, "left")
    up = F.coalesce(F.col("b.dv") > F.col("v"), F.lit(False))
    state = cut_lineage(state.select(text, "v", F.when(up, F.col("b.dst")).otherwise(F.col(text)).alias("to")))
    base = state
    while True:
        hop = state.select(F.col(text).alias("to"), F.col("to").alias("__next"))
        moved = cut_lineage(state.join(hop, "to").select(text, "v", F.col("__next").alias("to"), (F.col("__next") != F.col("to")).alias("__m")))
        still = moved.agg(F.max("__m")).first()[0]
        state = moved.drop("__m")
        if not still:
            break
    peaks = state.join(base.select(F.col(text).alias("to"), F.col("v").alias("peak")), "to")
    summit = best.agg(F.min_by(text, F.struct(-F.col("v"), F.col(text))).alias("global_key"), F.max("v").alias("global_value"))
    local = base.agg(F.sum((F.col("to") == F.col(text)).cast("int")).alias("local_optima"), F.count(F.lit(1)).alias("n"))
    reach = with_scalars(peaks, summit).groupBy("global_key", "global_value").agg(
        F.avg((F.col("to") == F.col("global_key")).cast("double")).alias("reach_global"), F.avg("peak").alias("mean_peak"))
    return with_scalars(local, reach)


# ---- intervals


def merge_intervals(df, group: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a group as one."""
    group = list(group)
    marked = islands_by_gap(df.select(*group, start, end), group, start, end, 0, "__c")
    return marked.groupBy(*group, "__c").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__c")


def interval_overlap(windows: DataFrame, intervals: DataFrame, group: Sequence[str], key: str, start: str, end: str, bucket: int) -> DataFrame:
    """Share of each half-open window covered by the intervals of its group.

    Intervals are merged first; windows and intervals meet on (group, start div bucket) cells, and
    an overlap is counted in the cell where it starts.
    """
    group = list(group)
    merged = merge_intervals(intervals, group, start, end).select(*group, F.col(start).alias("__s"), F.col(end).alias("__e"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor((F.greatest(b - 1, a)) / bucket)))
    left = windows.select(*group, key, start, end).withColumn("__cell", cells(F.col(start), F.col(end)))
    right = merged.withColumn("__cell", cells(F.col("__s"), F.col("__e")))
    met = left.join(right, [*group, "__cell"]).withColumn("__from", F.greatest(start, "__s")).withColumn("__to", F.least(end, "__e"))
    met = met.filter((F.col("__to") > F.col("__from")) & (F.floor(F.col("__from") / bucket) == F.col("__cell")))
    covered = met.groupBy(*group, key).agg(F.sum(F.col("__to") - F.col("__from")).alias("__c"))
    out = attach(windows.select(*group, key, start, end), covered, [*group, key], "left")
    return out.select(*group, key, (F.coalesce("__c", F.lit(0)) / (F.col(end) - F.col(start))).alias("covered_share"))

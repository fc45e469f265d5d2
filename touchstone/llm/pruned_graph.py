"""Nearest neighbours by inner product: robust-pruned directed graphs over shards, searched with beams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchstone.llm.common import discard, partitions, settle

SHARD_ROWS = 4000  # distinct vectors of a shard: what one task indexes
DEGREE = 24  # edges that leave a node
BUILD_BEAM = 48
SEARCH_BEAM = 128
RELAX = 1.2  # how much nearer than the node itself a kept neighbour must be to push a candidate out
QUERY_BLOCK = 512


# ---- one shard, vectorised over blocks of points


def lifted(x: np.ndarray) -> np.ndarray:
    """Unit vectors of one more dimension whose nearest neighbours in distance are the largest inner products."""
    norm = np.einsum("ij,ij->i", x, x)
    top = norm.max(initial=0.0) or 1.0
    return np.concatenate([x / np.sqrt(top), np.sqrt(np.maximum(0.0, 1 - norm / top))[:, None]], 1).astype(np.float32)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors: each row of ``x`` (b x m x d) to its ``y`` (b x d)."""
    return np.maximum(0, 2 - 2 * np.matmul(x, y[:, :, None])[:, :, 0])


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes found for each query, nearest first, and their squared distances (-1 and inf: none).

    All queries advance together: each expands its nearest node not yet expanded, until the beam holds none.
    """
    b, n = len(queries), len(x)
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for no node
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = 2 - 2 * queries @ x[entry]
    seen[:, entry] = seen[:, n] = True
    active = np.arange(b)
    while len(active):
        open_dist = np.where(done[active], np.inf, dist[active])
        pick = open_dist.argmin(1)
        active, pick = active[np.isfinite(open_dist.min(1))], pick[np.isfinite(open_dist.min(1))]
        if not len(active):
            break
        done[active, pick] = True
        near = graph[ids[active, pick]]
        near = np.where(near < 0, n, near)
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        d = np.full(near.shape, np.inf)
        r, c = np.nonzero(new)
        d[r, c] = np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[near[r, c]], queries[active[r]]))
        all_d = np.concatenate([dist[active], d], 1)
        all_i = np.concatenate([ids[active], np.where(new, near, -1)], 1)
        all_done = np.concatenate([done[active], ~new], 1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[active], ids[active], done[active] = (np.take_along_axis(a, keep, 1) for a in (all_d, all_i, all_done))
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` diverse out-neighbours of each point from its pool (-1: none): the nearest candidate stays and
    pushes out every candidate that it is ``relax`` times nearer to than the point is."""
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    pool[pool == points[:, None]] = -1
    dist = np.where(pool < 0, np.inf, apart(x[pool], x[points]))
    order = np.argsort(dist, axis=1, kind="stable")
    pool, dist = np.take_along_axis(pool, order, 1), np.take_along_axis(dist, order, 1)
    vectors = x[pool]
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        pick = dist.argmin(1)
        found = np.isfinite(dist[rows, pick])
        if not found.any():
            break
        out[found, k] = pool[rows, pick][found]
        between = apart(vectors, vectors[rows, pick])
        dist[(relax * relax * between <= dist) | ~found[:, None]] = np.inf
        dist[rows, pick] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 3) -> tuple[np.ndarray, int]:
    """Out-neighbours (n x degree) of the graph over lifted vectors, and its entry: the node nearest to the mean.

    Starts from random edges; every point then searches the graph, prunes what it met and is offered to its neighbours.
    """
    n, rng = len(x), np.random.default_rng(seed)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    if n <= degree + 1:
        every = np.tile(np.arange(n), (n, 1))
        graph = np.where(every == np.arange(n)[:, None], -1, every)
        return np.pad(graph, ((0, 0), (0, max(0, degree - n))), constant_values=-1)[:, :max(degree, n)], entry
    graph = np.full((n, degree), -1)
    graph[:, :8] = rng.integers(0, n, (n, 8))
    graph[graph == np.arange(n)[:, None]] = -1
    for alpha in (1.0, relax):
        order = rng.permutation(n)
        for block in np.array_split(order, max(1, n // 256)):
            met, _ = beam_search(x, graph, x[block], entry, beam)
            graph[block] = robust_prune(x, block, np.concatenate([met, graph[block]], 1), degree, alpha)
            source = np.repeat(block, degree)
            target = graph[block].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            node, start = np.unique(target, return_index=True)
            many = np.diff(np.r_[start, len(target)])
            for wide in (False, True):  # nodes offered much are few; the rest needs no wide pool
                part = np.flatnonzero((many > 8) == wide)
                if not len(part):
                    continue
                offered = np.full((len(part), int(many[part].max())), -1)
                row = np.repeat(np.arange(len(part)), many[part])
                col = np.arange(len(row)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
                offered[row, col] = source[np.repeat(start[part], many[part]) + col]
                pool = np.concatenate([graph[node[part]], offered], 1)
                graph[node[part]] = robust_prune(x, node[part], pool, degree, alpha)
    return graph, entry


# ---- over Spark


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _smallest_ids(keep: int):
    """Of equal vectors in a batch the ``keep`` smallest ids leave, as one row each."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids = batch["raw"].to_pylist(), batch["vec_id"].to_pylist()
            groups: dict[bytes, set] = {}
            for r, i in zip(raw, ids, strict=True):
                groups.setdefault(r, set()).add(i)
            rows = [(r, i) for r, own in groups.items() for i in sorted(own)[:keep]]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.int64())], ["raw", "vec_id"])

    return go


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; those that take no part are left out."""
    for batch in batches:
        lists = batch["embedding"]
        values = np.asarray(lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # null: nan
        values = np.nan_to_num(values, nan=np.inf, posinf=np.inf, neginf=np.inf) + 0.0
        offsets, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
        rows = []
        for i, vec_id in enumerate(batch["vec_id"].to_pylist()):
            v = values[offsets[i]:offsets[i + 1]]
            if vec_id is not None and valid[i] and len(v) and np.isfinite(v).all() and v.any():
                rows.append((vec_id, v.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["vec_id", "raw"])


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard: its vectors, its graph and the ids of each vector's copies."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for dim, shard, raw, ids in zip(*[batch[c].to_pylist() for c in ("dim", "shard", "raw", "ids")], strict=True):
            held.setdefault((dim, shard), []).append((ids[0], raw, ids))
    for (dim, shard), rows in held.items():
        rows.sort(key=lambda r: (r[0], r[1]))
        x = np.frombuffer(b"".join(r[1] for r in rows)).reshape(len(rows), dim)
        graph, entry = build(lifted(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([-1], pa.int64()), pa.array([_packed(x)], pa.binary()),
             pa.array([_packed(graph.astype(np.int32))], pa.binary()), pa.array([entry], pa.int32()),
             pa.array([[i for r in rows for i in r[2]]], pa.list_(pa.int64())), pa.array([[len(r[2]) for r in rows]], pa.list_(pa.int32()))],
            ["dim", "shard", "block", "x", "graph", "entry", "ids", "copies"])


_SHARD = "dim int, shard int, block bigint, x binary, graph binary, entry int, ids array<bigint>, copies array<int>"


def _answers(k: int, beam: int):
    """Rows come sorted by (dim, shard, block): the shard's graph, then blocks of queries."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] < 0:
                    x = np.frombuffer(zlib.decompress(r["x"])).reshape(-1, r["dim"])
                    graph = np.frombuffer(zlib.decompress(r["graph"]), np.int32).reshape(len(x), -1)
                    lift, entry = lifted(x), r["entry"]
                    copies = np.array(r["copies"])
                    ids, first = np.array(r["ids"]), np.r_[0, np.cumsum(copies)]
                    continue
                q = np.frombuffer(zlib.decompress(r["x"])).reshape(-1, r["dim"])
                unit = q / np.maximum(np.abs(q).max(1, keepdims=True), 1e-300)
                unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
                found, _ = beam_search(lift, graph, np.pad(unit, ((0, 0), (0, 1))).astype(np.float32), entry, beam)
                out = []
                for i, own in enumerate(r["ids"]):
                    near = found[i][found[i] >= 0]
                    score = (x[near] * q[i]).sum(1)
                    # Equal scores go by id: the k smallest ids of each distinct vector are candidates.
                    who = np.concatenate([ids[first[v]:first[v + 1]] for v in near])
                    what = np.repeat(score, copies[near])
                    ok = who != own
                    who, what = who[ok], what[ok]
                    best = np.lexsort((who, -what))[:k]
                    out += [(own, w, s) for w, s in zip(who[best].tolist(), what[best].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())],
                    ["query_id", "vec_id", "score"])

    return go


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups: dict[int, list] = {}
        for vec_id, raw in zip(batch["vec_id"].to_pylist(), batch["raw"].to_pylist(), strict=True):
            groups.setdefault(len(raw) // 8, []).append((vec_id, raw))
        for dim, rows in groups.items():
            for at in range(0, len(rows), QUERY_BLOCK):
                part = rows[at:at + QUERY_BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([part[0][0]], pa.int64()),
                     pa.array([zlib.compress(b"".join(r for _, r in part), 1)], pa.binary()), pa.array([[i for i, _ in part]], pa.list_(pa.int64()))],
                    ["dim", "block", "x", "ids"])


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest found of each query (rows whose vec_id is divisible by ``every``) among all other rows.

    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the inner product in double precision; ties go to the smaller
    vec_id.  Approximate: recall against brute force is measured in the tests.

    Equal vectors are one node that keeps its ``k + 1`` smallest ids, which is all that a result can show; they are
    combined in the batch before any shuffle.  Nodes are hashed to shards of about SHARD_ROWS; a task builds a shard's
    graph (robust pruning of what greedy searches meet), queries visit every shard in blocks, and the best of all shards stay.

    Rows without an id, and vectors that are null, empty, zero or hold a null or non-finite component take no part, also not
    as queries.  Vectors of another length than the query's are no candidates.  Rows repeated with one id and vector are
    one; if an id has several vectors, each is a candidate and their query answers merge.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    clean = settle(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_raw, "vec_id bigint, raw binary"))
    few = clean.mapInArrow(_smallest_ids(k + 1), "raw binary, vec_id bigint")
    ranked = few.distinct().withColumn("place", F.row_number().over(Window.partitionBy("raw").orderBy("vec_id"))).where(f"place <= {k + 1}")
    nodes = settle(ranked.groupBy("raw").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                   .withColumn("dim", (F.length("raw") / 8).cast("int")).withColumn("mix", F.xxhash64("raw")))
    counts = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))
    placed = nodes.join(counts, "dim").select("dim", F.pmod("mix", "shards").cast("int").alias("shard"), "raw", "ids")
    p = partitions(spark)
    index = settle(placed.repartition(p, "dim", "shard").mapInArrow(_shard_rows, _SHARD))
    asked = clean.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    blocks = asked.mapInArrow(_query_blocks, "dim int, block bigint, x binary, ids array<bigint>")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("block", "x"), F.lit(1 << 40)))
    visits = blocks.join(counts, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "x", F.lit(None).cast("binary").alias("graph"),
        F.lit(None).cast("int").alias("entry"), "ids", F.lit(None).cast("array<int>").alias("copies"))
    found = settle(index.union(visits).repartition(p, "dim", "shard").sortWithinPartitions("dim", "shard", "block")
                   .mapInArrow(_answers(k, beam), "query_id bigint, vec_id bigint, score double"))
    for old in (clean, nodes, index):
        discard(old)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

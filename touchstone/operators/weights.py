"""Replicate weights as arrays: a row meets every bootstrap replicate inside its task and is never copied for one.

A row's weight in replicate b is Poisson(1), read off v_b = ((a_b h + c_b) mod P) >> 11, where h is the row's keyed hash and
(a_b, c_b) are keyed by the replicate.  Weights depend on (seed, key, b) alone and are integer arithmetic that SQL repeats.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from touchstone.functions.numeric import keyed_int
from touchstone.operators.running import attach, fresh

REPLICATE = "replicate"
PRIME = (1 << 31) - 1
BITS = 20
_CELLS = 1 << 22  # cells of the row x replicate matrix that a task handles at once


def _keyed(*parts) -> int:
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:15], 16)


def multipliers(seed: int, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """(a_b, c_b) of each replicate, as :func:`keyed_int` of (seed, "a" or "c", b)."""
    a = [_keyed(seed, "a", b) % (PRIME - 1) + 1 for b in range(replicates)]
    return np.array(a, np.int64), np.array([_keyed(seed, "c", b) % PRIME for b in range(replicates)], np.int64)


def poisson_cuts() -> list[int]:
    """cuts[k] is the least v of weight k + 1: the distribution function of Poisson(1) in units of 2^-20."""
    cuts, total, term = [], 0.0, math.exp(-1)
    for k in range(20):
        total += term
        cut = math.ceil(total * (1 << BITS))
        if cut >= 1 << BITS:
            break
        cuts.append(cut)
        term /= k + 1
    return cuts


def draw_sql(seed: int, replicate: str, *keys: str) -> str:
    """u_b = (a_b h + c_b) mod P in SQL, for comparisons."""
    def drawn(*parts: str) -> str:
        text = "concat_ws('|', " + ", ".join([f"'{seed}'", *[f"cast({p} as varchar)" for p in parts]]) + ")"
        return f"cast(('0x' || substr(md5({text}), 1, 15)) as bigint)"

    a, c = (f"{drawn(repr(x), replicate)}" for x in "ac")
    return f"((({a} % {PRIME - 1} + 1) * ({drawn(*keys)} % {PRIME}) + {c} % {PRIME}) % {PRIME})"


def weight_sql(seed: int, replicate: str, *keys: str) -> str:
    """The weight in SQL, for comparisons."""
    return f"list_sum(list_transform({poisson_cuts()}, lambda x: case when {draw_sql(seed, replicate, *keys)} // 2048 >= x then 1 else 0 end))"


def unit_hash(seed: int, *keys) -> Column:
    return F.pmod(keyed_int(seed, *keys), F.lit(PRIME))


def _table() -> np.ndarray:
    return np.searchsorted(np.array(poisson_cuts()), np.arange(1 << BITS), side="right").astype(np.float64)


def _blocks(batch: pa.RecordBatch, replicates: int) -> Iterator[pa.RecordBatch]:
    step = max(1, _CELLS // replicates)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


class _Weights:
    """Weights of a block of rows as a matrix: from ``__h``, or the drawn multiplicities in ``__w``."""

    def __init__(self, seed: int, replicates: int):
        self.a, self.c = multipliers(seed, replicates)
        self.replicates, self.table = replicates, None

    def of(self, block: pa.RecordBatch) -> np.ndarray:
        if "__w" in block.schema.names:
            return block["__w"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(block.num_rows, self.replicates)
        if self.table is None:
            self.table = _table()
        h = block["__h"].to_numpy(zero_copy_only=False).astype(np.int64)
        return self.table[(h[:, None] * self.a + self.c) % PRIME >> 11]


def _group_codes(block: pa.RecordBatch, group: list[str]) -> np.ndarray:
    if not group:
        return np.zeros(block.num_rows, np.int64)
    keys = pd.DataFrame({g: block[g].to_pandas() for g in group})
    return keys.groupby(group, dropna=False, sort=False).ngroup().to_numpy()


def _group_rows(df: DataFrame, group: list[str]) -> list[StructField]:
    return list(df.select(*group).schema.fields) if group else []


def weighted_sums(df: DataFrame, key: str | Sequence[str], sums: dict[str, Column], group: Sequence[str] = (), replicates: int = 1000, seed: int = 0) -> DataFrame:
    """``group``, ``replicate`` and, for each name of ``sums``, the sum of weight times expression.

    A task keeps one array of ``replicates`` numbers per group and sum, so the shuffle carries one row per task and group
    however many rows and replicates there are.  Rows with a missing expression count as 0.
    """
    group, names = list(group), list(sums)
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.select(*group, unit_hash(seed, *keys).alias("__h"), *[F.coalesce(e.cast("double"), F.lit(0.0)).alias(f"__s{i}") for i, e in enumerate(sums.values())])
    head = _group_rows(df, group)
    schema = StructType([*head, *[StructField(f"__s{i}", ArrayType(DoubleType())) for i in range(len(names))]])
    arrow_head = [f.name for f in head]
    room = max(1, (1 << 24) // (replicates * max(1, len(names))))  # groups a task holds before it lets go of their sums

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(seed, replicates)
        held: dict[tuple, tuple[pa.RecordBatch, np.ndarray]] = {}

        def drain() -> pa.RecordBatch:
            parts = [pa.concat_arrays([row[g] for row, _ in held.values()]) for g in arrow_head]
            total = np.stack([s for _, s in held.values()])
            offsets = pa.array(np.arange(len(held) + 1, dtype=np.int32) * replicates)
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(total[:, i].ravel())) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*parts, *arrays], [*arrow_head, *[f"__s{i}" for i in range(len(names))]])

        for batch in batches:
            for block in _blocks(batch, replicates):
                w = weights.of(block)
                codes = _group_codes(block, group)
                order = np.argsort(codes, kind="stable")
                begin = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
                value = [block[f"__s{i}"].to_numpy(zero_copy_only=False)[order] for i in range(len(names))]
                w = w[order]
                added = np.stack([np.add.reduceat(w * v[:, None], begin, axis=0) for v in value], axis=1)
                for at, part in zip(order[begin].tolist(), added, strict=True):
                    row = block.slice(at, 1).select(arrow_head)
                    name = tuple(repr(row[g][0].as_py()) for g in arrow_head)
                    held[name] = (row, held[name][1] + part if name in held else part)
                if len(held) >= room:
                    yield drain()
                    held.clear()
        if held:
            yield drain()

    pieces = rows.mapInArrow(partial, schema)
    index = F.posexplode(F.arrays_zip(*[f"__s{i}" for i in range(len(names))])).alias(REPLICATE, "__z")
    cells = pieces.select(*group, index).select(*group, REPLICATE, *[F.col(f"__z.__s{i}").alias(n) for i, n in enumerate(names)])
    return cells.groupBy(*group, REPLICATE).agg(*[F.sum(n).alias(n) for n in names])


def weighted_auc(
    df: DataFrame, score: str, positive: Column, negative: Column, group: Sequence[str] = (), replicates: int = 1000, seed: int = 0,
    key: str | Sequence[str] | None = None, weights: str | None = None, name: str = "auc",
) -> DataFrame:
    """``group``, ``replicate`` and the AUC of the rows under every replicate's weights, from one sort of the rows.

    ``positive`` and ``negative`` are the counts a row stands for.  Weights come from the keyed hash of ``key``, or from the
    array column ``weights`` of drawn multiplicities.  Rows are range-partitioned by (group, score); a task runs along its
    range with arrays of length ``replicates``, and tasks are joined by their totals, one row per task and group.
    """
    group = list(group)
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [key] if isinstance(key, str) else list(key or [])
    drawn = F.col(weights).cast("array<double>").alias("__w") if weights else unit_hash(seed, *keys).alias("__h")
    rows = df.select(*group, F.col(score).cast("double").alias("__v"), positive.cast("double").alias("__p"), negative.cast("double").alias("__q"), drawn)
    placed = rows.repartitionByRange(tasks, *group, "__v").sortWithinPartitions(*group, "__v")
    head = _group_rows(df, group)
    heads = [f.name for f in head]
    schema = StructType([*head, StructField("__part", IntegerType()), *[StructField(c, ArrayType(DoubleType())) for c in ("__p", "__q", "__u")]])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighing = _Weights(seed, replicates)
        part = TaskContext.get().partitionId()
        zero = np.zeros(replicates)
        at, row, value = None, None, None
        p, q, u, open_p, open_q = zero, zero, zero, zero, zero

        def closed() -> pa.RecordBatch:
            done_u = u + open_p * (q + open_q / 2)
            return pa.RecordBatch.from_arrays(
                [*[row[g] for g in heads], pa.array([part], pa.int32()), *[pa.array([x]) for x in (p + open_p, q + open_q, done_u)]],
                [*heads, "__part", "__p", "__q", "__u"])

        for batch in batches:
            for block in _blocks(batch, replicates):
                w = weighing.of(block)
                wp = w * block["__p"].to_numpy(zero_copy_only=False)[:, None]
                wq = w * block["__q"].to_numpy(zero_copy_only=False)[:, None]
                v = block["__v"].to_numpy(zero_copy_only=False)
                codes = _group_codes(block, group)
                cut = np.flatnonzero(np.r_[True, np.diff(codes) != 0])
                for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(v)], strict=True):
                    here = block.slice(lo, 1).select(heads)
                    name = tuple(repr(here[g][0].as_py()) for g in heads)
                    if name != at:
                        if at is not None:
                            yield closed()
                        at, row, value = name, here, None
                        p, q, u, open_p, open_q = zero, zero, zero, zero, zero
                    ties = np.flatnonzero(np.r_[True, np.diff(v[lo:hi]) != 0])
                    tp, tq = np.add.reduceat(wp[lo:hi], ties, axis=0), np.add.reduceat(wq[lo:hi], ties, axis=0)
                    if value is not None and v[lo] == value:
                        tp[0] += open_p
                        tq[0] += open_q
                    elif value is not None:
                        tp, tq = np.vstack([open_p, tp]), np.vstack([open_q, tq])
                    before = q + np.cumsum(tq, axis=0) - tq
                    u = u + (tp[:-1] * (before[:-1] + tq[:-1] / 2)).sum(0)
                    p, q = p + tp[:-1].sum(0), q + tq[:-1].sum(0)
                    open_p, open_q, value = tp[-1], tq[-1], v[hi - 1]
        if at is not None:
            yield closed()

    pieces = placed.mapInArrow(along, schema)
    cells = pieces.select(*group, "__part", F.posexplode(F.arrays_zip("__p", "__q", "__u")).alias(REPLICATE, "__z")).select(
        *group, "__part", REPLICATE, "__z.*")
    earlier = Window.partitionBy(*group, REPLICATE).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__below", F.coalesce(F.sum("__q").over(earlier), F.lit(0.0)))
    won = F.sum(F.col("__u") + F.col("__p") * F.col("__below"))
    return cells.groupBy(*group, REPLICATE).agg(F.try_divide(won, F.sum("__p") * F.sum("__q")).alias(name))


def weight_arrays(drawn: DataFrame, key: Sequence[str], replicates: int, name: str = "weights") -> DataFrame:
    """One row per key with its multiplicities in all replicates, from rows (key, ``replicate``, ``w``)."""
    held = drawn.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(REPLICATE, F.col("w").cast("int").alias("w")))).alias("__m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: F.coalesce(F.try_element_at(F.col("__m"), b), F.lit(0)))
    return held.select(*key, filled.alias(name))


Statistic = Callable[[dict[str, Column]], Column]


def bootstrap_sums(df: DataFrame, key: str, sums: dict[str, Column], statistic: Statistic, group: Sequence[str] = (), replicates: int = 1000, seed: int = 0, name: str = "stat") -> DataFrame:
    """Any smooth function of sums, at the rows and over replicates: ``group``, ``name`` and its percentile interval.

    ``sums`` are row expressions, ``statistic`` turns the sums' columns into the value.
    """
    from touchstone.operators.resample import interval
    group = list(group)
    taken = dict(zip(sums, fresh(df, *[f"sum_{s}" for s in sums])))
    point = df.groupBy(*group).agg(*[F.sum(F.coalesce(e.cast("double"), F.lit(0.0))).alias(taken[s]) for s, e in sums.items()])
    reps = weighted_sums(df, key, {taken[s]: e for s, e in sums.items()}, group, replicates, seed)
    value = statistic({s: F.col(c) for s, c in taken.items()})
    ends = interval(reps.select(*group, value.alias("__stat")), "__stat", group)
    return attach(point.select(*group, value.alias(name)), ends, group, "left")


BAND = 8.0  # deviations around a class's share within which rows are ordered one by one


def permuted_sums(df: DataFrame, key: str, value: str, size: str, total: str, group: Sequence[str] = (), replicates: int = 1000, seed: int = 0, name: str = "permuted") -> DataFrame:
    """``group``, ``replicate`` and the sum of ``value`` over a random ``size`` of the group's ``total`` rows.

    In replicate b those are the rows with the smallest (u_b, key), u_b = (a_b h + c_b) mod P.  ``size`` and ``total`` are
    columns of the rows.  A row far below the threshold that size / total implies is added up in its task, one far above is
    passed over, and only the band between, about 16 sqrt(total) rows, is ordered: exact, without a copy of the table per
    replicate.  Should a band ever miss the threshold, the query fails rather than answer wrongly.
    """
    group = list(group)
    rows = df.select(*group, F.col(key).alias("__k"), F.col(value).cast("double").alias("__x"), F.col(size).cast("long").alias("__m"),
                     F.col(total).cast("long").alias("__n"), unit_hash(seed, *group, key).alias("__h"))
    head = _group_rows(df, group)
    heads = [f.name for f in head]
    tail = [StructField(REPLICATE, IntegerType()), StructField("__m", IntegerType()), StructField("__count", DoubleType()), StructField("__sum", DoubleType()),
            StructField("__u", IntegerType())]
    schema = StructType([*head, StructField("__k", rows.schema["__k"].dataType), *tail])
    room = max(1, (1 << 23) // replicates)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = multipliers(seed, replicates)
        names = [*heads, "__k", *[f.name for f in tail]]
        held: dict[tuple, list] = {}

        def certain() -> Iterator[pa.RecordBatch]:
            for row, m, counts, sums in held.values():
                n = replicates
                parts = [pa.array([row[g][0].as_py()] * n, type=row.schema.field(g).type) for g in heads]
                kinds = row.schema.field("__k").type
                yield pa.RecordBatch.from_arrays(
                    [*parts, pa.nulls(n, kinds), pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, m), pa.int32()), pa.array(counts), pa.array(sums),
                     pa.nulls(n, pa.int32())], names)
            held.clear()

        for batch in batches:
            for block in _blocks(batch, replicates):
                u = (block["__h"].to_numpy(zero_copy_only=False).astype(np.int64)[:, None] * a + c) % PRIME
                x = block["__x"].to_numpy(zero_copy_only=False)
                n = block["__n"].to_numpy(zero_copy_only=False).astype(float)
                share = block["__m"].to_numpy(zero_copy_only=False) / n
                slack = BAND * np.sqrt(share * (1 - share) / n) + BAND**2 / n
                low, high = ((share + s * slack) * PRIME for s in (-1, 1))
                inside = u < low[:, None]
                band = ~inside & (u <= high[:, None])
                codes = _group_codes(block, group)
                order = np.argsort(codes, kind="stable")
                begin = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
                counts = np.add.reduceat(inside[order].astype(float), begin, axis=0)
                sums = np.add.reduceat(np.where(inside, x[:, None], 0.0)[order], begin, axis=0)
                for at, count, added in zip(order[begin].tolist(), counts, sums, strict=True):
                    row = block.slice(at, 1)
                    name = tuple(repr(row[g][0].as_py()) for g in heads)
                    if name in held:
                        held[name][2] += count
                        held[name][3] += added
                    else:
                        held[name] = [row, row["__m"][0].as_py(), count.copy(), added.copy()]
                i, b = np.nonzero(band)
                if len(i):
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays(
                        [*[block[g].take(take) for g in heads], block["__k"].take(take), pa.array(b, pa.int32()), block["__m"].take(take).cast(pa.int32()),
                         pa.array(np.ones(len(i))), pa.array(x[i]), pa.array(u[i, b], pa.int32())], names)
                if len(held) >= room:
                    yield from certain()
        yield from certain()

    pieces = rows.mapInArrow(partial, schema)
    by = [*group, REPLICATE]
    sure = pieces.filter("__u is null").groupBy(*by).agg(F.max("__m").alias("__m"), F.sum("__count").alias("__sure"), F.sum("__sum").alias("__base"))
    near = attach(pieces.filter("__u is not null").select(*by, "__k", "__u", "__sum"), sure, by, "left")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__u", "__k"))
    picked = near.withColumn("__take", (place <= F.col("__m") - F.col("__sure")).cast("int")).groupBy(*by).agg(
        F.sum(F.col("__take") * F.col("__sum")).alias("__more"), F.sum("__take").alias("__taken"))
    out = attach(sure, picked, by, "left")
    met = F.col("__sure") + F.coalesce("__taken", F.lit(0)) == F.col("__m")
    whole = F.col("__base") + F.coalesce("__more", F.lit(0.0))
    return out.select(*by, F.when(met, whole).otherwise(F.raise_error(F.lit("a permutation's threshold lies outside its band"))).alias(name))

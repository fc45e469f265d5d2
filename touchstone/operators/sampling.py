"""Keyed samples, splits and windows: the same rows on every retry and partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.numeric import col, half_even, keyed_int
from touchstone.operators.running import Total, attach, numbered, running, with_group_totals, with_scalars
from touchstone.operators.weights import PRIME
from touchstone.settings import needs_split


def hash_sample(key, one_in: int, seed: int = 0) -> Column:
    """Keep a fixed 1-in-n of the keys, alike in every table that has the key."""
    return F.pmod(keyed_int(seed, key), F.lit(one_in)) == 0


def random_split(df, key: str, test_rows: int, seed: int = 0, name="split") -> DataFrame:
    """Exactly ``test_rows`` rows by keyed hash order are "test", the rest "train"."""
    placed = numbered(df.withColumn("__h", keyed_int(seed, key)), [], ["__h", key], "__rn")
    return placed.withColumn(name, F.when(F.col("__rn") <= test_rows, "test").otherwise("train")).drop("__h", "__rn")


def cluster_split(df, cluster: str, test_rows: int, seed: int = 0, name="split") -> DataFrame:
    """Whole clusters in keyed hash order are "test" until their rows reach ``test_rows``."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", keyed_int(seed, cluster))
    before = running(sizes, [], ["__h", cluster], [Total("__b", "__n")])
    side = before.select(cluster, F.when(F.coalesce("__b", F.lit(0)) < test_rows, "test").otherwise("train").alias(name))
    return df.join(side, cluster)


def stratified_sample(df, key: str, label: str, rows: int, seed: int = 0, split="auto") -> DataFrame:
    """About ``rows`` rows with each class in proportion: half-even(rows * share) of each."""
    if split == "auto":
        split = needs_split(df, [label])
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    out = with_group_totals(df.withColumn("__h", keyed_int(seed, key)), [label], {"__n": F.count(F.lit(1))}, split)
    out = numbered(with_scalars(out, total), [label], ["__h", key], "__rn", split)
    quota = half_even(F.lit(float(rows)) * F.col("__n") / F.col("__all"))
    return out.filter((F.col("__rn") <= quota) | (F.col("__all") <= rows)).drop("__h", "__n", "__all", "__rn")


def top_up_sample(df, key: str, cell: str, per_cell: int, existing: Column, seed: int = 0, split="auto") -> DataFrame:
    """Up to ``per_cell`` rows per cell: all existing picks, then others by keyed hash."""
    rows = df.withColumn("__e", existing.cast("int")).withColumn("__h", keyed_int(seed, key))
    placed = numbered(rows, [cell], [("__e", "desc"), "__h", key], "__rn", split)
    return placed.filter((F.col("__rn") <= per_cell) | (F.col("__e") == 1)).drop("__e", "__h", "__rn")


ROUNDS = 4
_SLOTS = 4096  # draws of a group that one row stands for before they are spelled out


def feistel_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and shift of each round, as :func:`keyed_int` of (seed, "f" or "o", round)."""
    draw = lambda *parts: int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:15], 16)
    return [(draw(seed, "f", r) % (PRIME - 1) + 1, draw(seed, "o", r) % PRIME) for r in range(ROUNDS)]


def _permuted(seed: int):
    """Place of each number below ``n`` in a keyed permutation of 0 .. n - 1."""
    keys = feistel_keys(seed)

    @F.pandas_udf("long")
    def walk(x: pd.Series, n: pd.Series, tweak: pd.Series) -> pd.Series:
        out, size, add = x.to_numpy(np.int64).copy(), n.to_numpy(np.int64), tweak.to_numpy(np.int64)
        half = np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2).astype(np.int64)
        half += (np.int64(1) << (2 * half)) < size  # rounding of the logarithm
        left = np.arange(len(out))
        while len(left):  # cycle walking: a number that leaves the range goes through again until it is back
            h = half[left]
            a, b = out[left] >> h, out[left] & ((np.int64(1) << h) - 1)
            for by, off in keys:
                a, b = b, a ^ ((b * by + (off + add[left]) % PRIME) % PRIME & ((np.int64(1) << h) - 1))
            out[left] = (a << h) | b
            left = left[out[left] >= size[left]]
        return pd.Series(out)

    return walk


def sample_pairs(df, key: str, pairs: int, group: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(group, a, b): exactly min(``pairs``, all) distinct pairs a < b of each group.

    Draw i is place i of a keyed permutation of the group's pair numbers (a Feistel network with cycle walking), so no draw
    repeats and none is thrown away, at any size of group.  Pair numbers are unranked to two row numbers and joined back:
    work grows with the number of pairs asked for, never with all pairs.  Up to 2^60 pairs a group.
    """
    group = list(group)
    placed = numbered(df.select(*group, key), group, [key], "__rn")
    sizes = placed.groupBy(*group).agg(F.max("__rn").alias("__n"))
    every = F.expr("__n * (__n - 1) div 2")
    slots = sizes.withColumn("__all", every.cast("long")).filter("__all > 0").withColumn("__want", F.least(F.col("__all"), F.lit(pairs).cast("long")))
    slots = slots.withColumn("__tweak", F.pmod(keyed_int(seed, *group), F.lit(PRIME)))
    slots = slots.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__want") - 1, F.lit(_SLOTS).cast("long"))))
    slots = slots.withColumn("__slot", F.explode(F.sequence("__from", F.least(F.col("__from") + _SLOTS, F.col("__want")) - 1)))
    drawn = slots.select(*group, _permuted(seed)("__slot", "__all", "__tweak").alias("__t"))
    # Pair number t = hi (hi - 1) / 2 + lo over 0 <= lo < hi; the root is corrected for rounding.
    root = F.floor((1 + F.sqrt(1 + 8.0 * F.col("__t"))) / 2).cast("long")
    drawn = drawn.withColumn("__root", root)
    hi = F.when(F.expr("__root * (__root - 1) div 2 > __t"), F.col("__root") - 1).when(F.expr("__root * (__root + 1) div 2 <= __t"), F.col("__root") + 1)
    drawn = drawn.withColumn("__hi", hi.otherwise(F.col("__root"))).withColumn("__lo", F.expr("__t - __hi * (__hi - 1) div 2"))
    low = placed.select(*group, (F.col("__rn") - 1).alias("__lo"), F.col(key).alias("a"))
    high = placed.select(*group, (F.col("__rn") - 1).alias("__hi"), F.col(key).alias("b"))
    out = attach(attach(drawn, low, [*group, "__lo"]), high, [*group, "__hi"])
    return out.select(*group, "a", "b")


def sample_windows(df, key: str, text, width: int, per_text: Column | int, alphabet: str = "ACGT", align: int | None = 6, frame: int = 0, seed: int = 0) -> DataFrame:
    """(key, start, window): keyed-random fixed-width windows without ambiguous letters.

    Starts are brought down to the alignment plus ``frame``.  ``per_text`` may be a column, such as
    a count in proportion to the text's length.  Repeated starts are kept once.
    """
    t, n = col(text), per_text if isinstance(per_text, Column) else F.lit(per_text)
    rows = df.select(key, t.alias("__t")).filter(F.length("__t") >= width + 2)
    rows = rows.withColumn("__i", F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))
    start = F.pmod(keyed_int(seed, key, "__i"), F.length("__t") - width)
    if align:
        start = start - start % align + frame
    out = rows.withColumn("start", start.cast("int")).filter((F.col("start") >= 0) & (F.col("start") + width <= F.length("__t")))
    out = out.select(key, "start", F.col("__t").substr(F.col("start") + 1, F.lit(width)).alias("window"))
    return out.filter(F.col("window").rlike(f"^[{alphabet}]+\\z")).dropDuplicates([key, "start"])

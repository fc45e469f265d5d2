"""Average-tie ranks, quantiles and top-k cuts inside groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from touchstone.functions.numeric import half_even
from touchstone.operators.running import Total, attach, numbered, running, with_group_totals
from touchstone.settings import SPLIT_ROWS, cut_lineage, is_small, needs_split, setting, settled


# A sort of ranks in one task takes this share of the rows that a group may have in one task.
_STRETCHES = 16


def _stretch_rows(df: DataFrame) -> int:
    return max(1, setting(df.sparkSession, SPLIT_ROWS) // _STRETCHES)


def _dealt(df: DataFrame, rows: int, by: Sequence[str]) -> DataFrame:
    """Partitioned by ``by`` into as many tasks as keep a sort of ``rows`` rows short, whatever the session's number is."""
    tasks = rows // (2 * _stretch_rows(df))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by) if by and tasks > usual else df


def rank_rows(df: DataFrame, group: Sequence[str], needed: Sequence[str] = ()) -> tuple[DataFrame, bool, bool]:
    """Rows to rank inside ``group``, whether groups are too large for one task, and whether ``needed`` is never null.

    Small inputs come back as they are, and are not looked at.  Of others, joins are settled and the sizes counted once.
    """
    if is_small(df):
        return df, False, False
    rows = settled(df)
    lacking = F.lit(False)
    for c in needed:
        lacking = lacking | F.col(c).isNull()
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"), F.sum(lacking.cast("int")).alias("__lacking"))
    most, total, missing = sizes.agg(F.max("__size"), F.sum("__size"), F.sum("__lacking")).first()
    split = (most or 0) > _stretch_rows(df)
    return rows if split else _dealt(rows, total or 0, list(group)), split, not missing


def average_ranks(
    df: DataFrame, group: Sequence[str], columns: Sequence[str], prefix="rank_", split="auto", within: Sequence[str] = (), inner="inner_",
) -> DataFrame:
    """Add ``rank_<column>`` with average-tie ranks of the non-null values inside each group; with ``within``, also
    ``inner_<column>`` with ranks inside each combination of these columns of a group.

    On the window path all columns share one shuffle by group.  On the split path a large group is cut into stretches of
    neighbouring values that are ranked apart (columns of numbers), or ranks are joined to the values.
    """
    group, levels = list(group), [*group, *within]
    if split == "auto":
        df, split, _ = rank_rows(df, group)
    if not split:
        added = {}
        for by, name in ((group, prefix), (levels, inner))[:2 if within else 1]:
            for c in columns:
                # rank() is rows before + 1; the default range frame counts up to the last tie.  Both
                # share one sort.
                order = Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last())
                added[name + c] = F.when(
                    F.col(c).isNotNull(), (F.rank().over(order) + F.count(F.lit(1)).over(order)) / F.lit(2.0)
                )
        return df.withColumns(added)
    if within and not _few_levels(df, levels):  # tables of stretches are held by every task
        return average_ranks(average_ranks(settled(df), group, columns, prefix, True), levels, columns, inner, True)
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    out = _ranks_by_stretch(df, group, numbers, prefix, list(within), inner) if numbers else df
    if within and len(numbers) < len(columns):
        out = average_ranks(out, levels, [c for c in columns if c not in numbers], inner, True)
    for c in columns:
        if c not in numbers:
            ranks = value_ranks(df, group, c, split=True).select(
                *[F.col(g).alias(f"__r_{g}") for g in group], F.col(c).alias("__r_value"), F.col("rank").alias(prefix + c)
            )
            same = F.col(c) == F.col("__r_value")
            for g in group:
                same = same & F.col(g).eqNullSafe(F.col(f"__r_{g}"))
            out = out.join(ranks, same, "left").drop("__r_value", *[f"__r_{g}" for g in group])
    return out


def _few_levels(df: DataFrame, levels: Sequence[str]) -> bool:
    return df.groupBy(*levels).agg(F.count(F.lit(1))).count() <= 1000


def _ranks_by_stretch(df: DataFrame, group: list[str], columns: list[str], prefix: str, within: list[str], inner: str) -> DataFrame:
    """Ranks where some group is too large for one task.

    Quantiles of a large group are the bounds of its stretches: a value that is a bound is a stretch of its own (odd number),
    and so are the values between two bounds (even number).  Any bounds give the same ranks, as rows before a stretch are
    counted exactly.  A row whose value is a bound has its rank from these counts, however many ties there are; the others
    are sorted within their stretch, after one shuffle for each column that has such rows.
    """
    target = _stretch_rows(df)
    rows = settled(df)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"))
    many = F.col("__size") > target
    most, few = sizes.agg(F.max("__size"), F.sum(F.when(~many, F.col("__size")))).first()
    if (most or 0) <= target:
        return average_ranks(rows, group, columns, prefix, False, within, inner)
    place = {c: f"__at_{i}" for i, c in enumerate(columns)}
    steps = max(1, min(10, math.ceil(math.log2(most / target))))
    cuts = 1 << steps
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    found = attach(rows, F.broadcast(sizes.filter(many)), group).groupBy(*group, "__size").agg(
        *[F.percentile_approx(c, shares, F.lit(max(10_000, 8 * cuts))).alias(p) for c, p in place.items()])
    # Smaller groups are cut less often.
    every = F.greatest(F.lit(1), F.floor(F.lit(cuts) * target / F.col("__size")).cast("int"))
    bounds = cut_lineage(found.select(
        *group, F.row_number().over(Window.orderBy(*(group or ["__size"]))).cast("long").alias("__cut"),
        *[F.array_sort(F.array_distinct(F.filter(p, lambda v, i: (i + 1) % every == 0))).alias(f"__b{p}") for p in place.values()]))
    out = attach(rows, F.broadcast(bounds), group, "left" if group else "inner")
    out = out.withColumns({p: F.lit(0) for p in place.values()})
    for step in (1 << k for k in reversed(range(steps))):  # binary search for the bounds not above the value
        out = out.withColumns({p: F.col(p) + F.when(F.get(f"__b{p}", F.col(p) + (step - 1)) <= F.col(c), F.lit(step)).otherwise(F.lit(0)) for c, p in place.items()})
    on_bound = {p: F.coalesce(F.get(f"__b{p}", F.col(p) - 1) == F.col(c), F.lit(False)) for c, p in place.items()}
    out = out.withColumns({p: F.when(F.col(c).isNotNull(), 2 * F.col(p) - on_bound[p].cast("int")) for c, p in place.items()})
    out = out.drop(*[f"__b{p}" for p in place.values()])
    # Rows of each stretch of the large groups, and of those before it.
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(p).alias("at")) for i, p in enumerate(place.values())]))
    seen = out.filter(F.col("__cut").isNotNull()).select("__cut", *within, each.alias("__s")).filter(F.col("__s.at").isNotNull())
    cells = cut_lineage(seen.groupBy("__cut", *within, F.col("__s.c").alias("__c"), F.col("__s.at").alias("__at")).agg(F.count(F.lit(1)).alias("__n")))
    apart = dict(cells.filter(F.col("__at") % 2 == 0).groupBy("__c").agg(F.sum("__n")).collect())
    keys = [*group, "__cut"] if few else ["__cut"]
    views = [([], prefix)] + ([(within, inner)] if within else [])
    for i, (c, p) in enumerate(place.items()):
        placed = {}
        for levels, name in views:
            n, before = f"__n{name}", f"__before{name}"
            earlier = Window.partitionBy("__cut", *levels).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
            mine = cells.filter(F.col("__c") == i).groupBy("__cut", *levels, "__at").agg(F.sum("__n").alias(n))
            mine = mine.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).withColumnRenamed("__at", p)
            out = attach(out, F.broadcast(mine), ["__cut", *levels, p], "left")
            out = out.withColumn(name + c, F.col(before) + (F.col(n) + 1) / F.lit(2.0)).drop(n)
            placed[name] = (levels, before)
        if few or apart.get(i):
            # Rows that need no sort are dealt out evenly.
            ready = F.col(c).isNull() | (F.col("__cut").isNotNull() & (F.col(p) % 2 == 1))
            out = out.withColumn("__deal", F.when(ready, F.pmod(F.xxhash64(*columns), F.lit(1 << 12))).otherwise(F.lit(-1)))
            by = [*keys, p, "__deal"]
            out = _dealt(out, (apart.get(i) or 0) + (few or 0), by)
            for name, (levels, before) in placed.items():
                order = Window.partitionBy(*by, *levels).orderBy(c)
                local = (F.rank().over(order) + F.count(F.lit(1)).over(order)) / F.lit(2.0)
                out = out.withColumn(name + c, F.when(ready, F.col(name + c)).otherwise(F.coalesce(before, F.lit(0)) + local))
            out = out.drop("__deal")
        out = out.withColumns({name + c: F.when(F.col(c).isNotNull(), F.col(name + c)) for name in placed}).drop(*[b for _, b in placed.values()])
    return out.drop("__cut", *place.values())


def value_counts(df, group, value: str, weights: dict | None = None) -> DataFrame:
    """Counts (or weight sums) per distinct non-null value: the histogram ranks are made from."""
    aggregates = weights or {"n": F.count(F.lit(1))}
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(*[agg.alias(name) for name, agg in aggregates.items()])
    )


def value_ranks(df, group, value: str, split="auto", fanout=1) -> DataFrame:
    """One row per distinct value with its count ``n``, rows ``before`` it and average ``rank``."""
    hist = value_counts(df, group, value)
    out = running(hist, group, [value], [Total("before", "n")], split, fanout)
    out = out.withColumn("before", F.coalesce("before", F.lit(0)))
    return out.withColumn("rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0))


def group_quantiles(
    df, group: Sequence[str], value: str, probs: dict[str, float], split="auto", fanout=1
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of ``probs``.

    The built-in exact aggregate keeps every distinct value of a group in one buffer; groups
    too large for that are cut from running counts instead.
    """
    group = list(group)
    if split == "auto":
        split = needs_split(df, group, fanout * max(1, len(probs)))
    if not split:  # one buffer for all of them
        held = df.groupBy(*group).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("__held"))
        return held.select(*group, *[F.get("__held", F.lit(i)).alias(name) for i, name in enumerate(probs)])
    placed = value_ranks(df, group, value, split=True)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("__total"))
    placed = attach(placed, sizes, group)
    aggregates = []
    for name, p in probs.items():
        position = (F.col("__total") - 1) * F.lit(float(p))
        for tag, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
            aggregates.append(F.max(F.when(inside, F.col(value))).alias(f"__{tag}_{name}"))
    out = placed.groupBy(*group, "__total").agg(*aggregates)
    for name, p in probs.items():
        position = (F.col("__total") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out = out.withColumn(name, low + (high - low) * (position - F.floor(position)))
    return out.select(*group, *probs)


def percent_rank(df, group, value: str, name="pct_rank", split="auto") -> DataFrame:
    """(minimum rank - 1) / (n - 1) per distinct value."""
    ranks = value_ranks(df, group, value, split)
    out = with_group_totals(ranks, group, {"__n": F.sum("n")}, split=False)
    return out.withColumn(name, F.coalesce(F.try_divide(F.col("before"), F.col("__n") - 1), F.lit(0.0))).drop("__n")


def top_flags(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    cuts: dict[str, str],
    size,
    split="auto",
    total_name="n_rows",
) -> DataFrame:
    """Add boolean columns that mark each group's top rows.

    ``cuts`` maps a new flag to the column it ranks (descending, ties by ascending ``key``);
    ``size`` is a function from the row-count column to the number of rows kept.
    """
    group = list(group)
    if split == "auto":
        split = needs_split(df, group)
    out = with_group_totals(df, group, {total_name: F.count(F.lit(1))}, split)
    for flag, column in cuts.items():
        out = numbered(out, group, [(column, "desc"), key], "__rn", split)
        out = out.withColumn(flag, F.col("__rn") <= size(F.col(total_name))).drop("__rn")
    return out


def top_k(df, group, key, value, k: int, split="auto") -> DataFrame:
    """The k best rows of each group with their place; whole-table top-k when group is empty."""
    if not group:
        kept = df.orderBy(F.col(value).desc(), F.col(key).asc()).limit(k)
        return kept.withColumn("place", F.row_number().over(Window.orderBy(F.col(value).desc(), F.col(key).asc())))
    out = numbered(df, group, [(value, "desc"), key], "place", split)
    return out.filter(F.col("place") <= k)


def quantile_warp(df, group, value: str, name="warped", split="auto") -> DataFrame:
    """Inverse normal of average rank / (n + 1)."""
    from touchstone.functions.numeric import inverse_normal

    group = list(group)
    if split == "auto":
        df, split, _ = rank_rows(df, group)
    out = average_ranks(df, group, [value], "__w_", split)
    out = with_group_totals(out, group, {"__n": F.count(value)}, split)
    return out.withColumn(name, inverse_normal(F.col(f"__w_{value}") / (F.col("__n") + 1))).drop(f"__w_{value}", "__n")


def share(fraction: float, floor: int = 1):
    """Size function for ``top_flags``: max(floor, half-even(fraction * n))."""
    return lambda n: F.greatest(F.lit(floor).cast("long"), half_even(F.lit(fraction) * n))

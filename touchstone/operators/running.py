"""Running totals along an order inside groups of any size.

This is the primitive under ranks, quantiles, operating points, top-k cuts, island numbering
and p-value adjustment.  Small groups are one window.  If a group may exceed what one task
should sort, rows are range-partitioned on (group, order), the partition number is fixed by a
reliable checkpoint, and each partition adds the totals of the earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchstone.settings import cut_lineage, needs_split

_PART = "__part"


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """One column name per stem that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, i = f"__{stem}", 0
        while name.lower() in taken:
            i += 1
            name = f"__{stem}_{i}"
        taken.add(name.lower())
        out.append(name)
    return out


@dataclass(frozen=True)
class Total:
    """A running aggregate named ``name``; ``op`` is sum, min or max of column ``source``."""

    name: str
    source: str
    op: str = "sum"
    inclusive: bool = False


def ordering(order: Sequence[str | tuple[str, str]]) -> list[Column]:
    """``["a", ("b", "desc")]`` as sort columns."""
    out = []
    for item in order:
        name, way = (item, "asc") if isinstance(item, str) else item
        out.append(F.col(name).desc() if way == "desc" else F.col(name).asc())
    return out


def _aggregate(op: str, column: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max}[op](column)


def _merge(op: str, earlier: Column, here: Column) -> Column:
    if op == "sum":
        return F.coalesce(earlier + here, earlier, here)
    return F.least(earlier, here) if op == "min" else F.greatest(earlier, here)


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | tuple[str, str]],
    totals: Sequence[Total],
    split: bool | str = "auto",
    fanout: int = 1,
) -> DataFrame:
    """Add one column per total; an exclusive total over no rows is null.

    The order must be total inside a group.  ``split`` is "auto", or True/False where the
    caller has already checked the size of the largest group.
    """
    group = list(group)
    if split == "auto":
        split = needs_split(df, group, fanout)
    if not split:
        base = Window.partitionBy(*group).orderBy(*ordering(order))
        return df.withColumns({t.name: _aggregate(t.op, F.col(t.source)).over(_frame(base, t)) for t in totals})
    return _running_split(df, group, order, totals)


def _frame(base, total: Total):
    return base.rowsBetween(Window.unboundedPreceding, 0 if total.inclusive else -1)


def _running_split(df, group, order, totals):
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *[F.col(g) for g in group], *ordering(order)).withColumn(
            _PART, F.spark_partition_id()
        )
    )
    # Ranges are contiguous in (group, order): a partition can open with at most one group begun
    # earlier, so the offsets below have fewer rows than there are partitions.
    here = placed.groupBy(_PART, *group).agg(*[_aggregate(t.op, F.col(t.source)).alias(t.name) for t in totals])
    before = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        here.withColumn("__first", F.min(_PART).over(Window.partitionBy(*group)))
        .withColumns({f"__off_{t.name}": _aggregate(t.op, F.col(t.name)).over(before) for t in totals})
        .filter(F.col(_PART) > F.col("__first"))
        .select(
            F.col(_PART).alias("__opart"),
            *[F.col(g).alias(f"__o_{g}") for g in group],
            *[f"__off_{t.name}" for t in totals],
        )
    )
    local = Window.partitionBy(_PART, *group).orderBy(*ordering(order))
    out = placed.withColumns({t.name: _aggregate(t.op, F.col(t.source)).over(_frame(local, t)) for t in totals})
    same = F.col(_PART) == F.col("__opart")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    out = out.join(F.broadcast(offsets), same, "left")
    return out.withColumns(
        {t.name: _merge(t.op, F.col(f"__off_{t.name}"), F.col(t.name)) for t in totals}
    ).drop(_PART, "__opart", *[f"__o_{g}" for g in group], *[f"__off_{t.name}" for t in totals])


def numbered(df, group, order, name="rn", split="auto", fanout=1) -> DataFrame:
    """``row_number`` inside each group, for groups of any size."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    out = running(one, group, order, [Total(name, "__one", inclusive=True)], split, fanout)
    return out.drop("__one")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (a global aggregate) to every row."""
    return df.join(F.broadcast(one_row), how="cross")


def attach(df: DataFrame, totals: DataFrame, group, how: str = "inner") -> DataFrame:
    """Join per-group results back by null-safe group columns; one row when group is empty."""
    group = list(group)
    if not group:
        return with_scalars(df, totals)
    names = [c for c in totals.columns if c not in group]
    totals = totals.select(*[F.col(g).alias(f"__t_{g}") for g in group], *names)
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__t_{g}"))
    return df.join(totals, same, how).drop(*[f"__t_{g}" for g in group])


def with_group_totals(df, group, aggregates: dict[str, Column], split: bool = False) -> DataFrame:
    """Add per-group aggregates to every row.

    Without ``split`` this is a window, which reuses the partitioning of the windows around it;
    with ``split`` the totals are aggregated first and joined back, so that a group that holds
    much of the table is never one task (the join side is one row per group).
    """
    group = list(group)
    if not split:
        w = Window.partitionBy(*group)
        return df.withColumns({name: agg.over(w) for name, agg in aggregates.items()})
    totals = df.groupBy(*group).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return attach(df, totals, group, "left" if group else "inner")


def longest_runs(df, group, order, flag: str, name="longest_run", split="auto") -> DataFrame:
    """Longest stretch of consecutive rows with ``flag`` false, per group (gaps and islands)."""
    marked = df.withColumn("__hit", F.when(F.col(flag), 1).otherwise(0).cast("long"))
    islands = running(marked, group, order, [Total("__island", "__hit", inclusive=True)], split)
    sizes = islands.groupBy(*group, "__island").agg(F.sum(1 - F.col("__hit")).alias("__size"))
    return sizes.groupBy(*group).agg(F.max("__size").alias(name))


def islands_by_gap(df, group, start: str, end: str, gap, name="cluster", split="auto") -> DataFrame:
    """Number single-linkage clusters of intervals: a new one opens past the running end + gap.

    ``start`` and ``end`` are numeric columns.  Ties on start are broken by end.
    """
    seen = running(df, group, [start, end], [Total("__reach", end, "max")], split)
    opened = seen.withColumn(
        "__opens",
        F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + F.lit(gap)), 1).otherwise(0).cast("long"),
    )
    out = running(opened, group, [start, end], [Total(name, "__opens", inclusive=True)], split)
    return out.drop("__reach", "__opens")

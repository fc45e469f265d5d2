"""Extension points: scorers, baseline orientation, reference checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.edits import agrees


def score_distinct(df: DataFrame, text: str, scorer: Callable[[Column], Column], name: str = "score") -> DataFrame:
    """Add ``scorer(text)``, computed once per distinct text and joined back.

    ``scorer`` maps a Column to a Column: a plain expression, or a ``pandas_udf`` that wraps a
    model.  Worth it for costly scorers; the rows move by a digest of the text, and copies of a
    frequent text are split over tasks by the adaptive skew join.
    """
    keyed = df.withColumn("__digest", F.md5(text))
    distinct = keyed.groupBy("__digest").agg(F.any_value(text).alias("__text"))
    scored = distinct.select("__digest", scorer(F.col("__text")).alias(name))
    return keyed.join(scored, "__digest", "left").drop("__digest")


def oriented(df: DataFrame, signs: dict[str, int]) -> DataFrame:
    """Baselines multiplied by their a-priori sign, so that larger means better for every column."""
    bad = [s for s in signs.values() if s not in (-1, 1)]
    if bad:
        raise ValueError(f"signs must be -1 or 1, got {bad}")
    return df.withColumns({c: F.col(c) * F.lit(s) for c, s in signs.items()})


def validate_reference(df: DataFrame, targets: DataFrame, unit: Sequence[str], edits: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """(rows, drops): rows whose stated letters all agree with their unit's reference; drops per unit."""
    unit = list(unit)
    joined = df.join(targets.select(*unit, reference), unit, "left")
    ok = F.coalesce(agrees(reference, edits), F.lit(False))
    marked = joined.withColumn("__ok", ok)
    drops = marked.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("__ok")).cast("long")).alias("dropped"))
    return marked.filter("__ok").drop("__ok"), drops


def combine_metrics(ranked: DataFrame, group: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """Metric plug-in: several aggregate expressions over one ranked table in a single pass."""
    return ranked.groupBy(*group).agg(*[m.alias(n) for n, m in metrics.items()])

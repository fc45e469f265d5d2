"""Effects inside quantile bins of another column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.functions.numeric import finite
from touchstone.operators.hypothesis import wilcoxon_signed
from touchstone.operators.ranks import group_quantiles
from touchstone.operators.running import attach


def quantile_bin_effects(df, by: str, effect: str, bins: int = 4, group: Sequence[str] = (), split="auto") -> DataFrame:
    """Mean effect and signed-rank test per quantile bin of ``by``.

    Bins are [edge, next edge), the last closed; collapsed edges drop their bin.
    """
    group = list(group)
    rows = df.filter(finite(by) & finite(effect))
    edges = group_quantiles(rows, group, by, {f"__q{i}": i / bins for i in range(bins + 1)}, split)
    rows = attach(rows, edges, group)
    place = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        upper = F.col(by) <= F.col(f"__q{i + 1}") if i == bins - 1 else F.col(by) < F.col(f"__q{i + 1}")
        place = F.when((F.col(f"__q{i}") < F.col(f"__q{i + 1}")) & (F.col(by) >= F.col(f"__q{i}")) & upper, F.lit(i + 1)).otherwise(place)
    rows = rows.withColumn("bin", place).filter("bin IS NOT NULL")
    means = rows.groupBy(*group, "bin").agg(F.avg(effect).alias("mean_effect"))
    return attach(wilcoxon_signed(rows, effect, [*group, "bin"], split=split), means, [*group, "bin"], "left")

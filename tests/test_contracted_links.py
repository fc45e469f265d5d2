"""Links between numbers are contracted where they are read: few of them move, and components are those of a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchstone.operators import graph as gp

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def plain(links):
    root = {v: v for ab in links for v in ab}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def drawn(seed, nodes, links):
    ab = np.random.default_rng(seed).integers(-nodes, nodes, (links, 2)).tolist()
    return [(a, b) for a, b in ab if a != b]


@pytest.mark.parametrize("lot,last", [(1 << 21, 1 << 20), (7, 1 << 20), (7, 5), (1, 0)])
@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(60)], drawn(2, 40, 300), drawn(3, 400, 150)])
def test_components_of_any_lots(spark, monkeypatch, links, lot, last):
    monkeypatch.setattr(gp, "_LAST", last)
    monkeypatch.setattr(gp, "_LINKS", lot)
    edges = spark.createDataFrame([*links, (5, 5), (None, 3), (3, None)], "src bigint, dst int").repartition(3)
    usual = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(lot, int(usual))))
    try:
        got = gp.connected_components(edges).collect()
    finally:
        spark.conf.set(BATCH, usual)
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == plain(links)


def test_few_links_are_left_to_move(spark, monkeypatch):
    """2,000 orders in lots of their own that share hubs: the links between lots are as many as lots, not as links."""
    left = []

    def counted(df, cut=gp.cut_lineage):
        left.append(cut(df))
        return left[-1]

    monkeypatch.setattr(gp, "cut_lineage", counted)
    edges = spark.range(0, 10_000, 1, 4).select((F.col("id") / 5).cast("int").alias("src"), (F.col("id") % 49 + 5000).cast("int").alias("dst"))
    out = gp.connected_components(edges)
    assert out.schema.simpleString() == "struct<node:int,component:int>"
    assert out.groupBy("component").count().collect()[0]["count"] == 2049
    assert max(df.count() for df in left) <= 8

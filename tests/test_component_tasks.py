"""Links of a graph are dealt to as many tasks as their number asks for, whatever the session's number of partitions."""

import pytest

from touchstone.operators import graph as gp
from touchstone.settings import tasks_for

PARTITIONS = "spark.sql.shuffle.partitions"
JOINED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_large_graphs_get_more_tasks(spark, split, monkeypatch):
    usual, seen = spark.conf.get(PARTITIONS), []

    def spy(df, cut=gp.cut_lineage):
        seen.append(int(spark.conf.get(PARTITIONS)))
        return cut(df)

    monkeypatch.setattr(gp, "cut_lineage", spy)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 4)] + [(0, 100), (4, 100), (0, 100), (7, 7)], "src bigint, dst bigint")
    got = {(r.node, r.component) for r in gp.connected_components(edges).collect()}
    assert got == {(0, 0), (1, 0), (4, 0), (5, 0), (100, 0)} | {(i + j, i) for i in range(8, 40, 4) for j in (0, 1)}
    assert max(seen) == 26 > int(usual)  # 13 links that are no loops, in both directions
    assert spark.conf.get(PARTITIONS) == usual


def test_the_sessions_number_comes_back_after_an_error(spark):
    usual, joined = spark.conf.get(PARTITIONS), spark.conf.get(JOINED)
    with pytest.raises(RuntimeError), tasks_for(spark, 10**9):
        assert int(spark.conf.get(PARTITIONS)) == 1600
        raise RuntimeError
    assert (spark.conf.get(PARTITIONS), spark.conf.get(JOINED)) == (usual, joined)

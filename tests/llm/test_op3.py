"""Graph search against brute force: recall, scores, ties, copies, vectors that take no part."""

import numpy as np
import pytest

from touchstone.llm import pruned_graph
from touchstone.llm.pruned_graph import neighbours
from touchstone.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(ids, x, every=20, k=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def recall(got, want):
    return np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / max(1, len(want[q])) for q in want])


def test_query_recall(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.values, np.stack(rows.embedding.values).astype(float)
    got, want = answers(QUERIES["op3_pruned_graph"](spark, FOLDER)), brute(ids, x)
    assert set(got) == set(want)
    assert recall(got, want) >= 0.95
    at = {int(i): v for i, v in zip(ids, x, strict=True)}
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(s == pytest.approx(float(at[q] @ at[v]), abs=1e-12) for _, v, s in rows)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rows, rows[1:], strict=False))


def test_many_shards_uneven_norms(spark, monkeypatch):
    monkeypatch.setattr(pruned_graph, "SHARD_ROWS", 150)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 12)) * rng.lognormal(0, 0.7, (800, 1))
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    assert recall(answers(neighbours(df)), brute(np.arange(800), x)) >= 0.95


def test_copies_and_ties(spark):
    x = [[1.0, 0.0]] * 300 + [[0.5, 0.5]] * 30 + [[-1.0, 0.0]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)] + [(0, x[0], 1)], SCHEMA).repartition(7)
    got, want = answers(neighbours(df)), brute(np.arange(len(x)), np.array(x))
    assert {q: [(v, s) for _, v, s in rows] for q, rows in got.items()} == want


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 0), (20, None, 0), (40, [0.0, 0.0], 0), (60, [1.0, None], 0), (80, [float("nan"), 1.0], 0), (100, [float("inf"), 1.0], 0),
            (None, [1.0, 1.0], 0), (1, [2.0, 1.0], 0), (2, [1.0, 2.0, 3.0], 0), (120, [], 0), (140, [3.0, 3.0, 3.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as shard", "'x' as raw")
    assert answers(neighbours(df)) == {0: [(1, 1, 4.0)], 140: [(1, 2, 18.0)]}
    assert neighbours(df.limit(0)).collect() == []

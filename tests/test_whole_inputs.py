"""Driver queries read the whole of their inputs."""

import random

from touchstone.plans.catalog import QUERIES


def vectors(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_vector_map_reads_every_component(spark, tmp_path):
    """Only component 64 moves, and only component 32 tells how."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x = rng.gauss(0, 1)
        rows.append((i, [0.0] * 31 + [x] + [0.0] * 31 + [2 * x], i % 3))
    got = QUERIES["vector_map_eval"](spark, vectors(spark, tmp_path, rows)).collect()
    assert len(got) == 3 and all(r.explained > 0.9 for r in got)


def test_triple_scoring_reads_every_component(spark, tmp_path):
    """Classes differ in components 33 to 64 only."""
    rng = random.Random(2)
    rows = [(i, [0.0] * 32 + [10.0 * (i % 10 * 7 % 10) + rng.gauss(0, 0.3) for _ in range(32)], i % 10) for i in range(300)]
    got = QUERIES["triple_scoring"](spark, vectors(spark, tmp_path, rows)).first()
    assert got.top1 > 0.5

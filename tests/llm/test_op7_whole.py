"""Toxicity: wording that is rarer than a long toxic boilerplate still counts."""

import random
import zlib

from touchstone.llm.nb_linear import toxicity

WORDS = "the and of with river stone walking house where".split()


def test_rare_wording_beside_frequent_boilerplate(spark, documents):
    rng = random.Random(8)
    boilerplate = "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz ") for _ in range(6000))
    rows, labels = [], []
    for i in range(600):
        bad, rare = i % 4 == 0, i % 20 == 0
        tail = " scum trash moron" if rare else f" {boilerplate}" if bad else ""
        rows.append((i, " ".join(rng.choice(WORDS) for _ in range(40)) + tail, "en", "s"))
        labels.append((i, 1, int(bad)))
    got = toxicity(documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    rare = [r.predicted for r in held if r.doc_id % 20 == 0]
    assert len(rare) >= 5 and sum(rare) == len(rare)
    assert not any(r.predicted for r in held if r.doc_id % 4)

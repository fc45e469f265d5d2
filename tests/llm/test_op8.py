"""Jaccard join against brute force."""

import itertools
import random
import re

import pytest

from touchstone.llm.queries import QUERIES
from touchstone.llm.shingle_product import jaccard_components, one_per_group

SMALL = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def answer(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near_copies(seed, groups=6, most=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows, i = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((i, " ".join(text) + (" " + passage if rng.random() < 0.4 else "")))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies(documents, seed):
    rows = near_copies(seed)
    assert answer(jaccard_components(documents(rows))) == brute(rows)


def test_small_batches_link_across_stars(spark, documents):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = near_copies(9, groups=3, most=30)
        assert answer(jaccard_components(documents(rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert answer(QUERIES["op8_shingle_product"](spark, SMALL)) == brute(rows)


def test_edges(documents):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (3, "a b"), (2, "A  b"), (9, "a b"), (1, long), (8, long + " tail"), (4, "a b c d e")]
    df = documents(rows, extra=True)
    assert answer(jaccard_components(df)) == brute(rows)
    assert answer(jaccard_components(df.limit(0))) == []
    kept = one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6, 7]


def test_ids_missing_or_repeated(documents):
    got = jaccard_components(documents([(None, "p q r s t u"), (None, "p q r s t u"), (4, "p q r s t u"), (None, "alone in here"),
                                        (7, "one two"), (7, "three four"), (8, "three four")]))
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == sorted(
        [(None, 2, 4), (None, 2, 4), (4, 2, 4), (None, 1, None), (7, 1, 7), (7, 1, 7), (8, 1, 7)], key=str)

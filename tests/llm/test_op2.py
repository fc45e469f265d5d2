"""Mixing: targets against plain water filling, takings near targets, reruns, odd inputs."""

import re

import pytest

from touchstone.llm.pivotal import GROUP_ROWS, copies, mixed_documents, op2
from touchstone.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    sums = {}
    for _, t, _, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    fixed = {}
    while True:
        left, w = sum(sums.values()) - sum(fixed.values()), sum(weight[s] for s in order if s not in fixed)
        full = {s: 3 * sums[s] for s in order if s not in fixed and 3 * sums[s] <= left * weight[s] / w} if w else {}
        if not full:
            return {s: fixed.get(s, left * weight[s] / w if w else 0) for s in order}, sums
        fixed |= full


def check(rows, df):
    want, sums = targets(rows)
    got = df.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, _, _ in rows)
    source = {i: s for i, _, _, s in rows}
    taken, most = {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sums[s] and r.taken <= 3 * r.size
        taken[s], most[s] = taken.get(s, 0) + r.taken, max(most.get(s, 0), r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6


def test_query_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(rows, QUERIES["op2_pivotal_mix"](spark, SMALL))


def test_a_source_of_several_levels_and_reruns(documents, monkeypatch):
    monkeypatch.setattr("touchstone.llm.pivotal.GROUP_ROWS", 8)
    monkeypatch.setattr("touchstone.llm.pivotal.FAN_IN", 4)
    rows = [(i, "w " * (1 + i * 7 % 23), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    first = op2(documents(rows))
    check(rows, first)
    again = op2(documents(rows[::-1]).repartition(5))
    assert sorted(tuple(r) for r in first.collect()) == sorted(tuple(r) for r in again.collect())
    assert GROUP_ROWS > 8


def test_edges(documents):
    rows = [(1, None, "en", None), (2, "", "en", "a"), (3, "one two", "en", "b"), (4, "x " * 20_000, "en", "é"), (5, "three", "en", None),
            (6, "w w w", "en", "b"), (7, " \t\n", "en", "empty")]
    df = documents(rows, extra=True)
    check(rows, op2(df))
    assert op2(df.limit(0)).collect() == []
    assert {r.taken for r in op2(documents([(1, None, "en", "a"), (2, "", "en", "b")])).collect()} == {0}


def test_the_mix_repeats_documents(documents):
    rows = [(i, f"text number {i}", "en", "abc"[i % 3]) for i in range(60)] + [(7, "text number 7", "en", "b")]
    df = documents(rows, extra=True)
    want = {}
    for r in copies(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    mix = mixed_documents(df)
    assert mix.columns == df.columns
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}

"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re

from test_op2 import check as check_mix
from test_op2 import size
from test_op6 import check as check_packing
from test_op8 import brute as brute_components

import corpus_pipeline
from touchstone.llm.common import settle
from touchstone.llm.nb_linear import toxicity
from touchstone.llm.pivotal import op2

SMALL = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, first = docs.columns, docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SMALL))
        assert docs.columns == columns
        kept.append(docs)
    toxic, lines, near, mix = kept

    scores = toxicity(first, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert sorted(r.doc_id for r in toxic.collect()) == sorted(r.doc_id for r in scores.where("predicted = 0").collect())

    rows = {r.doc_id: r.text for r in toxic.collect()}
    found = {}
    for text in rows.values():
        for key in {lower(x.strip(SPACES)) for x in (text or "").split("\n")} - {""}:
            found[key] = found.get(key, 0) + 1
    want = {i: "\n".join(x for x in (t or "").split("\n") if found.get(lower(x.strip(SPACES)), 0) < 10) for i, t in rows.items()}
    after = {r.doc_id: r for r in lines.collect()}
    assert {i: r.text or "" for i, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())

    groups = brute_components([(i, r.text) for i, r in after.items()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, _, root in groups if i == root)

    own = [(r.doc_id, r.text, r.lang, r.source) for r in near.collect()]
    taken = op2(near)
    check_mix(own, taken)
    times = {}
    for r in mix.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    sizes = {i: size(t) for i, t, _, _ in own}
    assert {r.doc_id: r.taken for r in taken.collect() if r.taken} == {i: n * sizes[i] for i, n in times.items() if sizes[i]}

    check_packing([(r.doc_id, r.text) for r in mix.collect()], corpus_pipeline.STAGES[-1][1](spark, mix, SMALL))


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0

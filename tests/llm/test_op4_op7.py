"""Language and toxicity: held-out accuracy, inputs that must not count, odd texts."""

import random
import zlib

import numpy as np
import pytest

from touchstone.llm.nb_linear import toxicity, without_toxic
from touchstone.llm.output_codes import codewords, language
from touchstone.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
WORDS = {
    "en": "the and of with river stone walking house where", "de": "und der nicht straße über gegangen häuser wann",
    "fr": "est les pas être maison où rivière très marché", "es": "el los niño casa dónde río está muy señor", "it": "gli che perché città andato sono degli",
    "nl": "het een niet huis waar gegaan zijn wij", "pl": "się jest nie gdzie dom był rzeka która",
}


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language_query(spark):
    got = QUERIES["op4_output_codes"](spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(got)
    assert (both.held_out == both.doc_id.map(lambda i: crc(i) % 5 == 0)).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert both.score.between(0, 1).all() and both.ambiguous.mean() < 0.1


def test_more_languages_than_an_exhaustive_code(documents):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, 30), lang, "s") for i, lang in enumerate(list(WORDS) * 40)]
    got = {r.doc_id: r for r in language(documents(rows)).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if crc(i) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 8, 30):
        code = codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 4 else 2)
        assert (np.abs(code.sum(0)) < n).all()


def test_language_edges(documents):
    rng = random.Random(4)
    rows = [(i, text(rng, "en" if i % 2 else "de", 20), "en" if i % 2 else "de", "s") for i in range(60)]
    odd = [(100, None, "en", "s"), (101, "", "en", "s"), (102, "12 34 !!", "de", "s"), (103, text(rng, "de", 40_000), None, "s"), (None, text(rng, "en", 9), "en", "s"),
           (104, "ÉÀ", None, "s"), (4, rows[4][1], "de", "s")]
    df = documents(rows + odd, extra=True)
    got = language(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows + odd)
    assert [by[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "en"] and by[100].score == 0
    assert by[104].lang_pred in ("en", "de")
    assert language(df.limit(0)).collect() == []
    assert {r.lang_pred for r in language(documents([(1, "no language known", None, "s")])).collect()} == {"und"}


def test_prediction_ignores_language_and_source(documents):
    rng = random.Random(5)
    rows = [(i, text(rng, "en" if i % 2 else "de", 20), "en" if i % 2 else "de", "s") for i in range(60)]
    held = [r for r in rows if crc(r[0]) % 5 == 0]
    assert held
    other = [(i, t, "fr" if crc(i) % 5 == 0 else lang, "elsewhere") for i, t, lang, _ in rows]
    a, b = ({r.doc_id: r.lang_pred for r in language(documents(x)).collect()} for x in (rows, other))
    assert a == b


def test_toxicity_query(spark):
    got = QUERIES["op7_nb_linear"](spark, LARGER).toPandas()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 3 == 1)).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert toxic.predicted.mean() >= 0.9 and clean.predicted.mean() <= 0.01
    wins = (toxic.score.values[:, None] > clean.score.values[None, :]).mean()
    assert wins > 0.97


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, text(rng, "en", 30) + (" scum trash moron" if bad else ""), "en", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_edges(spark, documents):
    rows, labels = toxic_rows(random.Random(6), 200)
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, "scum trash moron " * 9000, "en", "s"), (None, "the house", "en", "s"), (3, rows[3][1], "en", "s")]
    labels += [(3, None, None), (None, 1, 1), (5, 1, 0), (999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    df = documents(rows, extra=True)
    got = toxicity(df, marks).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[500].score == by[501].score
    assert by[502].predicted == 1 and by[500].predicted == 0
    kept = without_toxic(df, marks)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    assert toxicity(df.limit(0), marks).collect() == []
    none = toxicity(df, marks.limit(0)).collect()
    assert [r.score for r in none] == pytest.approx([0.5] * len(rows)) and {r.predicted for r in none} == {0}


def test_held_out_labels_do_not_teach(spark, documents):
    rows, labels = toxic_rows(random.Random(7), 200)
    other = [(i, q, 1 - t if crc(i) % 3 == 1 else t) for i, q, t in labels]
    a, b = ({r.doc_id: round(r.score, 9) for r in toxicity(documents(rows), spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect()}
            for x in (labels, other))
    assert a == b

"""License scans: brute force of the base phrases, planted notices, edge cases."""

import random
import re

from pyspark.sql import functions as F

from touchstone.llm.diagonal_votes import NOTICES, PHRASES, license_labels, license_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places, labels = [], set()
    for label, phrase in PHRASES:
        p = phrase.split(" ")
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_base_phrases_against_brute_force(spark, documents):
    rng = random.Random(5)
    vocabulary = ["under", "the", "mit", "license", "Apache", "LICENSE,", "version", "2", "2.0", "cc", "BY", "nc", "-", "été", "x\n"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["Under the MIT License. under\tthe mit-license", "CC BY-NC CC BY-NC", "cc by nc" * 3, "apache license version 20", None, ""]
    got = rows(license_labels(documents(list(enumerate(texts)))))
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) == bool(r["n_base"]) or not r["n_base"]


def test_notices_with_words_changed_are_found(spark, documents):
    texts = []
    for label, notice in NOTICES:
        words = notice.split(" ")
        middle = len(words) // 2
        texts += [notice.title(), "x y " + " ".join([*words[:middle], "inserted", *words[middle:]]) + " z",
                  " ".join(reversed(words)), " ".join(words[:3])]
    got = rows(license_labels(documents(list(enumerate(texts)))))
    for i, (label, notice) in enumerate(NOTICES):
        whole, changed, backwards, head = (got[4 * i + j] for j in range(4))
        words = notice.split(" ")
        assert label in whole["labels"].split(",") and whole["score"] == 1.0
        if len(words) > 8:
            assert label in changed["labels"].split(",") and (0.5 < changed["score"] < 1 or changed["n_base"])
        assert backwards["labels"] == "" and backwards["score"] == 0
        assert label not in head["labels"].split(",") or len(words) <= 5


def test_spans_have_places(spark, documents):
    text = "one two " + NOTICES[6][1] + " three"
    span = [r for r in license_spans(documents([(7, text)])).collect() if r["label"] == "bsd"]
    assert [(s["doc_id"], s["start"], s["end"]) for s in span] == [(7, 2, 2 + len(NOTICES[6][1].split(" ")))]
    assert span[0]["coverage"] == span[0]["density"] == 1.0


def test_edges(spark, documents):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert license_labels(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 150_000 + "CC BY-NC"
    df = documents([(1, long), (2, None), (2, None), (None, "released under the MIT license"), (3, "cc by nc " * 5000)])
    clash = df.selectExpr("*", *[f"'q' as {c}" for c in ("row_no", "words", "pos", "hash", "template", "label", "diagonal", "n_words", "island")])
    got = license_labels(clash)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    by = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_base").alias("b"), F.max("last_word").alias("w"), F.max("labels").alias("l"))
    r = rows(by)
    assert (r[1]["b"], r[1]["w"]) == (1, 150_000)
    assert (r[2]["n"], r[2]["b"]) == (2, 0)
    assert (r[None]["b"], r[None]["l"]) == (1, "mit")
    assert (r[3]["b"], r[3]["w"]) == (5000, 14_997)

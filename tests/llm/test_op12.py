"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

from touchstone.llm import phrase_graph
from touchstone.llm.phrase_graph import collocations


def brute(docs, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}

    def inside(short, long):
        return any(long[i:i + len(short)] == short for i in range(len(long) - len(short) + 1))

    out = {}
    for (lang, p), a in candidates.items():
        if any(o == lang and len(q) > len(p) and inside(p, q) and b >= a for (o, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    rows = set()
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return rows


def rows(df):
    got = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def texts(seed, count, vocabulary):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(vocabulary) for _ in range(12))
    out = []
    for i in range(count):
        parts = [rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!? "]) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.2:
            parts.insert(rng.randrange(len(parts) + 1), f" {passage} ")
        out.append(("".join(parts), rng.choice(["en", "de", None])))
    return out


def test_against_every_phrase(spark, documents, monkeypatch):
    docs = texts(1, 250, ["the", "The", "of", "cat", "été", "naïve\xa0x", "-", "a", "b", "ÀB"])
    docs += [(None, "en"), ("", None), ("...", "fr"), ("one two", "xx")] + [("same same same same same same same", "en")] * 5
    table = documents([(i, t, lang, "s") for i, (t, lang) in enumerate(docs)], extra=True)
    for least in (3, 20):
        assert rows(collocations(table, least)) == brute(docs, least)
    assert rows(collocations(table, 3, top=7)) == brute(docs, 3, 7)
    monkeypatch.setattr(phrase_graph, "PAIR_BYTES", 0)  # whole pieces as paths
    assert rows(collocations(table, 5)) == brute(docs, 5)
    monkeypatch.undo()
    monkeypatch.setattr(phrase_graph, "HELD_WORDS", 500)  # many blocks, whose counts meet in the buckets
    assert rows(collocations(table, 5)) == brute(docs, 5)


def test_long_text_and_one_language_that_holds_nearly_all(spark, documents):
    docs = [("w " * 60_000 + "end", "en"), ("only once here", "de"), ("w w, w w", "de")]
    got = rows(collocations(documents([(i, t, lang, "s") for i, (t, lang) in enumerate(docs)]), 2))
    assert got == brute(docs, 2)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    row = spark.sql(f"select cast(cast({big} as bigint) as decimal(19,0)) * cast(1000 * cast({big} as bigint) as decimal(19,0)) as above,"
                    f" cast(7 as decimal(19,0)) * cast({big} as decimal(19,0)) as below").selectExpr("above div below as score").first()
    assert row["score"] == 1000 * big * big // (7 * big)


def test_empty(spark, documents):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert collocations(spark.createDataFrame([], schema)).collect() == []
    assert collocations(documents([(1, None), (2, "")]), 1).collect() == []

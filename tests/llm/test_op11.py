"""Spelling variants against a plain model: every pair of words compared, forms followed one by one."""

import random
import re
import zlib
from collections import Counter

from touchstone.llm.trie_frontier import near_words, spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_against_every_pair(spark, documents):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "ababab", "Straße", "über", "ÀÈéß", "naïveté"]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1:]])

    docs = []
    for i in range(300):
        words = [rng.choice(stems[: rng.randint(1, len(stems))]) for _ in range(rng.randint(0, 40))]
        docs.append((i, " ".join(typo(w) if rng.random() < 0.4 else w.upper() if rng.random() < 0.1 else w for w in words)))
    docs += [(400 + i, "KELVİN \u212AELVIN ÀBCDE Àbcde \u0130BCDEF ÉTAGES") for i in range(4)]  # signs that lower() would change
    docs += [(None, "aaaaa aaaab"), (7, None), (8, ""), (9, "12 34, --"), (9, "aaaaa aaaab")]
    want = brute(docs)
    assert len(want) > 150 and sum(1 for r in want if r[2] != r[0]) > 30
    assert rows(spelling_variants(documents(docs, extra=True))) == Counter(want)


def test_long_words_and_chains(spark, documents):
    """Words of thousands of letters share half of them: a chain of one-child nodes is one edge, not thousands of levels."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    variants = [long, long[:2200] + "z" + long[2201:], long[:700] + long[701:], long[:1500] + "zz" + long[1502:], long + "a", "b" + long]
    run = ["a" * k for k in range(5, 40)]
    words = sorted(set(variants + run))
    got = {tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_a_node_that_most_words_pass_is_salted(spark, monkeypatch):
    from touchstone.llm import trie_frontier

    monkeypatch.setattr(trie_frontier, "SALTED", 3)
    words = sorted({"inter" + "".join(t) for t in __import__("itertools").product("abc", repeat=4)})
    pairs = near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert len(pairs) == len({tuple(p) for p in pairs}) == len(words) * 8  # each of four letters has two others
    assert all(one_edit(*p) for p in pairs)


def test_empty_and_single(spark, documents):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    empty = spelling_variants(spark.createDataFrame([], schema))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
    assert rows(spelling_variants(documents([(i, "zebra-zebra") for i in range(3)]))) == Counter({("zebra", None, "zebra", 6, 0, None): 1})

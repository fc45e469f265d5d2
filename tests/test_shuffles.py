"""Shuffles of letters as arrays give what the plain walks and hashes give, and a battery scores its texts once."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from touchstone.functions.text import letters
from touchstone.operators import contrasts as co
from touchstone.operators import perturb as pt
from touchstone.operators import sequences as sq

TEXTS = ["", "a", "ab", "aaa", "aba", "abcabcabca" * 50, "été à la mer, été", "中文 ab 中文 a\U0001f600b\U0001f600c", "x\x00a\x00x", "aab", "baa",
         "".join(chr(0x4e00 + i * 7 % 300) for i in range(900)), "the only z stands last, so walks are long " * 20 + "z"]


def plain_walk(text, rng):
    if len(text) < 3 or len(set(text)) == 1:
        return text
    exits, last_exit, settled = {}, {}, {text[-1]}
    for a, b in zip(text, text[1:], strict=False):
        exits.setdefault(a, []).append(b)
    for start in sorted(exits):
        here = start
        while here not in settled:
            last_exit[here] = exits[here][rng.integers(len(exits[here]))]
            here = last_exit[here]
        here = start
        while here not in settled:
            settled.add(here)
            here = last_exit[here]
    queue = {}
    for letter, out in exits.items():
        tail = [last_exit[letter]] if letter != text[-1] else []
        if tail:
            out.remove(tail[0])
        queue[letter] = iter([out[i] for i in rng.permutation(len(out))] + tail)
    walk = [text[0]]
    for _ in range(len(text) - 1):
        walk.append(next(queue[walk[-1]]))
    return "".join(walk)


def test_pair_shuffles_are_those_of_the_plain_walk():
    for seed in range(20):
        for text in TEXTS:
            assert pt.euler_shuffle(text, np.random.default_rng(seed)) == plain_walk(text, np.random.default_rng(seed))


def test_letter_shuffles_are_in_the_order_of_the_hashes(spark):
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate([None, *TEXTS])], "k bigint, t string")
    plain = F.array_join(pt.shuffled(letters("t"), 7, "n", F.col("k")), "")
    got = rows.select(pt.shuffle_letters(F.col("t"), 7, "n", F.col("k")).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(r.a is None for r in got) == 1
    start = spark.range(1).select(F.xxhash64(F.lit(3)).alias("s"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.xxhash64(F.lit(3), i)).alias("h")).first()
    assert pt.place_hashes(10, start.s).tolist() == start.h


def test_texts_of_a_battery_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        seen.add(1)
        return float(x)

    real = spark.range(30).select(F.col("id").alias("k"), score(F.col("id") * 2).alias("score"))
    made = spark.range(30).select(F.col("id").alias("k"), F.lit("p").alias("perturbation"), (F.col("id") % 3).cast("double").alias("score"))
    declared = spark.createDataFrame([("p", "real_higher")], "perturbation string, expect string")
    out = co.contrast_battery(co.paired_deltas(real, made, "k"), declared, "p", key="k", replicates=20).collect()
    assert (out[0].n, out[0]["mean"], seen.value) == (30, 28.0, 30)
    wide = made.unionByName(made.withColumn("perturbation", F.lit("q")).withColumn("score", F.col("score") + 1))
    out = co.matched_contrast(co.paired_deltas(real, wide, "k"), "k", "p", "q", "p", replicates=20).collect()
    assert (out[0].n, out[0]["mean"], seen.value) == (30, 1.0, 60)


def test_transitions_of_texts_together_and_apart():
    for order, period in ((1, 1), (2, 1), (3, 1), (1, 3), (2, 2)):
        count = sq._transitions(order, period, "ab")
        for texts in (["abab", None, "", "a", "ba", "abba中ab"], ["é", "ab"] * 300 + ["aabb" * 50], ["a", "b", "a", "b"], [None]):
            want = Counter()
            for i, t in enumerate(texts):
                for p in range(len(t or "") - order):
                    gram = t[p:p + order + 1]
                    if set(gram) <= {"a", "b"}:
                        want[i, int("".join("ab".index(c).__str__() for c in gram), 2) + (p + order) % period * 2 ** (order + 1)] += 1
            row, cell, n = count(texts)
            assert dict(zip(zip(row.tolist(), cell.tolist(), strict=True), n.tolist(), strict=True)) == want
            together = Counter()
            for (_, c), k in want.items():
                together[c] += k
            _, cell, n = count(texts, apart=False)
            assert dict(zip(cell.tolist(), n.tolist(), strict=True)) == together


def test_texts_stand_beside_their_perturbations(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "k int, text string")
    got = pt.perturb(rows, "k", "text", ["reversal"], original="real").collect()
    assert {tuple(r) for r in got} == {(1, "real", "abc"), (1, "reversal", "cba"), (2, "real", None), (2, "reversal", None)}

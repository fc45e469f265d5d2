"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie held as a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import discard, mixed, settle, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "."  # stands for the end of a word
AHEAD = 3
SALTED = 4096  # words under a node for each salt of its edges

# ---- words


def _lowered(text: Column) -> Column:
    """A-Z lower-cased.  ``lower`` does it at once where the text has no other sign that it would change."""
    return F.when(text.rlike(r"[^\x00-\x7F\u00DF-\u00FF]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_counts(docs: DataFrame, cut: int | None = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word`` and ``n`` of the runs of letters in all texts, A-Z lower-cased.

    With ``cut``, a run of whose ``<doc_id>:<run>`` the crc32 h is divisible by it loses its code point h mod length.
    """
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), whole_text(docs).alias("text"))
    runs = runs.select("id", F.explode(F.split(_lowered(F.col("text")), "[^a-zÀ-ÿ]+")).alias("word"))
    runs = runs.filter(F.length("word") >= least_length)
    if cut:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        at = F.pmod("h", F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % cut == 0, short).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# ---- the trie


def _halves(length: np.ndarray, back: bool, start: bool) -> np.ndarray:
    """Depth from which on a word walks the trie (``start``), or is held in it for words one letter shorter or longer."""
    return (length + int(back)) // 2 if start else (length - 1 + int(back)) // 2


_rng = np.random.default_rng(11)
_LETTER = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_INVERSE = [pow(b, -1, 1 << 64) for b in _BASE]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _node_ids(points: np.ndarray, begin: np.ndarray, word: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the first ``depth`` letters of each given word."""
    out = []
    for table, base, inverse in zip(_LETTER, _BASE, _INVERSE, strict=True):
        total = np.r_[np.uint64(0), np.cumsum(table[points & 255] * _powers(base, len(points)), dtype=np.uint64)]
        b = begin[word]
        h = (total[b + depth] - total[b]) * _powers(inverse, len(points) + 1)[b]
        out.append(mixed(h + depth.astype(np.uint64)).view(np.int64))
    return out


PREFIXES = "back boolean, a long, b long, depth int, letter int, next_a long, next_b long, word string"
STARTS = "back boolean, a long, b long, depth int, word string"
_STEP_WORDS = 20_000


def _prefixes(start: bool):
    """Rows of trie nodes of each word, forward and backward: where it starts, or all from that depth on with the next letter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            at = 0
            while at < len(words):  # blocks of bounded letters, a longer word by itself
                end, letters = at, 0
                while end < len(words) and end - at < _STEP_WORDS and (end == at or letters + len(words[end]) < 1 << 20):
                    letters += len(words[end])
                    end += 1
                for back in (False, True):
                    part = [w[::-1] for w in words[at:end]] if back else words[at:end]
                    length = np.array([len(w) for w in part], np.int64)
                    begin = np.r_[0, np.cumsum(length)[:-1]]
                    points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
                    low = _halves(length, back, start)
                    count = np.ones_like(length) if start else length - low + 1
                    word = np.repeat(np.arange(len(part)), count)
                    depth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + low[word]
                    a, b = _node_ids(points, begin, word, depth)
                    text = pa.array(part).take(pa.array(word))
                    way = pa.array(np.full(len(word), back))
                    where = pa.array(depth, pa.int32())
                    if start:
                        yield pa.RecordBatch.from_arrays([way, pa.array(a), pa.array(b), where, text], ["back", "a", "b", "depth", "word"])
                        continue
                    inner = depth < length[word]
                    letter = np.where(inner, points[np.minimum(begin[word] + depth, max(0, len(points) - 1))], 0)
                    next_a, next_b = _node_ids(points, begin, word, np.where(inner, depth + 1, depth))
                    yield pa.RecordBatch.from_arrays(
                        [way, pa.array(a), pa.array(b), where, pa.array(letter, pa.int32()), pa.array(next_a), pa.array(next_b), text],
                        ["back", "a", "b", "depth", "letter", "next_a", "next_b", "word"])
                at = end

    return rows


def _trie(words: DataFrame) -> DataFrame:
    """Nodes that two words or more pass, each with its at most alphabet-many children.

    A child is the next letter (0 where a word ends), the words below, its node and one word of them.
    """
    letters = words.select("word").mapInArrow(_prefixes(False), PREFIXES)
    per = letters.groupBy("back", "a", "b", "depth", "letter").agg(
        F.count(F.lit(1)).alias("below"), F.min("word").alias("word"), F.min("next_a").alias("next_a"), F.min("next_b").alias("next_b"),
        F.min(F.length("word")).alias("shortest"), F.max(F.length("word")).alias("longest"))
    child = F.struct("letter", "below", "word", "next_a", "next_b", "shortest", "longest")
    return per.groupBy("back", "a", "b", "depth").agg(F.sum("below").alias("below"), F.collect_list(child).alias("children")).filter("below > 1")


def _compacted(nodes: DataFrame) -> DataFrame:
    """Where each chain of nodes with one child ends: pointer jumping, so rounds grow with the logarithm of the longest chain."""
    only = F.col("children")[0]
    chain = settle(nodes.filter((F.size("children") == 1) & (only["letter"] != 0)).select(
        "back", "a", "b", only["next_a"].alias("end_a"), only["next_b"].alias("end_b"), (F.col("depth") + 1).alias("end_depth")))
    while True:
        ahead = chain.select("back", F.col("a").alias("end_a"), F.col("b").alias("end_b"), F.col("end_a").alias("far_a"),
                             F.col("end_b").alias("far_b"), F.col("end_depth").alias("far_depth")).hint("merge")
        jumped = settle(chain.join(ahead, ["back", "end_a", "end_b"], "left").select(
            "back", "a", "b", F.coalesce("far_a", "end_a").alias("end_a"), F.coalesce("far_b", "end_b").alias("end_b"),
            F.coalesce("far_depth", "end_depth").alias("end_depth"), F.col("far_depth").isNotNull().alias("moved")))
        discard(chain)
        chain = jumped
        if not chain.filter("moved").limit(1).count():
            return chain.drop("moved")


def _salts(below: Column) -> Column:
    return F.ceil(below / SALTED).cast("int")


def _edges(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Edges of the trie, repeated for each salt of their node.

    ``other`` spells the label, its letters ``depth`` to ``next_depth``; an edge to a single word has no next node, and
    one at which a word ends has no label.  ``then`` holds the letters that lead on from the next node, ``AHEAD`` of them
    where a single word does, ``shortest`` and ``longest`` the lengths of the words behind the edge.
    """
    each = nodes.select("back", "a", "b", "depth", F.explode(F.sequence(F.lit(0), _salts(F.col("below")) - 1)).alias("salt"), "children")
    each = each.select("back", "a", "b", "salt", "depth", F.explode("children").alias("c")).select("back", "a", "b", "salt", "depth", "c.*")
    end = chains.select("back", F.col("a").alias("next_a"), F.col("b").alias("next_b"), "end_a", "end_b", "end_depth").hint("merge")
    inner = (F.col("letter") != 0) & (F.col("below") > 1)
    first = F.when(F.col("letter") != 0, F.substring("word", F.col("depth") + 1, F.lit(1))).otherwise("")
    led = each.join(end, ["back", "next_a", "next_b"], "left").select(
        "back", "a", "b", "salt", "depth", F.col("word").alias("other"), (F.col("letter") == 0).alias("ends"), first.alias("first"),
        F.when(inner, F.coalesce("end_depth", F.col("depth") + 1)).alias("next_depth"),
        F.when(inner, F.coalesce("end_a", "next_a")).alias("next_a"), F.when(inner, F.coalesce("end_b", "next_b")).alias("next_b"),
        _salts(F.col("below")).alias("next_salts"), "shortest", "longest")
    # The letters that a lone word goes on with, one letter and a star where several words do.
    then = F.transform("children", lambda c: F.concat(F.lit("|"), F.when(c["letter"] == 0, END * AHEAD).when(
        c["below"] > 1, F.concat(F.substring(c["word"], F.col("depth") + 1, F.lit(1)), F.lit("*"))).otherwise(
        F.rpad(F.substring(c["word"], F.col("depth") + 1, F.lit(AHEAD)), AHEAD, END))))
    ahead = nodes.select("back", F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.array_join(then, "").alias("then")).hint("merge")
    return led.join(ahead, ["back", "next_a", "next_b"], "left")


# ---- the frontier


def _letters(text: Column) -> Column:
    return F.split(text, "")


def _advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Every state moved along every edge of its node: words reached (``done``) and the states of the next level.

    A state is (word, position, node, edits).  Without an edit it follows the label that the word spells; at the first
    difference to any other label it may exchange or insert a letter.  Each neighbour is reached along one path only.
    States that cannot go on, because no word of their length lies ahead or the next letter does not, are not made.
    """
    letter = F.when(F.col("edits") == 1, F.substring("word", F.col("position") + 1, F.lit(1)))  # the only edge it can take
    near = F.length("word").between(F.col("shortest") - 1, F.col("longest"))
    met = states.withColumn("letter", letter).join(edges.hint("merge"), ["back", "a", "b", "salt"])
    met = met.filter(near & (F.col("letter").isNull() & ~F.col("ends") | (F.col("letter") == F.col("first"))))
    met = met.withColumn("rest", F.substring("word", F.col("position") + 1, F.length("word"))).withColumn(
        "label", F.substring("other", F.col("depth") + 1, F.coalesce(F.col("next_depth") - F.col("depth"), F.length("other"))))
    size = F.length("label")
    differs = F.array_position(F.zip_with(_letters(F.substring("rest", F.lit(1), size)), _letters(F.col("label")), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    leaf, follows, edited = F.col("next_a").isNull(), F.startswith("rest", "label"), F.col("edits") == 1
    met = met.withColumn("k", F.when(leaf | edited | follows, None).when(size == 1, F.lit(0)).otherwise(differs.cast("int") - 1))
    after = F.substring("label", F.col("k") + 2, size)
    length, here = F.length("word"), F.col("position")

    def move(when: Column, position: Column, edits: Column) -> Column:
        return F.when(when, F.struct(position.cast("int").alias("position"), edits.cast("int").alias("edits")))

    def onward(position: Column, reached: Column) -> Column:
        """Whether words of the ``reached`` length lie ahead, the letters from ``position`` on next."""
        sign = F.rpad(F.substring("word", position + 1, F.lit(AHEAD)), AHEAD, END)
        many = F.concat(F.lit("|"), F.substring(sign, 1, 1), F.lit("*"))
        met = F.contains(F.col("then"), F.concat(F.lit("|"), sign)) | F.contains(F.col("then"), many)
        return reached.between(F.col("shortest"), F.col("longest")) & met

    exchanged = (F.length("rest") > F.col("k")) & F.startswith(F.substring("rest", F.col("k") + 2, F.length("rest")), after)
    inserted = F.startswith(F.substring("rest", F.col("k") + 1, F.length("rest")), after)
    reach = size - F.length("rest")
    whole = F.when(edited, F.col("rest") == F.col("label")).otherwise(reach.between(0, 1) & (F.levenshtein("rest", "label", 1) == 1))
    along = follows & (~edited | onward(here + size, F.lit(0) + length) | onward(here + size, length + 1))
    moves = F.when(leaf, F.array(move(whole, here, F.lit(1)))).when(F.col("k").isNull(), F.array(move(along, here + size, F.col("edits")))).otherwise(
        F.array(move(onward(here + size, length) & exchanged, here + size, F.lit(1)), move(onward(here + size - 1, length + 1) & inserted, here + size - 1, F.lit(1))))
    out = met.withColumn("m", F.explode(F.filter(moves, lambda m: m.isNotNull())))
    return out.select(
        "back", "word", F.col("m.position").alias("position"), F.col("m.edits").alias("edits"), leaf.alias("done"),
        F.when(leaf, F.col("other")).alias("other"), F.col("next_a").alias("a"), F.col("next_b").alias("b"),
        F.pmod(F.xxhash64("word"), "next_salts").cast("int").alias("salt"))


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs (``word``, ``other``) of distinct words that one inserted, deleted or replaced code point makes equal.

    ``words`` has one row per ``word``, of letters up to code point 255.  Words that differ first in their second half share
    a node half way down the trie of words, all others one half way down the trie of words read backwards: the frontier
    starts there, one state per word and direction, and joins the edge table level by level until no state is left.  Chains
    of nodes with one child are one edge, so levels are branchings, not letters.  The edge table is shuffled, never broadcast:
    it would be sent anew at each level.  Edges of a node that many words pass are
    salted.  Nodes are named by 128-bit hashes, pairs are compared at the end.
    """
    nodes = settle(_trie(words))
    chains = _compacted(nodes)
    edges = settle(_edges(nodes, chains))
    begin = words.select("word").mapInArrow(_prefixes(True), STARTS)
    states = settle(begin.join(nodes.select("back", "a", "b", "below").hint("merge"), ["back", "a", "b"]).select(
        "back", "word", F.col("depth").alias("position"), F.lit(0).alias("edits"), "a", "b",
        F.pmod(F.xxhash64("word"), _salts(F.col("below"))).cast("int").alias("salt")))
    levels: list[DataFrame] = []
    frontier = states
    while frontier.limit(1).count():
        levels.append(settle(_advanced(frontier, edges)))
        frontier = levels[-1].filter("not done").drop("done", "other")
    for old in (chains, nodes, edges, states):
        discard(old)
    found = [level.filter("done").select("back", "word", "other") for level in levels]
    if not found:
        return words.select("word", F.col("word").alias("other")).limit(0)
    pairs = reduce(DataFrame.union, found)
    straight = [F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "other")]
    half = F.floor(F.length("word") / 2).cast("int")
    again = F.col("back") & (F.substring("word", F.lit(1), half) == F.substring("other", F.lit(1), half))  # found forward as well
    pairs = settle(pairs.select("back", *straight).filter(~again & (F.levenshtein("word", "other", 1) == 1)).select("word", "other"))
    for level in levels:
        discard(level)
    shorter = pairs.filter(F.length("other") > F.length("word")).select(F.col("other").alias("word"), F.col("word").alias("other"))
    return pairs.union(shorter)


# ---- groups


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and the last ``root`` of the chain of its forms (``word``, ``form``), by pointer jumping."""
    chain = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = settle(chain.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        discard(chain)
        chain = jumped
        if not chain.filter("moved").limit(1).count():
            return chain.drop("moved")


def spelling_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of words and counts (``word``, ``n``).

    A word's form is its most frequent near word, ties to the smallest, if that is ``ratio`` times as frequent or more;
    its root is where the forms lead.  ``n_near`` counts its near words.
    """
    pairs = near_words(words)
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.join(counts, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    out = words.join(best, "word", "left")
    strong = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    out = settle(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"),
                            F.when(strong, -F.col("best.less")).cast("long").alias("form_n")))
    led = roots(out.filter("form is not null"))
    return out.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, cut: int | None = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """Variant groups of the words of whole texts: :func:`word_counts`, then :func:`spelling_groups`.

    Null and empty texts have no words; repeated rows count again; a null doc_id counts as an empty text in the crc32;
    other columns are ignored, whatever their names; an empty table gives no rows.  A word of any length is one trie path,
    and the whole vocabulary takes part: no candidate is capped.
    """
    words = settle(word_counts(docs, cut, least_length, least_count))
    return spelling_groups(words, ratio)

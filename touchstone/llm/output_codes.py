"""Language of a text by error-correcting output codes over character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.llm.char_grams import COUNTS, _table, grams, pack_counts, summed_counts, texts_by_chunk
from touchstone.llm.common import held_out, whole_text

SIZES = [1, 2, 3, 4]
BITS = 15
TABLE = len(SIZES) << BITS
UNKNOWN = "und"


@dataclass
class Model:
    """``codes`` (languages x bits, +1 / -1), ``weight`` (buckets x bits) and the trust in each bit."""

    languages: list[str]
    codes: np.ndarray
    weight: np.ndarray
    trust: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A code of n words: all splits up to five languages, beyond that random columns with the widest least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1 << (n - 1))[:-1]  # the first word is all ones
        rows = [np.ones(len(splits))] + [np.where(splits >> k & 1, 1.0, -1.0) for k in range(n - 1)]
        return np.array(rows)
    width, rng, best, found = 10 + 5 * math.ceil(math.log2(n)), np.random.default_rng(seed), -1, None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        code[0, np.abs(code.sum(0)) == n] *= -1
        apart = ((width - code @ code.T) / 2 + np.eye(n) * width).min()
        if apart > best:
            best, found = apart, code
    return found


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        names, lang = np.unique(np.asarray(batch["lang"].to_pylist(), dtype=object).astype(str), return_inverse=True)
        for lo, hi, points, at in texts_by_chunk(batch):
            of = np.repeat(lang[lo:hi], np.diff(at))
            for bucket, inside in grams(points, at, SIZES, BITS):
                both = np.bincount(of[inside] * TABLE + bucket[inside], minlength=len(names) * TABLE).reshape(-1, TABLE)
                for name, part in zip(names, both, strict=True):
                    if name not in counts:
                        counts[name] = np.zeros(TABLE, np.int64)
                    counts[name] += part
        if len(counts) > 16:  # many languages: hand on what there is
            yield from pack_counts(counts)
            counts = {}
    yield from pack_counts(counts)


def fit(docs: DataFrame) -> Model:
    """One naive Bayes classifier per bit of the code, from n-gram counts of all documents that teach.

    Every language weighs the same within its side of a bit.  ``trust`` is the least mean margin that the languages
    themselves reach on a bit; margins are measured in it.
    """
    teach = docs.where(docs["lang"].isNotNull() & ~held_out("doc_id", 5, 0)).select("lang", whole_text(docs).alias("text"))
    counts = summed_counts(teach.mapInArrow(_language_counts, COUNTS), TABLE)
    languages = sorted(counts)
    codes = codewords(len(languages))
    if not languages:
        return Model([], codes, np.zeros((TABLE, 1), np.float32), np.ones(1))
    share = np.array([(counts[k] + 0.01) / (counts[k].sum() + 0.01 * TABLE) for k in languages])
    weight = np.zeros((TABLE, codes.shape[1]))
    for b in range(codes.shape[1]):
        up, down = share[codes[:, b] > 0], share[codes[:, b] < 0]
        if len(up) and len(down):
            weight[:, b] = np.log(up.mean(0)) - np.log(down.mean(0))
    margin = codes * (share @ weight)  # of each language's own n-grams on each bit
    return Model(languages, codes, weight.astype(np.float32), np.maximum(margin.min(0), 1e-3))


def _predictions(model):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        letters = _table("letter")
        for batch in batches:
            n = batch.num_rows
            margin, has_letter, length = np.zeros((n, m.weight.shape[1])), np.zeros(n, bool), np.zeros(n)
            for lo, hi, points, at in texts_by_chunk(batch, 1 << 18):
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                has_letter[lo:hi] = np.bincount(row, letters[points[:len(row)]], minlength=hi - lo) > 0
                for bucket, inside in grams(points, at, SIZES, BITS):
                    each = np.zeros((len(row), margin.shape[1]), np.float32)
                    each[inside] = m.weight[bucket[inside]]
                    margin[lo:hi] += np.add.reduceat(each, at[:-1], axis=0)
                    length[lo:hi] += np.bincount(row[inside], minlength=hi - lo)
            z = margin / np.maximum(length, 1)[:, None] / m.trust  # 1: as clear as the languages' own texts
            z *= np.minimum(1.0, length / 40)[:, None] * 2  # little text, little evidence
            bit_weight = m.trust / m.trust.sum()
            loss = np.array([(bit_weight * np.exp(-np.clip(z * code, -6, 6))).sum(1) for code in m.codes]).T.reshape(n, -1)
            if m.languages:
                order = np.argsort(loss, axis=1, kind="stable")
                best = loss[np.arange(n), order[:, 0]]
                close = np.exp(-4 * (loss - best[:, None]))
                score = 1 / close.sum(1)
                lang = np.array(m.languages, dtype=object)[order[:, 0]]
            else:
                score, lang = np.zeros(n), np.full(n, UNKNOWN, object)
            known = has_letter & bool(m.languages)
            lang[~known], score[~known] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(known & (score < 0.75))],
                ["doc_id", "lang_pred", "score", "ambiguous"])

    return go


def language(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``ambiguous`` of every document.

    Each language has a codeword; a binary n-gram classifier predicts every bit, and loss-weighted decoding takes the
    codeword with the least exponential loss, bits counting by the trust in them.  ``score`` compares that loss with the
    other codewords'; under 0.75 the text is ``ambiguous``.  Only texts and languages of documents that teach are learnt
    from; language, source and id are no inputs of a prediction.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing teaches.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    out = docs.select("doc_id", "text").mapInArrow(
        _predictions(shared), "doc_id bigint, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")

"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.llm.char_grams import COUNTS, grams, pack_counts, summed_counts, texts_by_chunk
from touchstone.llm.common import discard, held_out, settle, whole_text

SIZES = [4, 5]
BITS = 19  # buckets of each size
TABLE = len(SIZES) << BITS
TRAIN_ROWS = 20_000  # labelled documents of each class that the linear weights are fitted on, by a hash of the id
LEAST_DOCS = 5  # an n-gram that fewer teaching documents hold has no ratio
PACK = 128  # texts in a row of the sparse matrix
TASKS = 12  # sums of a gradient that reach the driver
MAPS = 1024  # bitmaps of MAP_BITS bits each, of hashed ids that have a label
MAP_BITS = 1 << 15


@dataclass
class Model:
    """``weight`` of each bucket's count (linear weight times log-count ratio) and the bias."""

    weight: np.ndarray
    bias: float


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``y`` of the documents that teach.

    Conflicting labels of an id count as toxic, null labels and ids teach nothing; of texts repeated under an id all count.
    Bitmaps of the labelled ids' hashes (a broadcast of fixed size) keep most texts without a label out of the join.
    """
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(MAPS * MAP_BITS))
    place = F.floor(slot / MAP_BITS).cast("int"), (slot % MAP_BITS).cast("int")
    known = labels.where("toxic is not null and doc_id is not null")
    marks = known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("y"))
    maps = known.groupBy(place[0].alias("_map")).agg(F.bitmap_construct_agg(place[1].cast("long")).alias("_bits"))
    teach = docs.where(~held_out("doc_id", 3, 1)).select("doc_id", whole_text(docs).alias("text"), place[0].alias("_map"), place[1].alias("_bit"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    marked = (byte / F.pow(F.lit(2.0), F.col("_bit") % 8)).cast("int") % 2 == 1
    maybe = teach.join(F.broadcast(maps), "_map").where(marked).select("doc_id", "text")
    return maybe.join(marks, "doc_id").select("doc_id", "text", "y")


def sampled(teach: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` labelled documents of each class whose ids' hashes are smallest (then id, then the text's hash).

    Counts by the hashes' leading bits tell how far they reach, so that only their texts are sorted and moved.
    """
    lead = F.shiftright(F.xxhash64("doc_id"), 52).cast("int")
    counts = {side: np.zeros(1 << 12, np.int64) for side in (True, False)}
    for y, at, n in teach.groupBy("y", lead.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[y][at + (1 << 11)] = n
    parts = []
    for side, n in counts.items():
        last = int(np.searchsorted(np.cumsum(n), min(rows, n.sum()))) - (1 << 11)
        near = teach.where((F.col("y") == side) & (lead <= last))
        parts.append(near.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows))
    return parts[0].union(parts[1])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold an n-gram."""
    counts = {k: np.zeros(TABLE + 1, np.int64) for k in ("toxic", "clean")}
    for batch in batches:
        y = np.asarray(batch["y"].to_numpy(zero_copy_only=False))
        for lo, hi, points, at in texts_by_chunk(batch):
            row = np.repeat(np.arange(hi - lo), np.diff(at))
            for bucket, inside in grams(points, at, SIZES, BITS):
                seen = np.unique((row[inside] << 24) | bucket[inside])
                toxic = y[lo:hi][seen >> 24]
                for key, part in (("toxic", seen[toxic]), ("clean", seen[~toxic])):
                    counts[key][:TABLE] += np.bincount(part & 0xFFFFFF, minlength=TABLE)
        counts["toxic"][TABLE] += int(y.sum())
        counts["clean"][TABLE] += int((~y).sum())
    yield from pack_counts(counts)


_PACKED = "y binary, lengths binary, feature binary, n binary"


def _matrix(index):
    """The sparse matrix: features and counts of up to PACK labelled texts a row, features as steps within a text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = index.value
        for batch in batches:
            y = np.asarray(batch["y"].to_numpy(zero_copy_only=False)).astype(np.uint8)
            for lo, hi, points, at in texts_by_chunk(batch):
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                pairs = []
                for bucket, inside in grams(points, at, SIZES, BITS):
                    f = of[bucket[inside]]
                    pairs.append((row[inside][f >= 0] << 24) | f[f >= 0])
                both, n = np.unique(np.concatenate(pairs or [np.zeros(0, np.int64)]), return_counts=True)
                cut = np.searchsorted(both, np.arange(hi - lo + 1) << 24)
                for a in range(0, hi - lo, PACK):
                    z = min(a + PACK, hi - lo)
                    part = slice(cut[a], cut[z])
                    packed = (y[lo + a:lo + z], np.diff(cut[a:z + 1]).astype(np.int32), np.diff(both[part], prepend=0).astype(np.int32), n[part].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in packed], ["y", "lengths", "feature", "n"])

    return go


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Class of each text; row, feature and count of each entry."""
    for batch in batches:
        for packed in zip(*[batch[c].to_pylist() for c in ("y", "lengths", "feature", "n")], strict=True):
            y, lengths, step, n = (np.frombuffer(zlib.decompress(x), kind) for x, kind in zip(packed, (np.uint8, np.int32, np.int32, np.int32), strict=True))
            yield y, np.repeat(np.arange(len(y)), lengths), np.cumsum(step, dtype=np.int32) & 0xFFFFFF, n


def _margins(shared):
    """Class and score of each text of the matrix."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, _ = shared.value
        for y, row, col, n in _unpacked(batches):
            z = np.bincount(row, n * weight[col], minlength=len(y)) + bias
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(float)), pa.array(z)], ["y", "z"])

    return go


def _gradients(shared):
    """Loss, slope of the bias and slope of each feature's weight, summed over a task's texts."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, per_class = shared.value
        loss, slope, total = 0.0, 0.0, np.zeros(len(weight))
        for y, row, col, n in _unpacked(batches):
            z = np.bincount(row, n * weight[col], minlength=len(y)) + bias
            g = per_class[y] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
            loss += (per_class[y] * (np.logaddexp(0, z) - y * z)).sum()
            slope += g.sum()
            total += np.bincount(col, n * g[row], minlength=len(weight))
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["loss", "slope", "sums"])

    return go


def fit(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> Model:
    """Log-count ratios from all labelled documents, linear weights from at most TRAIN_ROWS of each class.

    Every bucket that LEAST_DOCS documents hold takes part, whatever the corpus' size; its ratio is shrunk by its own
    standard error.  Without labels of both classes the model gives the smoothed share of toxic labels.
    """
    teach = settle(labelled(docs, labels))
    counts = summed_counts(teach.select("text", "y").mapInArrow(_document_counts, COUNTS), TABLE + 1)
    toxic, clean = (counts.get(k, np.zeros(TABLE + 1, np.int64)) for k in ("toxic", "clean"))
    p, q = int(toxic[TABLE]), int(clean[TABLE])
    weight = np.zeros(TABLE)
    if not p or not q:
        return Model(weight, float(np.log((p + 0.5) / (q + 0.5))))
    top = np.flatnonzero(toxic[:TABLE] + clean[:TABLE] >= LEAST_DOCS)
    ratio = shrunk_ratios(toxic[top], clean[top], p, q)
    if len(top) == 0:
        p, q = min(p, TRAIN_ROWS), min(q, TRAIN_ROWS)
        return Model(weight, float(np.log(p / q)))
    index = np.full(TABLE, -1, np.int32)
    index[top] = np.arange(len(top))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    matrix = settle(sampled(teach, TRAIN_ROWS).select("text", "y").repartition(TASKS).mapInArrow(_matrix(shared), _PACKED))
    shared.destroy()
    w, bias = _logistic(matrix.coalesce(TASKS), ratio, min(p, TRAIN_ROWS), min(q, TRAIN_ROWS), threshold)
    discard(matrix)
    discard(teach)
    weight[top] = w * ratio
    return Model(weight, bias)


def shrunk_ratios(toxic: np.ndarray, clean: np.ndarray, p: int, q: int) -> np.ndarray:
    """log P(gram | toxic) - log P(gram | clean), less where few documents tell: four squared standard errors halve it."""
    ratio = np.log((toxic + 1) / (p + 2)) - np.log((clean + 1) / (q + 2))
    return ratio ** 3 / (ratio ** 2 + 4 * (1 / (toxic + 1) + 1 / (clean + 1)))


def _logistic(matrix: DataFrame, ratio: np.ndarray, p: int, q: int, decision: float, ridge: float = 1e-2, steps: int = 15) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by limited-memory quasi-Newton steps; ``decision`` is the score at the best cut.

    The matrix stays with the executors: a step sends the weights out and at most TASKS sums of one short number per feature
    back.
    """
    context = matrix.sparkSession.sparkContext
    per_class = np.array([0.5 / q, 0.5 / p])  # both classes weigh the same

    def sent(v: np.ndarray):
        return context.broadcast((v[1:] * ratio, v[0], per_class))

    def slope(v: np.ndarray) -> tuple[float, np.ndarray]:
        shared = sent(v)
        loss, g = 0.0, np.zeros(len(v))
        for r in matrix.mapInArrow(_gradients(shared), "loss double, slope double, sums binary").collect():
            loss += r["loss"]
            g[0] += r["slope"]
            g[1:] += np.frombuffer(r["sums"], np.float32)
        shared.destroy()
        g[1:] = g[1:] * ratio + ridge * v[1:]
        return loss + ridge / 2 * (v[1:] @ v[1:]), g

    v = np.zeros(len(ratio) + 1)
    loss, g = slope(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        move, shares = g.copy(), []
        for s, d in reversed(past):
            shares.append(s @ move / (d @ s))
            move -= shares[-1] * d
        move *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 0.1 / max(1, np.linalg.norm(g))
        for (s, d), share in zip(past, reversed(shares), strict=True):
            move += s * (share - d @ move / (d @ s))
        for half in range(8):
            at = v - move / 2 ** half
            below, slopes = slope(at)
            if below <= loss - 1e-4 / 2 ** half * (g @ move):
                break
        else:
            break
        s, d = at - v, slopes - g
        if s @ d > 1e-12:
            past = [*past, (s, d)][-8:]
        v, loss, g = at, below, slopes
    # The decision point goes where the two classes' error shares are least in sum, amid the gap between their scores.
    shared = sent(v)
    rows = matrix.mapInArrow(_margins(shared), "y double, z double").toArrow()
    shared.destroy()
    y, z = (np.asarray(rows[c]) for c in ("y", "z"))
    order = np.argsort(z, kind="stable")
    missed = np.r_[0, np.cumsum(y[order])] / max(1, y.sum())
    false = np.r_[0, np.cumsum((1 - y)[order])]
    wrong = missed + (false[-1] - false) / max(1, false[-1])
    cut = int(np.argmin(wrong))
    gap = z[order[max(cut - 1, 0)]], z[order[min(cut, len(z) - 1)]]
    return v[1:], float(v[0] + np.log(decision / (1 - decision)) - (gap[0] + gap[1]) / 2)


def _scores(model, columns: list[str]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, points, at in texts_by_chunk(batch):
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                for bucket, inside in grams(points, at, SIZES, BITS):
                    out[lo:hi] += np.bincount(row[inside], weight[bucket[inside]], minlength=hi - lo)
            score = 1 / (1 + np.exp(-np.clip(out + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(score)], [*columns, "_score"])

    return go


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of the documents and ``_score``; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))
    source = docs.select(*columns, *([] if "text" in columns else ["text"]))
    kinds = docs.select(*columns).schema.add("_score", "double")
    return source.mapInArrow(_scores(shared, columns), kinds)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every document.

    Character n-grams of whole lower-cased texts are hashed; each bucket that LEAST_DOCS teaching documents hold counts with
    its shrunk log-count ratio log P(gram | toxic) - log P(gram | clean), over all documents that teach, times a linear
    weight that at most TRAIN_ROWS documents of each class fit.  Labels, language, source and id are no inputs of a score.  Null and empty texts get the bias; repeated rows repeat; extra columns are ignored.
    """
    model = fit(docs, labels, threshold)
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, all their columns, that score under the threshold."""
    model = fit(docs, labels, threshold)
    return scored(docs, model, docs.columns).where(F.col("_score") < threshold).drop("_score")

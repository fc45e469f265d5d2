"""Packing along a space-filling curve: neighbouring documents share sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import _BYTE, _SPACE, _power, chunks, mixed, partitions, settle, string_buffers, whole_text, words

LENGTH = 2048
END = 1
DIMENSIONS, DEPTH = 4, 7  # of the curve: 28 bits of key, the rest breaks ties
CACHED = 1_000_000  # token ids of so many pieces are kept by a Python worker

_worker: dict = {}
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def hilbert(axes: np.ndarray, depth: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (n x dimensions, ``depth`` bits each)."""
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    # Undo the rotations from the coarsest bit to the finest, then Gray-decode and interleave.
    bit = 1 << (depth - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (depth - 1)
    while bit > 1:
        turn ^= np.where((x[dims - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert key of each text: hashed word vectors projected on random signs, quantised; ties ordered by content."""
    n = len(offsets) - 1
    axes, content = np.zeros((n, DIMENSIONS), np.int64), np.zeros(n, np.uint64)
    for lo, hi in chunks(offsets):
        h, row = words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        count = np.maximum(np.bincount(row, minlength=hi - lo), 1)
        for d in range(DIMENSIONS):
            sign = ((h >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(float) * 2 - 1
            mean = np.bincount(row, sign, minlength=hi - lo) / count
            axes[lo:hi, d] = np.minimum((np.tanh(4 * mean) + 1) / 2 * (1 << DEPTH), (1 << DEPTH) - 1)
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
        if len(start):
            content[lo + row[start]] = np.add.reduceat(h, start)
    tie = (mixed(content) >> np.uint64(64 - 34)).astype(np.int64)
    return (hilbert(axes, DEPTH) << 34) | tie


def spelled_bytes(path: str) -> np.ndarray | None:
    """Bytes of text that each id of a byte-level vocabulary stands for; None for tokenizers of other kinds."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    changes = [spec.get("normalizer"), spec.get("post_processor"), spec.get("truncation"), spec.get("padding"), before.get("add_prefix_space"),
               model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), *[not t["special"] for t in spec.get("added_tokens") or []]]
    if before.get("type") != "ByteLevel" or model.get("type") != "BPE" or any(changes):
        return None
    out = np.zeros(max(model["vocab"].values()) + 1, np.int64)
    for token, i in model["vocab"].items():
        out[i] = len(token)  # one sign for each byte
    return out


class Encoder:
    """Token ids of whole texts; the ids of pieces are remembered, as they don't depend on what stands around a piece.

    In this vocabulary nothing reaches across a single space (a word takes the one before it), a single line feed, or from a
    letter to the full stop or comma behind it.  A text without runs of white space is cut there, and its ids are those of
    its pieces in a row; other texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.spelled = spelled_bytes(path)

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text by itself.  Where ids tell how many bytes they spell, all texts go in as the words of one input."""
        words = [t.decode("utf-8", "replace") for t in texts]
        if self.spelled is not None and texts:
            e = self.tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(e.ids, self.kind)
            done, ends = np.r_[0, np.cumsum(self.spelled[ids])], np.r_[0, np.cumsum([len(t) for t in texts])]
            at = np.searchsorted(done, ends)
            if done[-1] == ends[-1] and (done[at] == ends).all():
                ids, at = ids.tobytes(), (at * self.kind.itemsize).tolist()
                return [ids[a:b] for a, b in zip(at, at[1:])]
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids and the end id of each text of a chunk (its bytes, and the offsets of its texts from 0)."""
        end, width, n = np.array([END], self.kind).tobytes(), self.kind.itemsize, len(data)
        raw, size = data.tobytes(), np.diff(offsets)
        whole = self._with_runs(data, offsets, raw) if n else np.zeros(len(size), bool)
        out: list = [end] * len(size)
        cut = np.flatnonzero(~whole & (size > 0))
        if len(cut):
            first = np.zeros(n + 1, bool)
            first[offsets] = True
            feed = data == 0x0A
            first[:n] |= (data == 0x20) | feed
            first[1:n] |= feed[:-1] | (_STOP[data[1:]] & _LETTER[data[:-1]])
            start = np.flatnonzero(first[:n])
            at = np.searchsorted(start, offsets)
            stop = np.r_[start[1:], n]
            h = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * _power("up", n)[:n], out=h[1:])
            h = mixed((h[stop] - h[start]) * _power("down", n)[start] + (stop - start).astype(np.uint64))
            used = np.repeat(~whole, np.diff(at))
            _, where, of = np.unique(h[used], return_index=True, return_inverse=True)
            begin, stop = start[used][where].tolist(), stop[used][where].tolist()
            pieces = [raw[a:b] for a, b in zip(begin, stop, strict=True)]
            if len(self.known) > CACHED:
                self.known = {}
            known = self.known
            new = [p for p in pieces if p not in known]
            known.update(zip(new, self.plain(new), strict=True))
            found = [known[p] for p in pieces]
            length = np.array([len(x) // width for x in found])
            flat, begin = np.frombuffer(b"".join(found), self.kind), np.cumsum(length) - length
            many = length[of]
            place = np.cumsum(many) - many
            ids = flat[np.repeat(begin[of] - place, many) + np.arange(int(many.sum()))].tobytes()
            bounds = np.r_[0, np.cumsum(many)][np.r_[0, np.cumsum(np.where(whole, 0, np.diff(at)))]] * width
            for i in cut.tolist():
                out[i] = ids[bounds[i]:bounds[i + 1]] + end
        texts = np.flatnonzero(whole).tolist()
        for i, ids in zip(texts, self.plain([raw[offsets[i]:offsets[i + 1]] for i in texts]), strict=True):
            out[i] = ids + end
        return out

    @staticmethod
    def _with_runs(data: np.ndarray, offsets: np.ndarray, raw: bytes) -> np.ndarray:
        """Texts with two white space characters in a row, one at an end, or one outside ASCII."""
        space = _SPACE[data]
        bad = np.zeros(len(data), bool)
        bad[1:] = space[1:] & space[:-1]
        some = np.diff(offsets) > 0
        bad[offsets[:-1][some]] = space[offsets[:-1][some]]
        bad[offsets[1:][some] - 1] |= space[offsets[1:][some] - 1]
        bad[[m.start() for m in _WIDE_SPACE.finditer(raw)]] = True
        return np.add.reduceat(np.r_[bad, False].astype(np.int32), offsets[:-1]) * some > 0


def _encoded(path: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _worker:
            _worker[path] = Encoder(path)
        encode = _worker[path]
        for batch in batches:
            data, offsets = string_buffers(batch["text"])
            keys = curve_keys(data, offsets)
            for lo, hi in chunks(offsets):
                ids = encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo), pa.array(keys[lo:hi]),
                     pa.array([len(x) // encode.kind.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "key", "n", "ids"])

    return go


def _parts(bounds):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(bounds, np.asarray(batch["key"]), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    return go


def _packed(starts: list[int], length: int):
    """Pieces of the documents of a range in curve order; a range begins where the ranges before end."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = None, 0
        for batch in batches:
            rows = []
            for doc, p, n, ids in zip(*[batch[c].to_pylist() for c in ("doc_id", "part", "n", "ids")], strict=True):
                if p != part:
                    part, place = p, starts[p]
                wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                start = 0
                while start < n:
                    offset = place % length
                    m = min(n - start, length - offset)
                    rows.append((doc, start, m, zlib.crc32(wide[start:start + m].tobytes()), n, place // length, offset))
                    start, place = start + m, place + m
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names)

    return go


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``.

    Every document is its token ids and one end id (a null or empty text is the end id alone).  Hashed word vectors are
    projected to DIMENSIONS axes and quantised; documents are sorted by their place on the Hilbert curve, in ranges, and laid
    end to end, so sequences hold neighbours and only the very last one is padded.  A range starts at the sum of tokens of
    the ranges before it: nothing but one number per range passes the driver.  Equal texts are ordered by id; copies of one
    text, however many, are dealt out over ranges by a key that ends in hashed id bits.  Repeated rows are packed each; extra
    columns are ignored; an empty table gives no rows.  ``tokenizer`` is the path of a tokenizers file, the same on all machines.
    """
    spark = docs.sparkSession
    coded = docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(
        _encoded(tokenizer or default_tokenizer()), "doc_id bigint, key bigint, n bigint, ids binary")
    # The last 16 bits of the tie-break come from the id, so that copies of one text can be cut into ranges.
    coded = settle(coded.withColumn("key", F.col("key").bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(0xFFFF)))))
    p = partitions(spark)
    cuts = coded.select(F.percentile_approx("key", [i / p for i in range(1, p)], 100 * p)).first()[0] if p > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    kinds = "doc_id bigint, key bigint, n bigint, ids binary, part int"
    sums = coded.select("doc_id", "key", "n", F.lit(b"").alias("ids")).mapInArrow(_parts(bounds), kinds).groupBy("part").agg(F.sum("n").alias("n"))
    starts, place = [0] * (len(bounds) + 1), 0
    for r in sorted(sums.collect(), key=lambda r: r["part"]):  # one row per range
        starts[r["part"]], place = place, place + r["n"]
    ranges = coded.mapInArrow(_parts(bounds), kinds).repartitionById(len(bounds) + 1, F.col("part"))
    return ranges.sortWithinPartitions("part", "key", "doc_id", "n", "ids").mapInArrow(
        _packed(starts, length),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

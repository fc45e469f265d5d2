"""Repeated lines: hashes range-partitioned and streamed in order, verdicts returned as one bitmap per document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import SPACES, partitions, settle, string_buffers, whole_text

_STREAM = "doc_id bigint, text_key bigint, pos int, a bigint, b bigint, docs int, state int"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()), ("a", pa.int64()), ("b", pa.int64()),
                     ("docs", pa.int32()), ("state", pa.int32())])
DROP, OPEN, EDGE = 1, 2, 3


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def text_key(df: DataFrame) -> Column:
    return F.xxhash64(whole_text(df))


class _Run:
    """Streams rows sorted by (a, b, document, position) and decides each key with memory for ``most - 1`` documents.

    A key whose run lies inside the partition is decided here.  The partition's first and last key may go on in a
    neighbour: their undecided rows (fewer than ``most`` documents) leave as OPEN, and an EDGE row carries the number of
    documents seen, so that the few edge keys are settled afterwards.
    """

    def __init__(self, most: int):
        self.most, self.key, self.docs, self.last = most, None, 0, None
        self.held: list[pa.Table] = []
        self.first = True

    def close(self, at_edge: bool) -> Iterator[pa.Table]:
        if self.key is None:
            return
        if at_edge:
            yield from (_mark(t, OPEN, 0) for t in self.held)
            row = [None, None, 0, *self.key, self.docs, EDGE]
            yield pa.table([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)
        self.held = []

    def feed(self, t: pa.Table) -> Iterator[pa.Table]:
        n = t.num_rows
        if not n:
            return
        a, b, doc, text = (t[c].combine_chunks() for c in ("a", "b", "doc_id", "text_key"))
        d = np.asarray(doc.fill_null(-1)), np.asarray(doc.is_null()), np.asarray(text)
        a, b = np.asarray(a), np.asarray(b)
        new_key = np.ones(n, bool)
        new_key[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= np.logical_or.reduce([x[1:] != x[:-1] for x in d])
        if self.key is not None and (int(a[0]), int(b[0])) == self.key:
            new_key[0] = False
            new_doc[0] = tuple(x[0].item() for x in d) != self.last
        starts = np.flatnonzero(new_key)
        if len(starts) == 0 or starts[0] != 0:
            starts = np.r_[0, starts]
        ends = np.r_[starts[1:], n]
        seen = np.r_[0, np.cumsum(new_doc)]
        firsts = seen[ends] - seen[starts]  # first occurrences of the key: one per document
        # Runs inside this batch are settled together; the first and the last one may go on outside.
        inside = slice(1, len(starts) - 1)
        frequent = np.zeros(len(starts), bool)
        frequent[inside] = firsts[inside] >= self.most
        if frequent.any():
            yield _mark(t.filter(pa.array(np.repeat(frequent, ends - starts))), DROP, 0)
        for k in sorted({0, len(starts) - 1}):
            rows, key = t.slice(starts[k], ends[k] - starts[k]), (int(a[starts[k]]), int(b[starts[k]]))
            if key != self.key:
                at_edge, self.first = self.first and self.key is not None, self.first and self.key is None
                yield from self.close(at_edge)
                self.key, self.docs = key, 0
            self.docs += int(firsts[k])
            if self.docs >= self.most:
                yield from (_mark(x, DROP, 0) for x in [*self.held, rows])
                self.held = []
            else:
                self.held.append(rows)
            if k == 0 and len(starts) > 1:
                at_edge, self.first = self.first, False
                yield from self.close(at_edge)
                self.key, self.docs = None, 0
        self.last = tuple(x[-1].item() for x in d)


def _mark(t: pa.Table, state: int, docs: int) -> pa.Table:
    n = t.num_rows
    marks = [pa.array(np.full(n, x, np.int32)) for x in (docs, state)]
    return pa.table([*t.columns, *marks], schema=_SCHEMA)


def _stream(most: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(most)
        for batch in batches:
            for out in run.feed(pa.Table.from_batches([batch])):
                yield from out.combine_chunks().to_batches()
        for out in run.close(True):
            yield from out.combine_chunks().to_batches()

    return go


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, ``n_lines``, ``n_dropped``, ``keep`` (binary).

    ``keep`` has a bit for each line, 1 for one that stays: packed little-endian, compressed with zlib.  Lines whose key
    (:func:`line_key`, of at least ``min_points`` code points) occurs in ``min_docs`` documents or more go everywhere.

    A document is a (doc_id, text) pair: identical repeated rows are one document here and share their row; different
    texts under one id, or null ids, are different documents.  Null text is one empty line.  Key hashes have 128 bits.

    Method: (hash, document, position) records are range-partitioned by hash and document and sorted, so that a line found
    everywhere spans several partitions; each partition is streamed once, first occurrences are counted, and the rows of
    frequent keys leave.  Only a partition's first and last key can be undecided; those are settled in a small step.
    """
    spark = docs.sparkSession
    text = whole_text(docs)
    keys = F.transform(F.split(text, "\n", -1), line_key)
    hashed = F.transform(keys, lambda k: F.when(F.length(k) >= min_points, F.struct(
        F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b"))))
    per_doc = settle(docs.select("doc_id", text_key(docs).alias("text_key"), hashed.alias("lines")).dropDuplicates(["doc_id", "text_key"]))
    lines = (per_doc.select("doc_id", "text_key", F.posexplode("lines").alias("pos", "h")).where("h is not null")
             .select("doc_id", "text_key", "pos", "h.a", "h.b"))
    streamed = settle(
        lines.repartitionByRange(partitions(spark), "a", "b", "doc_id", "text_key")
        .sortWithinPartitions("a", "b", "doc_id", "text_key", "pos").mapInArrow(_stream(min_docs), _STREAM))
    edges = (streamed.where(F.col("state") == EDGE).groupBy("a", "b").agg(F.sum("docs").alias("total"))
             .where(F.col("total") >= min_docs).select("a", "b"))
    late = streamed.where(F.col("state") == OPEN).join(edges, ["a", "b"], "left_semi")
    dropped = streamed.where(F.col("state") == DROP).select("doc_id", "text_key", "pos").union(late.select("doc_id", "text_key", "pos"))
    lost = (dropped.groupBy("doc_id", "text_key").agg(F.collect_list("pos").alias("lost"))
            .withColumnsRenamed({"doc_id": "d", "text_key": "k"}))
    joined = per_doc.select("doc_id", "text_key", F.size("lines").alias("n_lines")).join(
        lost, F.expr("doc_id <=> d and text_key = k"), "left")
    return joined.select("doc_id", "text_key", "n_lines", "lost").mapInArrow(
        _bitmaps, "doc_id bigint, text_key bigint, n_lines bigint, n_dropped bigint, keep binary")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, lost in zip(batch["n_lines"].to_pylist(), batch["lost"], strict=True):
            bits = np.ones(n, bool)
            lost = np.asarray(lost.values) if lost.is_valid else []
            bits[lost] = False
            out.append((n, len(lost), zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_key"], *[pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]],
            ["doc_id", "text_key", "n_lines", "n_dropped", "keep"])


def kept_mask(keep: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n, bitorder="little").astype(bool)


def _with_bitmaps(docs: DataFrame, columns: list[str], bitmaps: DataFrame) -> DataFrame:
    """``columns`` of the documents with the bitmaps, where a line goes; untouched documents have a null bitmap."""
    touched = bitmaps.where("n_dropped > 0").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("keep").alias("_keep"),
                                                    F.col("n_dropped").alias("_n_dropped"))
    return (docs.select(*columns, text_key(docs).alias("_key"))
            .join(touched, F.expr("doc_id <=> _d and _key = _k"), "left").drop("_d", "_k", "_key"))


def _rest(text: bytes, keep: bytes) -> bytes:
    lines = text.split(b"\n")
    return b"\n".join([x for x, k in zip(lines, kept_mask(keep, len(lines)), strict=True) if k])


def drop_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """The documents, all their columns, with repeated lines taken out of ``text``; a text that loses no line is untouched."""
    joined = _with_bitmaps(docs, docs.columns, keep_bitmaps(docs, min_docs, min_points)).drop("_n_dropped")
    names = docs.columns
    at = names.index("text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch["_keep"].to_pylist()
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            texts = [t if k is None else _rest(t or b"", k) for t, k in zip(texts, keep, strict=True)]
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(go, docs.schema)


def op5(docs: DataFrame) -> DataFrame:
    """Digest of :func:`keep_bitmaps`: lines, dropped lines and the hash of the kept text of each row."""
    joined = _with_bitmaps(docs, ["doc_id", "text"], keep_bitmaps(docs))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch["text"])
            data = data.tobytes()
            sums, n_lines = [], []
            for i, keep in enumerate(batch["_keep"].to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                n_lines.append(text.count(b"\n") + 1)
                sums.append(hashlib.sha256(text if keep is None else _rest(text, keep)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_lines, pa.int64()), batch["_n_dropped"].fill_null(0), pa.array(sums)],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(go, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


OP5_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (
  select doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
f as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, f.key is not null as gone from k left join f using (key))
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

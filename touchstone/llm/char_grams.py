"""Hashed character n-grams of whole Arrow batches, and sums of per-task count vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchstone.llm.common import _STEP, chunks, partitions, string_buffers

_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """Per code point: lower case (single-character mappings) or whether it is a letter."""
    if name not in _tables:
        signs = [chr(i) for i in range(0x110000)]
        if name == "lower":
            _tables[name] = np.array([ord(x) if len(x := s.lower()) == 1 else ord(s) for s in signs], np.uint32)
        else:
            _tables[name] = np.array([s.isalpha() for s in signs])
    return _tables[name]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts with a space before each and at the end, and the place of each text's space."""
    raw = data.tobytes()
    parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    length = np.array([len(p) for p in parts], np.int64)
    at = np.r_[0, np.cumsum(length + 1)]
    out = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "replace"), np.uint32)
    out = _table("lower")[np.minimum(out, 0x10FFFF)]
    out[(out >= 9) & (out <= 13)] = 32
    return out, at


def grams(points: np.ndarray, at: np.ndarray, sizes: list[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: bucket of the n-gram that starts at each place, and the places whose n-gram lies in one text.

    A text's n-grams may take in the space before and behind it.  Size number i has the buckets from ``i << bits`` on.
    """
    n = len(points)
    owner_end = np.repeat(at[1:], np.diff(at))  # of each place: the space behind its text
    for i, size in enumerate(sizes):
        m = n - size + 1
        if m <= 0:
            continue
        acc = np.zeros(m, np.uint64)
        for k in range(size):
            acc += (points[k:k + m].astype(np.uint64) + np.uint64(1)) * _STEP[k + 8 * i]
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        bucket = (acc >> np.uint64(64 - bits)).astype(np.int64) + (i << bits)
        m = min(m, len(owner_end))
        inside = np.flatnonzero(np.arange(m) + size - 1 <= owner_end[:m])
        yield bucket[:m], inside


def texts_by_chunk(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(batch["text"])
    for lo, hi in chunks(offsets, size):
        points, at = code_points(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        yield lo, hi, points, at


# ---- count vectors that tasks add up and Spark sums, slice by slice

SLICE = 1 << 12
COUNTS = "key string, slice bigint, counts binary"


def pack_counts(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for key, vector in counts.items():
        vector = np.pad(vector, (0, -len(vector) % SLICE))
        used = [(s, zlib.compress(part.tobytes(), 1)) for s, part in enumerate(vector.reshape(-1, SLICE)) if part.any()]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(used)), pa.array([s for s, _ in used], pa.int64()), pa.array([b for _, b in used], pa.binary())],
                ["key", "slice", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for key, s, blob in zip(*[batch[c].to_pylist() for c in ("key", "slice", "counts")], strict=True):
            part = np.frombuffer(zlib.decompress(blob), np.int64)
            total[key, s] = total[key, s] + part if (key, s) in total else part
    for (key, s), part in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array([s], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["key", "slice", "counts"])


def summed_counts(packed: DataFrame, length: int) -> dict[str, np.ndarray]:
    """The sums of the tasks' vectors by key: fixed-size vectors, one per class."""
    out: dict[str, np.ndarray] = {}
    for r in packed.repartition(partitions(packed.sparkSession), "key", "slice").mapInArrow(_sum, COUNTS).collect():
        vector = out.setdefault(r["key"], np.zeros(length + -length % SLICE, np.int64))
        vector[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return {k: v[:length] for k, v in out.items()}

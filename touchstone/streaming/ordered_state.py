"""Exact running AUC of a stream: order statistics kept in state, so that a micro-batch costs its own size."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from touchstone.functions.numeric import finite

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_LEVELS = 8  # digits of 8 bits of a value's 64-bit code


def _codes(values: np.ndarray) -> np.ndarray:
    """64-bit codes in the order of the values."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


class _Node:
    """Positives and negatives below each digit of a prefix that occurs."""

    def __init__(self, blob: bytes | None):
        self.counts: dict[int, tuple[int, int]] = {}
        if blob:
            for digit, p, q in struct.iter_unpack("<BQQ", blob):
                self.counts[digit] = (p, q)

    def blob(self) -> bytes:
        return b"".join(struct.pack("<BQQ", d, p, q) for d, (p, q) in sorted(self.counts.items()))


class RunningAuc(StatefulProcessor):
    """Per group a trie of value digits with counts, and the doubled number of won pairs.

    A new value meets the older ones in eight look-ups: negatives below it and equal to it if it is positive, positives
    above and equal if it is negative.  Values of one micro-batch meet each other as a sorted histogram.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "prefix binary", "counts binary")
        self.total = handle.getValueState("total", "pos bigint, neg bigint, wins string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p[["s", "y"]] for p in rows]
        pdf = pd.concat(parts) if len(parts) > 1 else parts[0]
        codes, at = np.unique(_codes(pdf["s"].to_numpy(float)), return_inverse=True)
        y = pdf["y"].to_numpy() == 1
        p, q = np.bincount(at, weights=y, minlength=len(codes)).astype(np.int64), np.bincount(at, weights=~y, minlength=len(codes)).astype(np.int64)
        pos, neg, wins = (int(v) for v in self.total.get()) if self.total.exists() else (0, 0, 0)
        held: dict[bytes, _Node] = {}

        def node(prefix: bytes) -> _Node:
            if prefix not in held:
                stored = self.nodes.getValue((prefix,)) if self.nodes.containsKey((prefix,)) else None
                held[prefix] = _Node(bytes(stored[0]) if stored else None)
            return held[prefix]

        met = 0
        for code, a, b in zip(codes.tolist(), p.tolist(), q.tolist()):
            digits = code.to_bytes(8, "big")
            below = pos_below = 0
            equal = (0, 0)
            for level in range(_LEVELS):
                counts = node(digits[:level]).counts
                for digit, (up, un) in counts.items():
                    if digit < digits[level]:
                        pos_below += up
                        below += un
                equal = counts.get(digits[level], (0, 0))
                if equal == (0, 0):
                    break
            met += a * (2 * below + equal[1]) + b * (2 * (pos - pos_below - equal[0]) + equal[0])
        before = np.cumsum(q) - q
        met += int(sum(int(a) * (2 * int(c) + int(b)) for a, b, c in zip(p, q, before)))
        for code, a, b in zip(codes.tolist(), p.tolist(), q.tolist()):
            digits = code.to_bytes(8, "big")
            for level in range(_LEVELS):
                counts = node(digits[:level]).counts
                up, un = counts.get(digits[level], (0, 0))
                counts[digits[level]] = (up + a, un + b)
        for prefix, changed in held.items():
            self.nodes.updateValue((prefix,), (changed.blob(),))
        pos, neg, wins = pos + int(p.sum()), neg + int(q.sum()), wins + met
        self.total.update((pos, neg, str(wins)))
        auc = wins / (2 * pos * neg) if pos and neg else None
        yield pd.DataFrame({**{f"k{i}": [v] for i, v in enumerate(key)}, "n_pos": [pos], "n_neg": [neg], "auc": pd.array([auc], dtype="Float64")})

    def close(self) -> None:
        pass


def running_auc(stream: DataFrame, score: str, label: str, group: Sequence[str]) -> DataFrame:
    """``group, n_pos, n_neg, auc`` of all rows seen so far, for each group that a micro-batch touches (update mode).

    Equal to the AUC of a batch job over all rows up to then, ties counted half.  State holds distinct values, not rows, and
    is exact after a restart from the checkpoint.  The session's state store must be RocksDB (:data:`ROCKSDB`).  Rows with a
    missing or infinite score, or a label other than 0 and 1, do not count.  A group's rows of one micro-batch pass one task.
    """
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    group = list(group)
    kinds = [stream.schema[g].dataType.simpleString() for g in group]
    # Plain names: the Python side renames columns that begin with an underscore.
    rows = stream.filter(finite(score) & F.col(label).isin(0, 1)).select(
        *[F.col(g).alias(f"k{i}") for i, g in enumerate(group)], F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
    schema = ", ".join([*[f"k{i} {k}" for i, k in enumerate(kinds)], "n_pos bigint", "n_neg bigint", "auc double"])
    out = rows.groupBy(*[f"k{i}" for i in range(len(group))]).transformWithStateInPandas(
        statefulProcessor=RunningAuc(), outputStructType=schema, outputMode="Update", timeMode="None")
    return out.select(*[F.col(f"k{i}").alias(g) for i, g in enumerate(group)], "n_pos", "n_neg", "auc")


def running_auc_stream(stream: DataFrame, score: str, label: str, group: Sequence[str], report: str, checkpoint: str) -> StreamingQuery:
    """Write :func:`running_auc` after every micro-batch to ``report/round=<n>``; a replayed round overwrites itself."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{report}/round={epoch}")

    out = running_auc(stream, score, label, group)
    return out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

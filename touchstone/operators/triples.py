"""Rankers of classes by their profiles, evaluated under many splits and feature sets from one table of counts.

A (row, class) pair is described by blocks of features: the row's vector, the class profile and their difference, every
component in bins.  The ranker adds log ratios of bin counts of true and drawn pairs, so its training data are counts: a
split that holds out classes, groups or clusters is a sum over other cells of the same count table, and a feature set is a
sum over blocks of the same scores.  Nothing is refitted on rows, and no row meets all classes before it is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.numeric import keyed_int
from touchstone.settings import BROADCAST_BYTES, setting

BLOCKS = ("vector", "profile", "difference")
FEATURE_SETS = {"vector": ("vector",), "profile": ("profile",), "difference": ("difference",), "vector+profile": ("vector", "profile"), "full": BLOCKS}


def bin_edges(bins: int) -> list[float]:
    """Inner edges of ``bins`` equally likely bins of a standardised component."""
    return [round(NormalDist().inv_cdf(k / bins), 9) for k in range(1, bins)]


@dataclass(frozen=True)
class Split:
    """Which count cells train a model and which rows test it, over cells (label, candidate, group)."""

    name: str
    held_out: int | None = None  # a class number, or
    train_group: str | None = None  # the group that trains
    test_group: str | None = None  # and the one that tests

    def trains(self, label: int, candidate: int, group: str | None) -> bool:
        if self.held_out is not None:
            return self.held_out not in (label, candidate)
        return group == self.train_group


def leave_class_out(classes: Sequence[str]) -> list[Split]:
    """One split per class: it is neither a true class nor a drawn one in training, and all its rows are tested."""
    return [Split(str(c), held_out=i) for i, c in enumerate(classes)]


def across_groups(groups: Sequence[str]) -> list[Split]:
    """Trained on one group and tested on another, for every ordered pair."""
    return [Split(f"{a} to {b}", train_group=a, test_group=b) for a in groups for b in groups if a != b]


def _pairs(rows: DataFrame, classes: int, negatives: int, seed: int) -> DataFrame:
    """Every row with its own class and up to ``negatives`` others, drawn as class numbers."""
    def other(i: int) -> Column:
        return F.pmod(F.col("__label") + 1 + F.pmod(keyed_int(seed, "__k", F.lit(i)), F.lit(max(1, classes - 1))), F.lit(classes)).cast("int")

    drawn = F.array_distinct(F.array(F.col("__label"), *([other(i) for i in range(negatives)] if classes > 1 else [])))
    return rows.withColumn("__candidate", F.explode(drawn))


def evaluate_rankers(
    df: DataFrame, classes: DataFrame, key: str, vector: str, label: str, profile: str, splits: str = "classes", group: str | None = None,
    feature_sets: dict[str, Sequence[str]] | None = None, negatives: int = 2, bins: int = 8, seed: int = 0, smallest_group: int = 1,
) -> DataFrame:
    """``split, feature_set, n, top1, top3, mrr``: how well held-out rows' classes are ranked by profile alone.

    ``splits="classes"`` leaves every class out in turn, so its rows are ranked by a model that never saw it;
    ``splits="groups"`` trains on each value of ``group`` with ``smallest_group`` rows and tests on each other one.
    ``classes`` has one row per class (``label``, ``profile``).  Rows whose class it lacks, or with a null vector, do not
    take part.  The class table, the counts and the weights go to the driver and to tasks and are refused beyond
    ``spark.touchstone.broadcastBytes``; they grow with classes, splits and features, not with rows.
    """
    if splits not in ("classes", "groups") or (splits == "groups") != (group is not None):
        raise ValueError("splits are 'classes', or 'groups' with a group column")
    spark = df.sparkSession
    sets = dict(feature_sets or FEATURE_SETS)
    known = [(r[0], np.asarray(r[1], float)) for r in classes.select(label, F.col(profile).cast("array<double>")).orderBy(label).collect()]
    names, q = [str(n) for n, _ in known], np.stack([v for _, v in known])
    d, count = q.shape[1], len(known)
    features = 3 * d
    limit = setting(spark, BROADCAST_BYTES)
    numbers = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(known)], f"c {df.schema[label].dataType.simpleString()}, __label int")
    rows = df.join(F.broadcast(numbers), df[label] == numbers["c"]).filter(F.col(vector).isNotNull()).select(
        F.col(key).alias("__k"), "__label", F.col(vector).cast("array<double>").alias("__x"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("__g"))
    if splits == "classes":
        plan = leave_class_out(names)
    else:
        sizes = rows.filter("__g is not null").groupBy("__g").count().filter(F.col("count") >= smallest_group)
        found = [r["__g"] for r in sizes.orderBy("__g").limit(1001).collect()]
        if len(found) > 1000:
            raise ValueError("more than 1000 groups: name fewer, or raise smallest_group")
        plan = across_groups(found)
    if len(plan) * features * bins * 8 > limit:
        raise ValueError(f"weights of {len(plan)} splits exceed {limit} bytes")
    pairs = _pairs(rows, count, negatives, seed)

    # One pass for each component's mean and deviation over the pairs, one for the counts.
    own = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in q])
    joined = pairs.withColumn("__q", F.get(own, F.col("__candidate")))
    joint = F.concat("__x", "__q", F.zip_with("__x", "__q", lambda a, b: a - b))
    shape = joined.select(array_to_vector(joint).alias("v")).agg(Summarizer.metrics("mean", "std").summary(F.col("v")).alias("s"))
    s = shape.select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std")).first()
    if s is None or s["mean"] is None or not len(s["mean"]):
        return spark.createDataFrame([], "split string, feature_set string, n long, top1 double, top3 double, mrr double")
    mean, std = np.asarray(s["mean"], float), np.asarray(s["std"], float)
    scale = np.where(std > 1e-12, std, np.inf)
    edges = np.asarray(bin_edges(bins))

    def binned(x: np.ndarray, profile_rows: np.ndarray) -> np.ndarray:
        """Bin of every component of (row, class) pairs, as flat cells of a (feature, bin) table."""
        v = np.concatenate([np.broadcast_to(x, profile_rows.shape), profile_rows, x - profile_rows], axis=-1)
        z = np.round((v - mean) / scale, 9)
        return np.searchsorted(edges, z, side="right") + np.arange(features) * bins

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        return batch["__x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            labels, candidates = batch["__label"].to_numpy(), batch["__candidate"].to_numpy()
            groups = batch["__g"].to_pylist()
            cells = binned(vectors(batch), q[candidates])
            kinds: dict[tuple, list[int]] = {}
            for i, at in enumerate(zip(labels.tolist(), candidates.tolist(), groups)):
                kinds.setdefault(at, []).append(i)
            for at, where in kinds.items():
                added = np.bincount(cells[where].ravel(), minlength=features * bins)
                held[at] = held[at] + added if at in held else added
        for (label_no, candidate, g), n in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([label_no], pa.int32()), pa.array([candidate], pa.int32()), pa.array([g], pa.string()), pa.array([n.tolist()], pa.list_(pa.int64()))],
                ["label", "candidate", "g", "counts"])

    pieces = pairs.mapInArrow(counted, "label int, candidate int, g string, counts array<bigint>")
    cube = pieces.select("label", "candidate", "g", F.posexplode("counts").alias("cell", "n")).filter("n > 0").groupBy("label", "candidate", "g", "cell").agg(F.sum("n").alias("n"))
    if cube.count() * 24 > limit:
        raise ValueError(f"the count table exceeds {limit} bytes")
    table: dict[tuple, np.ndarray] = {}
    for r in cube.collect():
        table.setdefault((r["label"], r["candidate"], r["g"]), np.zeros(features * bins))[r["cell"]] = r["n"]

    weights = []
    for split in plan:
        true, drawn = np.zeros(features * bins), np.zeros(features * bins)
        for (label_no, candidate, g), n in table.items():
            if split.trains(label_no, candidate, g):
                if label_no == candidate:
                    true += n
                else:
                    drawn += n
        ratio = [np.log(c + 1) - np.log(c.reshape(features, bins).sum(1).repeat(bins) + bins) for c in (true, drawn)]
        weights.append(ratio[0] - ratio[1])
    block = {b: slice(i * d, (i + 1) * d) for i, b in enumerate(BLOCKS)}

    step = max(1, (1 << 21) // (count * features))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, labels, groups = vectors(batch), batch["__label"].to_numpy(), np.array(batch["__g"].to_pylist(), object)
            for k, split in enumerate(plan):
                tested = np.flatnonzero(labels == split.held_out if split.held_out is not None else groups == split.test_group)
                for at in range(0, len(tested), step):
                    rows_ = tested[at:at + step]
                    true = labels[rows_]
                    per = weights[k][binned(x[rows_][:, None, :], np.broadcast_to(q, (len(rows_), count, d)))]
                    sums = {b: per[:, :, where].sum(2) for b, where in block.items()}
                    for name, blocks in sets.items():
                        score = np.round(sum(sums[b] for b in blocks), 6)
                        best = score[np.arange(len(rows_)), true][:, None]
                        ahead = (score > best) | (score == best) & (np.arange(count) < true[:, None])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([split.name] * len(rows_)), pa.array([name] * len(rows_)), pa.array(ahead.sum(1) + 1)], ["split", "feature_set", "rank"])

    places = rows.mapInArrow(ranked, "split string, feature_set string, rank bigint")
    return places.groupBy("split", "feature_set").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("rank") <= 1).cast("double")).alias("top1"), F.avg((F.col("rank") <= 3).cast("double")).alias("top3"),
        F.avg(1.0 / F.col("rank")).alias("mrr"))

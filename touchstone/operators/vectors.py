"""Embedding columns: similarities, nearest matches, variance shares and vector maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from touchstone.functions.numeric import col
from touchstone.operators.linear import gram, solve
from touchstone.operators.running import attach, numbered

BLOCK_ROWS = 4096


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """The vector scaled to length one; a zero vector stays."""
    length = norm(a)
    return F.transform(col(a), lambda x: F.when(length > 0, x / length).otherwise(x.cast("double")))


def cosine_distance(a, b) -> Column:
    """1 - cosine; 0 when a side has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, 1 - dot(a, b) / scale).otherwise(0.0)


def centroids(df, label: Sequence[str], vector: str, name="centroid") -> DataFrame:
    """Mean vector per label, from component sums (no list of a label's vectors is made)."""
    label = list(label)
    cells = df.select(*label, F.posexplode(vector).alias("__i", "__v")).groupBy(*label, "__i").agg(F.avg("__v").alias("__m"))
    return cells.groupBy(*label).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(name))


def _pack(df, key: str, vector: str, blocks: int, side: str) -> DataFrame:
    """Rows gathered into ``blocks`` hash blocks: ids and one flat array each."""
    placed = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).withColumn(f"{side}b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = placed.groupBy(f"{side}b").agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return packed.select(f"{side}b", F.col("r.id").alias(f"{side}_id"), F.flatten(F.col("r.v")).alias(f"{side}_v"))


def _block_count(df, block_rows: int) -> int:
    return max(1, -(-df.count() // block_rows))


def _scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Closeness of every row of a to every row of b; larger is closer."""
    if metric == "cosine":
        la, lb = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1, keepdims=True)
        return (a / np.where(la > 0, la, 1)) @ (b / np.where(lb > 0, lb, 1)).T
    if metric == "l2":
        return -np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0))
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):  # L1 one component at a time: no rows x rows x components array
        out -= np.abs(a[:, j][:, None] - b[:, j][None, :])
    return out


def top_matches(
    left: DataFrame, left_key: str, left_vector: str, right: DataFrame, right_key: str, right_vector: str, k: int = 1,
    metric: str = "cosine", block_rows: int = BLOCK_ROWS, exclude_same: bool = False,
) -> DataFrame:
    """(left id, right id, closeness, place): the exact k closest right rows of every left row.

    A blocked matrix product.  Both sides are packed into hash blocks of about ``block_rows``
    unique keys; every left block meets every right block through an equi-join on the right block
    number, a task holds one pair of blocks, and only k candidates per left row and block leave
    it.  Neither side passes through the driver and no task's memory grows with the data.
    """
    n_left, n_right = _block_count(left, block_rows), _block_count(right, block_rows)
    a = _pack(left, left_key, left_vector, n_left, "l").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    # Merged, never broadcast: packed blocks look small to Spark whatever they hold.
    pairs = a.join(_pack(right, right_key, right_vector, n_right, "r").hint("merge"), "rb")
    id_a = left.select(left_key).schema[0].dataType.simpleString()
    id_b = right.select(right_key).schema[0].dataType.simpleString()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for li, lv, ri, rv in zip(pdf["l_id"], pdf["l_v"], pdf["r_id"], pdf["r_v"]):
                li, ri = np.asarray(li), np.asarray(ri)
                order = np.argsort(ri, kind="stable")
                x = np.asarray(lv, float).reshape(len(li), -1)
                y = np.asarray(rv, float).reshape(len(ri), -1)[order]
                ri = ri[order]
                s = np.round(_scores(x, y, metric), 12)
                if exclude_same:
                    s[li[:, None] == ri[None, :]] = -np.inf
                take = np.argsort(-s, axis=1, kind="stable")[:, :k]  # equal scores: smaller right id
                rows = np.repeat(np.arange(len(li)), take.shape[1])
                out = pd.DataFrame({left_key: li[rows], "__right": ri[take.ravel()], "closeness": s[rows, take.ravel()]})
                yield out[np.isfinite(out["closeness"])]

    found = pairs.select("l_id", "l_v", "r_id", "r_v").mapInPandas(best, f"`{left_key}` {id_a}, `__right` {id_b}, closeness double")
    # At most k rows per right block reach each left key.
    placed = numbered(found, [left_key], [("closeness", "desc"), "__right"], "place", split=False)
    return placed.filter(F.col("place") <= k).withColumnRenamed("__right", f"match_{right_key}")


def nearest_centroid(df, key: str, vector: str, models: DataFrame, label: str, model_vector: str = "centroid") -> DataFrame:
    """Most similar centroid of every vector by cosine."""
    return top_matches(df, key, vector, models, label, model_vector, 1).select(
        key, F.col(f"match_{label}").alias("nearest"), F.col("closeness").alias("similarity"))


def nearest_summary(matches: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Distinct nearest centroids, the modal one and its share."""
    counts = matches.groupBy(*group, "nearest").agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("distinct_nearest"), F.min_by("nearest", F.struct(-F.col("__n"), F.col("nearest"))).alias("modal"),
        (F.max("__n") / F.sum("__n")).alias("modal_share"))


def mean_pairwise_cosine(df, vector: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean cosine over all pairs from the length of the summed unit vectors, without pairs."""
    group = list(group)
    units = df.select(*group, F.posexplode(unit(vector)).alias("__i", "__u"))
    sums = units.groupBy(*group, "__i").agg(F.sum("__u").alias("__s"), F.count(F.lit(1)).alias("__n"))
    n = F.max("__n")
    return sums.groupBy(*group).agg(n.alias("n"), F.try_divide(F.sum(F.col("__s") ** 2) - n, n * (n - 1)).alias("mean_pairwise_cosine"))


def knn_vote(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 5, metric: str = "l2", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(test id, candidate label, votes, rank): labels of the k nearest training rows by votes.

    Equal votes go to the label with the nearer first neighbour, then the smaller label.
    """
    near = top_matches(test, key, vector, train.withColumnRenamed(key, "__tid"), "__tid", vector, k, metric, block_rows)
    named = near.join(train.select(F.col(key).alias("match___tid"), F.col(label).alias("candidate")).hint("merge"), "match___tid")
    votes = named.groupBy(key, "candidate").agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("__first"))
    return numbered(votes, [key], [("votes", "desc"), "__first", "candidate"], "rank", split=False).drop("__first")


def variance_explained(df, vector: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """eta^2 of a vector by a label: 1 - within / total sum of squares, from component sums."""
    group = list(group)
    cells = df.select(*group, label, F.posexplode(vector).alias("__i", "__v")).groupBy(*group, label, "__i").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__s"), F.sum(F.col("__v").cast("double") * F.col("__v")).alias("__q"))
    inside = F.col("__q") - F.col("__s") ** 2 / F.col("__n")
    per = cells.groupBy(*group, "__i").agg(F.sum(inside).alias("__w"), (F.sum("__q") - F.sum("__s") ** 2 / F.sum("__n")).alias("__t"))
    return per.groupBy(*group).agg(F.sum("__w").alias("within_ss"), F.sum("__t").alias("total_ss")).withColumn(
        "eta2", 1 - F.try_divide(F.col("within_ss"), F.col("total_ss")))


def linear_cka(df, x: str, y: str, size_x: int, size_y: int, group: Sequence[str] = ()) -> DataFrame:
    """||X'Y||^2 / (||X'X|| ||Y'Y||) of centred features, from one moment matrix."""
    group = list(group)
    both = df.withColumn("__xy", F.concat(F.transform(x, lambda v: v.cast("double")), F.transform(y, lambda v: v.cast("double")))).withColumn("__zero", F.lit(0.0))
    moments = gram(both, "__xy", ["__zero"], group, size=size_x + size_y)

    def run(xtx: pd.Series) -> pd.Series:
        out = []
        for a in xtx:
            p = size_x + size_y + 1
            a = np.asarray(a, float).reshape(p, p)
            c = a[1:, 1:] - np.outer(a[0, 1:], a[0, 1:]) / a[0, 0]
            cross, own_x, own_y = c[:size_x, size_x:], c[:size_x, :size_x], c[size_x:, size_x:]
            scale = np.linalg.norm(own_x) * np.linalg.norm(own_y)
            out.append((cross**2).sum() / scale if scale > 0 else np.nan)
        return pd.Series(out)

    return moments.select(*group, "n", F.pandas_udf(run, DoubleType())("xtx").alias("cka"))


def contrast_vector(df, vector: str, weight: str, group: Sequence[str] = ()) -> DataFrame:
    """Weight-averaged vector minus the plain mean, long by component."""
    cells = df.select(*group, F.col(weight).cast("double").alias("__w"), F.posexplode(vector).alias("component", "__v"))
    return cells.groupBy(*group, "component").agg(
        (F.sum(F.col("__w") * F.col("__v")) / F.sum("__w") - F.avg("__v")).alias("value"))


def split_half_cosine(df, vector: str, weight: str, half: Column) -> DataFrame:
    """Cosine of the contrast vectors of two halves split by group."""
    parts = contrast_vector(df.withColumn("__half", half.cast("int")), vector, weight, ["__half"])
    wide = parts.groupBy("component").agg(
        F.max(F.when(F.col("__half") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("__half") == 1, F.col("value"))).alias("b"))
    return wide.agg(
        F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") ** 2)) * F.sqrt(F.sum(F.col("b") ** 2))).alias("split_half_cosine"),
        F.sqrt(F.sum(F.col("a") ** 2)).alias("length_a"), F.sqrt(F.sum(F.col("b") ** 2)).alias("length_b"))


def concatenated_pair(origin: str, target: str) -> Column:
    """origin, target and their difference as one vector."""
    widen = lambda c: F.transform(c, lambda v: v.cast("double"))
    return F.concat(widen(origin), widen(target), F.zip_with(target, origin, lambda t, o: t.cast("double") - o))


def vector_map_eval(df, x: str, y: str, size: int, train: Column, entity: str, lam: float = 1.0, size_x: int | None = None) -> DataFrame:
    """Predict a displacement vector y from x by a ridge map; per held-out entity, mean cosine and
    explained variance beside those of the constant mean displacement.

    ``size`` is the length of y, ``size_x`` of x (the same if not given).  The map is one row of
    (size_x + 1) x size numbers, bounded by the feature limit, and is broadcast.
    """
    size_x = size_x or size
    rows = df.withColumn("__train", train).withColumn("__x", F.transform(x, lambda v: v.cast("double")))
    targets = [f"__y{i}" for i in range(size)]
    rows = rows.select("*", *[F.get(y, F.lit(i)).cast("double").alias(t) for i, t in enumerate(targets)])
    moments = gram(rows.filter("__train"), "__x", targets, size=size_x)
    fit = solve(moments, lam).select("beta", F.transform(F.slice("xty", F.lit(1), F.lit(size)), lambda v: v / F.col("n")).alias("__mean"))
    fitted = fit.first()
    beta, mean = np.asarray(fitted[0], float).reshape(size_x + 1, size), np.asarray(fitted[1], float)
    shared = df.sparkSession.sparkContext.broadcast(beta)

    def predict(v: pd.Series) -> pd.Series:
        m = np.column_stack([np.ones(len(v)), np.vstack(v.to_numpy())]) @ shared.value if len(v) else np.empty((0, size))
        return pd.Series(list(m))

    test = rows.filter("NOT __train").withColumn("__p", F.pandas_udf(predict, ArrayType(DoubleType()))("__x"))
    test = test.withColumn("__t", F.array(*targets)).withColumn("__c", F.array(*[F.lit(float(v)) for v in mean]))
    gap = lambda a: F.aggregate(F.zip_with("__t", a, lambda s, q: (s - q) * (s - q)), F.lit(0.0), lambda acc, v: acc + v)
    return test.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.avg(1 - cosine_distance("__p", "__t")).alias("cosine"), F.avg(1 - cosine_distance("__c", "__t")).alias("constant_cosine"),
        (1 - F.try_divide(F.sum(gap("__p")), F.sum(dot("__t", "__t")))).alias("explained"),
        (1 - F.try_divide(F.sum(gap("__c")), F.sum(dot("__t", "__t")))).alias("constant_explained"))


def farthest_points(df, key: str, vector: str, k: int, group: Sequence[str] = (), seed: int = 0, cut_every: int = 8) -> DataFrame:
    """(group, key, pick): farthest-point selection in L1, from a keyed-random first point.

    Each round is one aggregation for the farthest row of every group and one join of that row
    back; only the running distance is carried, and lineage is cut every few rounds.
    """
    from touchstone.functions.numeric import keyed_int
    from touchstone.settings import cut_lineage

    group = list(group)
    l1 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda acc, v: acc + v)
    state = df.select(*group, key, F.col(vector).alias("__v")).withColumn("__d", F.lit(float("inf")))
    state = state.withColumn("__first", keyed_int(seed, *group, key))
    picks = None
    for round_no in range(k):
        order = F.struct(F.col("__first"), F.col(key)) if round_no == 0 else F.struct(-F.round("__d", 9), F.col(key))
        # A picked row has distance zero; it cannot be chosen again while another row is left.
        best = state.filter(F.col("__d") >= 0).groupBy(*group).agg(F.min_by(F.struct(F.col(key).alias("k"), F.col("__v").alias("v")), order).alias("__b"))
        best = best.select(*group, F.col("__b.k").alias("__pk"), F.col("__b.v").alias("__pv"))
        if (round_no + 1) % cut_every == 0:
            best = cut_lineage(best)
        chosen = best.select(*group, F.col("__pk").alias(key), F.lit(round_no + 1).alias("pick"))
        picks = chosen if picks is None else picks.unionByName(chosen)
        if round_no + 1 < k:
            state = attach(state, best, group, "left" if group else "inner")
            taken = F.when(F.col(key) == F.col("__pk"), F.lit(-1.0)).otherwise(F.least(F.col("__d"), l1("__v", "__pv")))
            state = state.withColumn("__d", F.when(F.col("__d") < 0, F.col("__d")).otherwise(taken)).drop("__pk", "__pv")
            if (round_no + 1) % cut_every == 0:
                state = cut_lineage(state)
    return picks



"""Least squares for many groups from additive second moments.

One pass sums (X'X, X'Y, Y'Y) per group and fold; sums are additive, so folds, clusters and
corpora are held out by subtraction and a group of any size is combined on the map side.  The
p x p solves run one row per group in Arrow batches; predictions and leave-one-out hat values
are expressions over coefficients joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from touchstone.functions.numeric import finite, keyed_int
from touchstone.functions.text import letters
from touchstone.operators.agreement import elite_metrics, roc_auc, spearman
from touchstone.operators.running import attach, fresh, numbered, with_scalars

MAX_FEATURES = 2000  # a p x p moment matrix beyond this is refused
_DIRECT = 24  # up to here moments are built-in sums; beyond, Arrow blocks

GRAM = ["n", "xtx", "xty", "yty"]


def gram(df: DataFrame, features: Sequence[str] | str, targets: Sequence[str], group: Sequence[str] = (), weight: str | None = None, size: int | None = None) -> DataFrame:
    """Moments per group: n, X'X with a leading intercept (row-major), X'Y (row-major), Y'Y diagonal.

    ``features`` is a list of numeric columns, or one array column of ``size`` doubles (where it is
    not given, the arrays tell).  Rows with a missing value must be filtered before.
    """
    group, targets = list(group), list(targets)
    p = size + 1 if isinstance(features, str) and size else None if isinstance(features, str) else len(features) + 1
    _check_width(p or 0)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if not isinstance(features, str) and p <= _DIRECT:
        xs = [F.lit(1.0)] + [F.col(f).cast("double") for f in features]
        ys = [F.col(t).cast("double") for t in targets]
        sums = {f"__g{i}_{j}": F.sum(w * xs[i] * xs[j]) for i in range(p) for j in range(i, p)}
        sums |= {f"__h{i}_{k}": F.sum(w * xs[i] * ys[k]) for i in range(p) for k in range(len(ys))}
        sums |= {f"__q{k}": F.sum(w * ys[k] * ys[k]) for k in range(len(ys))}
        wide = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in sums.items()])
        cell = lambda i, j: F.col(f"__g{min(i, j)}_{max(i, j)}")
        return wide.select(
            *group, "n", F.array(*[cell(i, j) for i in range(p) for j in range(p)]).alias("xtx"),
            F.array(*[F.col(f"__h{i}_{k}") for i in range(p) for k in range(len(ys))]).alias("xty"),
            F.array(*[F.col(f"__q{k}") for k in range(len(ys))]).alias("yty"))
    return _gram_blocks(df, features, targets, group, w, p)


def _check_width(p: int) -> None:
    if p > MAX_FEATURES:
        raise ValueError(f"{p} features exceed the moment matrix limit of {MAX_FEATURES}")


def _gram_blocks(df, features, targets, group, w, p) -> DataFrame:
    """Moments of wide designs: per-partition numpy sums, added up by a second aggregation."""
    m = len(targets)
    vector = F.col(features) if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(*group, vector.alias("__x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("__y"), w.alias("__w"))
    room = 4_000_000  # doubles held per task before partial sums are emitted

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def drain():
            keys = list(held)
            out = pd.DataFrame(keys, columns=group) if group else pd.DataFrame(index=range(len(keys)))
            out["n"] = [held[k][0] for k in keys]
            out["sums"] = [held[k][1] for k in keys]
            held.clear()
            return out

        for pdf in batches:
            parts = pdf.groupby(group, dropna=False, sort=False) if group else [((), pdf)]
            for key, part in parts:
                x = np.column_stack([np.ones(len(part)), np.vstack(part["__x"].to_numpy())]).astype(float)
                _check_width(x.shape[1])
                y = np.vstack(part["__y"].to_numpy()).astype(float)
                wt = part["__w"].to_numpy(float)[:, None]
                sums = np.concatenate([(x.T @ (wt * x)).ravel(), (x.T @ (wt * y)).ravel(), (wt * y * y).sum(0)])
                n, old = held.get(key, (0, 0.0))
                held[key] = (n + len(part), old + sums)
            if held and len(held) * len(sums) >= room:
                yield drain()
        if held:
            yield drain()

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*group).schema.fields) + "n long, sums array<double>"
    pieces = rows.mapInPandas(partial, schema)
    return _unpack(_add_arrays(pieces, group, ["sums"], ["n"]), group, p, m)


def _unpack(df, group, p, m):
    if p is None:  # from the length p^2 + p m + m of the sums
        p = F.round((F.sqrt(F.lit(m * m) + 4 * (F.size("sums") - m)) - m) / 2).cast("int")
    else:
        p = F.lit(p)
    part = lambda start, size: F.slice("sums", (start + 1).cast("int"), size.cast("int"))
    return df.select(*group, "n", part(F.lit(0), p * p).alias("xtx"), part(p * p, p * m).alias("xty"), part(p * p + p * m, F.lit(m)).alias("yty"))


def _add_arrays(df, group, arrays: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """Element-wise sums of array columns per group (arrays are bounded by the moment size)."""
    packed = df.select(*group, *scalars, F.concat(*[F.col(a) for a in arrays]).alias("__all"), *[F.size(a).alias(f"__s_{a}") for a in arrays])
    cells = packed.select(*group, F.posexplode("__all").alias("__i", "__v")).groupBy(*group, "__i").agg(F.sum("__v").alias("__v"))
    whole = cells.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda s: s["__v"]).alias("__all"))
    heads = packed.groupBy(*group).agg(*[F.sum(s).alias(s) for s in scalars], *[F.max(f"__s_{a}").alias(f"__s_{a}") for a in arrays])
    out = attach(heads, whole, group)
    start = F.lit(1)
    columns = []
    for a in arrays:
        columns.append(F.slice("__all", start, F.col(f"__s_{a}")).alias(a))
        start = start + F.col(f"__s_{a}")
    return out.select(*group, *scalars, *columns)


def sum_grams(grams: DataFrame, group: Sequence[str]) -> DataFrame:
    """Moments of coarser groups from finer ones."""
    return _add_arrays(grams, list(group), ["xtx", "xty", "yty"], ["n"])


def held_out_grams(total: DataFrame, part: DataFrame, group: Sequence[str], fold: str) -> DataFrame:
    """Training moments per (group, fold): the total less the fold's own."""
    whole = total.select(*group, F.col("n").alias("__tn"), *[F.col(c).alias(f"__t_{c}") for c in GRAM[1:]])
    out = attach(part, whole, group)
    less = lambda c: F.zip_with(F.col(f"__t_{c}"), F.col(c), lambda a, b: a - b).alias(c)
    return out.select(*group, fold, (F.col("__tn") - F.col("n")).alias("n"), *[less(c) for c in GRAM[1:]])


def _solve_one(xtx, xty, lam, standardise, intercept_free=True):
    p = int(round(np.sqrt(len(xtx))))
    a, b = np.asarray(xtx, float).reshape(p, p), np.asarray(xty, float).reshape(p, -1)
    n = a[0, 0]
    if n <= 0:
        return None, None
    if standardise:
        mu, my = a[0, 1:] / n, b[0] / n
        cov = a[1:, 1:] - n * np.outer(mu, mu)
        sd = np.sqrt(np.maximum(np.diag(cov) / n, 0.0)) + 1e-8
        left = cov / np.outer(sd, sd) + lam * np.eye(p - 1)
        right = (b[1:] - n * np.outer(mu, my)) / sd[:, None]
        w = _stable_solve(left, right) / sd[:, None]
        return np.vstack([my - mu @ w, w]).ravel(), None
    penalty = np.full(p, float(lam))
    if intercept_free:
        penalty[0] = 0.0
    left = a + np.diag(penalty)
    inverse = _stable_solve(left, np.eye(p))
    return (inverse @ b).ravel(), inverse.ravel()


def _stable_solve(left, right):
    try:
        return np.linalg.solve(left, right)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(left) @ right


def _solver(which: int, lam: float, standardise: bool):
    def run(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        return pd.Series([_solve_one(a, b, lam, standardise)[which] for a, b in zip(xtx, xty)], dtype=object)

    return F.pandas_udf(run, ArrayType(DoubleType()))


def solve(grams: DataFrame, lam: float = 1.0, standardise: bool = False, inverse: bool = False) -> DataFrame:
    """Ridge coefficients per row of moments (intercept first, never penalised).

    With ``standardise`` the penalty acts on features scaled by their training moments and the
    coefficients come back in original units.  ``inverse`` adds (X'X + penalty)^-1.
    """
    out = grams.withColumn("beta", _solver(0, lam, standardise)("xtx", "xty"))
    if inverse:
        out = out.withColumn("inverse", _solver(1, lam, False)("xtx", "xty"))
    return out


def _design(features) -> list[Column]:
    return [F.lit(1.0)] + [F.col(f).cast("double") for f in features]


def linear_prediction(features: Sequence[str] | str, beta: str = "beta", target: int = 0, targets: int = 1) -> Column:
    """x . beta as an expression over a coefficient array with the intercept first."""
    if isinstance(features, str):
        body = F.slice(F.col(beta), F.lit(2), F.size(features))
        return F.get(F.col(beta), F.lit(0)) + F.aggregate(F.zip_with(features, body, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    total = None
    for i, x in enumerate(_design(features)):
        term = F.get(F.col(beta), F.lit(i * targets + target)) * x
        total = term if total is None else total + term
    return total


@F.pandas_udf(DoubleType())
def _quadratic_blocks(x: pd.Series, inverse: pd.Series) -> pd.Series:
    out = np.empty(len(x))
    for i, (v, inv) in enumerate(zip(x, inverse)):
        v = np.concatenate([[1.0], np.asarray(v, float)])
        out[i] = v @ np.asarray(inv, float).reshape(len(v), len(v)) @ v
    return pd.Series(out)


def quadratic_form(features: Sequence[str] | str, inverse: str = "inverse") -> Column:
    """x' A^-1 x with a leading intercept."""
    if isinstance(features, str) or len(features) + 1 > _DIRECT:
        vector = F.col(features) if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
        return _quadratic_blocks(vector, F.col(inverse))
    xs = _design(features)
    p = len(xs)
    total = None
    for i in range(p):
        for j in range(i, p):
            term = F.get(F.col(inverse), F.lit(i * p + j)) * xs[i] * xs[j] * (1.0 if i == j else 2.0)
            total = term if total is None else total + term
    return total


@dataclass(frozen=True)
class Centred:
    """Rows beside which features and target stand less their group means, under names that the input did not have."""

    rows: DataFrame
    features: Sequence[str] | str
    targets: list[str]
    means: list[str]
    extra: list[str]

    @property
    def target(self) -> str:
        return self.targets[0]

    @property
    def mean(self) -> str:
        return self.means[0]

    def undo(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.extra)


def centred(df: DataFrame, features: Sequence[str] | str, target: str | Sequence[str], group: Sequence[str]) -> Centred:
    """The rows with features and targets less their group means.

    The intercept is never penalised, so fits and hat values stay, and moments of large, little varying values (epoch
    seconds, for one) keep their digits.  An array column of features is centred element by element.
    """
    wide = isinstance(features, str)
    before = [target] if isinstance(target, str) else list(target)
    before += [features] if wide else list(features)
    n = 1 if isinstance(target, str) else len(target)
    moved = fresh(df, *[f"y{i + 1}" for i in range(n)], *[f"x{i + 1}" for i in range(len(before) - n)])
    means = fresh(df, *[f"y0{i + 1}" for i in range(n)], *[f"x0{i + 1}" for i in range(len(before) - n)])
    mean = lambda c: F.avg(F.when(finite(c), F.col(c).cast("double")))
    scalars = before[:n] if wide else before
    sums = df.groupBy(*group).agg(*[mean(c).alias(m) for c, m in zip(scalars, means)])
    if wide:
        vector = F.col(features).cast("array<double>")
        usable = df.filter(F.col(features).isNotNull() & F.forall(features, finite))
        middle = vector_to_array(Summarizer.mean(array_to_vector(vector))).alias(means[n])
        sums = attach(sums, usable.groupBy(*group).agg(middle), list(group), "left")
    out = attach(df, sums, list(group), "left" if group else "inner")
    out = out.withColumns({own: F.col(c).cast("double") - F.coalesce(m, F.lit(0.0)) for c, own, m in zip(scalars, moved, means)})
    if wide:
        less = F.zip_with(vector, F.col(means[n]), lambda a, b: a - b)
        out = out.withColumn(moved[n], F.when(F.col(means[n]).isNull(), vector).otherwise(less))
    out = out.drop(*means[n:])
    return Centred(out, moved[n] if wide else moved[n:], moved[:n], means[:n], [*moved, *means[:n]])


def ridge_by_group(df, features, target: str, group: Sequence[str] = (), lam: float = 1.0, train: Column | None = None, standardise=False, name="prediction") -> DataFrame:
    """Fit on training rows per group, predict every row."""
    group = list(group)
    c = centred(df, features, target, group)
    rows = c.rows.filter(train) if train is not None else c.rows
    fit, = fresh(c.rows, "beta")
    beta = solve(gram(rows.filter(finite(target)), c.features, [c.target], group), lam, standardise).select(*group, F.col("beta").alias(fit))
    out = attach(c.rows, beta, group, "left" if group else "inner")
    out = out.withColumn(name, linear_prediction(c.features, fit) + F.coalesce(c.mean, F.lit(0.0)))
    return c.undo(out.drop(fit))


def loo_ridge(df, features, target: str, group: Sequence[str] = (), lam: float = 1.0, min_n: int = 3, name="loo") -> DataFrame:
    """Leave-one-out ridge predictions in closed form: y - e / (1 - h), 1 - h at least 1e-6."""
    group = list(group)
    c = centred(df.filter(finite(target)), features, target, group)
    fit = solve(gram(c.rows, c.features, [c.target], group), lam, inverse=True)
    beta, inverse = fresh(c.rows, "beta", "inverse")
    fit = fit.filter(F.col("n") >= min_n).select(*group, F.col("beta").alias(beta), F.col("inverse").alias(inverse))
    out = attach(c.rows, fit, group)
    room = F.greatest(1 - quadratic_form(c.features, inverse), F.lit(1e-6))
    left_out = F.col(target).cast("double") - (F.col(c.target) - linear_prediction(c.features, beta)) / room
    return c.undo(out.withColumn(name, left_out).drop(beta, inverse))


def ols(df, features, target, group=(), train: Column | None = None, name="prediction") -> DataFrame:
    return ridge_by_group(df, features, target, group, 0.0, train, name=name)


# ---- folds


def fold_random(key, folds: int, seed: int = 0) -> Column:
    return F.pmod(keyed_int(seed, key), F.lit(folds)).cast("int")


def fold_modulo(position, folds: int) -> Column:
    return F.pmod(F.col(position) if isinstance(position, str) else position, F.lit(folds)).cast("int")


def fold_blocks(df, position: str, folds: int, name="fold") -> DataFrame:
    """Contiguous blocks of the distinct positions; the first blocks hold one more when uneven."""
    distinct = df.select(position).distinct()
    placed = numbered(distinct, [], [position], "__rn")
    total = distinct.agg(F.count(F.lit(1)).alias("__n"))
    placed = with_scalars(placed, total)
    base, extra = F.floor(F.col("__n") / folds), F.col("__n") % folds
    i = F.col("__rn") - 1
    long = extra * (base + 1)
    block = F.when(i < long, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - long) / F.greatest(base, F.lit(1))))
    return df.join(placed.select(position, block.cast("int").alias(name)), position)


def fold_letters(text, alphabet: str, folds: int, seed: int = 0) -> Column:
    """Folds a row is held out in: one per group of held-out letters that it contains."""
    ordered = sorted(alphabet, key=lambda c: _stable_hash(seed, c))
    groups = ["".join(ordered[i::folds]) for i in range(folds)]
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.array(*[F.when(t.rlike(f"[{g}]"), F.lit(i)) for i, g in enumerate(groups)]), lambda v: v.isNotNull())


def _stable_hash(seed, letter):
    import hashlib

    return hashlib.md5(f"{seed}|{letter}".encode()).hexdigest()


def letter_groups(alphabet: str, folds: int, seed: int = 0) -> list[str]:
    ordered = sorted(alphabet, key=lambda c: _stable_hash(seed, c))
    return ["".join(ordered[i::folds]) for i in range(folds)]


def out_of_fold(df, features, target: str, fold: str, group: Sequence[str] = (), lam: float = 1.0, standardise=False, min_train: int = 3, name="oof") -> DataFrame:
    """Out-of-fold predictions from one pass of moments per (group, fold)."""
    group = list(group)
    c = centred(df, features, target, group)
    parts = gram(c.rows.filter(finite(target)), c.features, [c.target], [*group, fold])
    train = held_out_grams(sum_grams(parts, group), parts, group, fold).filter(F.col("n") >= min_train)
    fit, = fresh(c.rows, "beta")
    beta = solve(train, lam, standardise).select(*group, fold, F.col("beta").alias(fit))
    out = attach(c.rows, beta, [*group, fold], "left")
    out = out.withColumn(name, linear_prediction(c.features, fit) + F.coalesce(c.mean, F.lit(0.0)))
    return c.undo(out.drop(fit))


def out_of_fold_multi(df, key: str, features, target: str, folds: Column, group: Sequence[str] = (), lam=1.0, standardise=True, min_train=50, name="oof") -> DataFrame:
    """As ``out_of_fold`` where a row may be held out in several folds; predictions are averaged."""
    group = list(group)
    c = centred(df.filter(finite(target)), features, target, group)
    exploded = c.rows.withColumn("__fold", F.explode(folds))
    parts = gram(exploded, c.features, [c.target], [*group, "__fold"])
    train = held_out_grams(gram(c.rows, c.features, [c.target], group), parts, group, "__fold").filter(F.col("n") >= min_train)
    fit, = fresh(exploded, "beta")
    beta = solve(train, lam, standardise).select(*group, "__fold", F.col("beta").alias(fit))
    scored = attach(exploded, beta, [*group, "__fold"]).withColumn("__p", linear_prediction(c.features, fit) + F.coalesce(c.mean, F.lit(0.0)))
    means = scored.groupBy(*group, key).agg(F.avg("__p").alias(name), F.count(F.lit(1)).alias("folds"))
    return attach(df, means, [*group, key], "left")


def leave_one_cluster_out(df, features, target, cluster: str, group=(), lam=10.0, standardise=True, name="locco") -> DataFrame:
    """Each cluster predicted by a fit on all others; scaling moments leave it out as well."""
    return out_of_fold(df, features, target, cluster, group, lam, standardise, name=name)


def probe_eval(df, key, features, target, label: str, discriminate: Column, folds: Column, lam=10.0, min_train=50) -> DataFrame:
    """Out-of-fold rank agreement, AUC on a discrimination subset, coverage and mean train share."""
    scored = out_of_fold_multi(df, key, features, target, folds, (), lam, True, min_train)
    rho = spearman(scored, "oof", target, name="rho").drop("n")
    auc = roc_auc(scored.filter(discriminate), "oof", label).select("auc", (F.col("n_pos") + F.col("n_neg")).alias("n_discriminated"))
    cover = scored.agg(F.avg(F.col("oof").isNotNull().cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))
    shares = df.withColumn("__fold", F.explode(folds)).groupBy("__fold").agg(F.count(F.lit(1)).alias("__t"))
    shares = with_scalars(shares, cover.select("n")).agg((1 - F.avg(F.col("__t") / F.col("n"))).alias("mean_train_fraction"))
    return with_scalars(with_scalars(with_scalars(rho, auc), cover), shares)


def _held(group: str, letter: Column) -> Column:
    return letter.rlike(f"[{group}]").cast("int")


def within_background(df, key: str, text: str, features, target, alphabet: str, folds: int = 5, lam: float = 10.0, seed: int = 0, min_train: int = 50, min_members: int = 3) -> DataFrame:
    """Ranking of strings that differ only at one place whose letter was never trained on.

    Per fold of held-out letters, train on strings without them; a test string holds exactly one,
    and strings sharing all other places form a background.  n-weighted mean rho over backgrounds;
    a constant prediction or target counts as 0.
    """
    groups = letter_groups(alphabet, folds, seed)
    t = F.col(text)
    marks = F.array(*[
        F.struct(F.lit(i).alias("fold"), F.transform(letters(t), partial(_held, g)).alias("held"))
        for i, g in enumerate(groups)])
    c = centred(df.filter(finite(target)), features, target, [])
    rows = c.rows.withColumn("__m", F.explode(F.filter(marks, lambda m: F.aggregate(m["held"], F.lit(0), lambda a, v: a + v) > 0)))
    rows = rows.select("*", F.col("__m.fold").alias("__fold"), F.col("__m.held").alias("__held"))
    parts = gram(rows, c.features, [c.target], ["__fold"])
    train = held_out_grams(gram(c.rows, c.features, [c.target]), parts, [], "__fold").filter(F.col("n") >= min_train)
    beta = solve(train, lam, True).select("__fold", "beta")
    single = rows.filter(F.aggregate("__held", F.lit(0), lambda a, v: a + v) == 1)
    place = F.array_position("__held", 1).cast("int")
    single = single.withColumn("__bg", F.overlay(t, F.lit("_"), place)).join(beta, "__fold").withColumn("__p", F.round(linear_prediction(c.features) + F.col(c.mean), 9))
    by = ["__fold", "__bg"]
    members = single.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), (F.stddev_pop("__p") < 1e-9).alias("__flat"), (F.stddev_pop(target) < 1e-9).alias("__same"))
    rho = spearman(single, "__p", target, by, min_members, "__r").drop("n")
    out = attach(members.filter(F.col("__n") >= min_members), rho, by)
    value = F.when(F.col("__flat") | F.col("__same"), 0.0).otherwise(F.col("__r"))
    return out.agg(
        F.count(F.lit(1)).alias("backgrounds"), F.sum("__n").alias("members"),
        (F.sum(value * F.col("__n")) / F.sum("__n")).alias("weighted_rho"), F.avg(value).alias("mean_rho"))


# ---- several targets, beliefs, deployment metrics


def cross_map_r2(df, features, targets: Sequence[str], train: Column, lam: float = 1.0, group: Sequence[str] = ()) -> DataFrame:
    """Held-out R^2 of a multi-output ridge map, per target, without a prediction pass.

    Residual sums follow from the held-out moments: Y'Y - 2 b'X'Y + b'X'X b.
    """
    group, targets = list(group), list(targets)
    ok = F.lit(True)
    for c in [*([] if isinstance(features, str) else features), *targets]:
        ok = ok & finite(c)
    c = centred(df.filter(ok).withColumn("__train", train), features, targets, group)
    parts = gram(c.rows, c.features, c.targets, [*group, "__train"])
    fit = solve(parts.filter("__train"), lam).select(*group, "beta")
    test = attach(parts.filter("NOT __train"), fit, group)
    m = len(targets)

    @F.pandas_udf(ArrayType(DoubleType()))
    def r2(xtx: pd.Series, xty: pd.Series, yty: pd.Series, beta: pd.Series) -> pd.Series:
        out = []
        for a, b, q, w in zip(xtx, xty, yty, beta):
            b, w, q = np.asarray(b, float).reshape(-1, m), np.asarray(w, float).reshape(-1, m), np.asarray(q, float)
            a = np.asarray(a, float).reshape(len(b), len(b))
            sse = q - 2 * (w * b).sum(0) + np.einsum("im,ij,jm->m", w, a, w)
            sst = q - b[0] ** 2 / a[0, 0]
            out.append(list(np.where(sst > 1e-12, 1 - sse / np.where(sst > 1e-12, sst, 1.0), np.nan)))
        return pd.Series(out)

    scored = test.withColumn("__r", r2("xtx", "xty", "yty", "beta"))
    names = F.array(*[F.lit(t) for t in targets])
    return scored.select(*group, F.col("n").alias("n_test"), F.explode(F.arrays_zip(names.alias("target"), F.col("__r").alias("r2"))).alias("c")).select(*group, "n_test", "c.*")


def posterior_update(df, features: Sequence[str], target: str, noise_sd: str, group: Sequence[str] = (), tau: float = 1.0, model_sd: float = 0.11) -> DataFrame:
    """Conjugate linear belief per partner: predictive mean and deviation for every row.

    Prior N(0, tau^2) on each weight (no intercept), row precision 1 / (noise^2 + model^2).  Rows
    without a target are predicted only.
    """
    group = list(group)
    variance = F.col(noise_sd).cast("double") ** 2 + model_sd**2
    seen = df.filter(finite(target)).withColumn("__w", 1.0 / variance)
    moments = gram(seen, features, [target], group, "__w")

    def posterior(which):
        def run(xtx: pd.Series, xty: pd.Series) -> pd.Series:
            out = []
            for a, b in zip(xtx, xty):
                p = len(b)
                a = np.asarray(a, float).reshape(p, p)[1:, 1:] + np.eye(p - 1) / tau**2
                cov = np.linalg.inv(a)
                full = np.zeros((p, p))
                full[1:, 1:] = cov
                out.append(np.concatenate([[0.0], cov @ np.asarray(b, float)[1:]]) if which == 0 else full.ravel())
            return pd.Series(out, dtype=object)

        return F.pandas_udf(run, ArrayType(DoubleType()))

    fit = moments.select(*group, posterior(0)("xtx", "xty").alias("beta"), posterior(1)("xtx", "xty").alias("inverse"))
    out = attach(df, fit, group)
    spread = F.sqrt(F.greatest(quadratic_form(features) + model_sd**2, F.lit(1e-12)))
    return out.withColumn("posterior_mean", linear_prediction(features)).withColumn("posterior_sd", spread).drop("beta", "inverse")


def supervised_metrics(df, features, target, key, group: Sequence[str] = (), lam: float = 1.0, min_n: int = 12) -> DataFrame:
    """Leave-one-out ridge judged as a ranker: elite AUROC, enrichment and rho; null below ``min_n``."""
    group = list(group)
    scored = loo_ridge(df, features, target, group, lam)
    # Predictions are rounded far below their meaning so that recomputation cannot reorder ties.
    scored = scored.withColumn("loo", F.round("loo", 9))
    elite = elite_metrics(scored, "loo", target, key, group)
    rho = spearman(scored, "loo", target, group, name="rho").drop("n")
    out = attach(elite, rho, group)
    enough = F.col("n") >= min_n
    return out.select(*group, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("elite_auroc", "enrichment", "rho")])

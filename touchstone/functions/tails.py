"""Tail probabilities for result tables: Arrow-batched numpy, a few values per output row.

Spark SQL has no incomplete beta, error function or log-gamma.  These run on aggregated rows
only (one row per study or contrast), never on the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from touchstone.functions.numeric import col

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def betainc(a, b, x):
    """Regularised incomplete beta by its continued fraction, elementwise; NaN unless a and b are positive."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    known = (a > 0.0) & (b > 0.0)
    a, b = np.where(known, a, 1.0), np.where(known, b, 1.0)
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    z = np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    front = np.where((z <= 0.0) | (z >= 1.0), 0.0, front)
    tiny = 1e-300
    c, d = np.ones_like(z), 1.0 - (p + q) * z / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, 5000):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                     -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
        if np.nanmax(np.abs(d * c - 1.0), initial=0.0) < 1e-15:
            break
    value = front * total
    return np.where(known, np.where(swap, 1.0 - value, value), np.nan)


def t_two_sided_np(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile_np(p, df):
    """Upper quantile (p above one half) of Student t: bisection of the exact tail over the angle of t."""
    values, of = np.unique(np.asarray(df, float), return_inverse=True)
    lo, hi = np.zeros(len(values)), np.full(len(values), math.pi / 2)
    for _ in range(60):
        mid = (lo + hi) / 2
        over = t_two_sided_np(np.tan(mid), values) > 2 * (1 - p)
        lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
    return np.where(values > 0, np.tan((lo + hi) / 2), np.nan)[of]


def binom_two_sided_np(k, n):
    """Exact two-sided binomial p at one half: twice the smaller tail, at most 1."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    low = np.minimum(k, n - k)
    tail = betainc(n - low, low + 1.0, np.full_like(low, 0.5))
    return np.where(n <= 0, 1.0, np.minimum(1.0, 2.0 * tail))


def fisher_two_sided_np(a, b, c, d):
    """Sum of hypergeometric probabilities no larger than that of the observed 2x2 table."""
    out = np.empty(len(a))
    for i, (w, x, y, z) in enumerate(zip(a, b, c, d)):
        r1, c1, n = w + x, w + y, w + x + y + z
        k = np.arange(max(0, r1 + c1 - n), min(r1, c1) + 1)
        log_p = (
            _lgamma(r1 + 1) - _lgamma(k + 1) - _lgamma(r1 - k + 1)
            + _lgamma(n - r1 + 1) - _lgamma(c1 - k + 1) - _lgamma(n - r1 - c1 + k + 1)
            - (_lgamma(n + 1) - _lgamma(c1 + 1) - _lgamma(n - c1 + 1))
        )
        p = np.exp(log_p)
        seen = p[int(w - k[0])]
        out[i] = min(1.0, p[p <= seen * (1 + 1e-7)].sum())
    return out


def _elementwise(fn):
    def run(*columns: pd.Series) -> pd.Series:
        frame = pd.concat([c.astype(float) for c in columns], axis=1)
        known = frame.notna().all(axis=1).to_numpy()
        out = np.full(len(frame), np.nan)
        if known.any():
            out[known] = fn(*[frame.iloc[:, i].to_numpy()[known] for i in range(frame.shape[1])])
        return pd.Series(out).astype(object).where(np.isfinite(out), None)

    return run


def _udf(fn, arity: int):
    body = _elementwise(fn)
    if arity == 1:
        def one(a: pd.Series) -> pd.Series:
            return body(a)
        return F.pandas_udf(one, "double")
    if arity == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return body(a, b)
        return F.pandas_udf(two, "double")
    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return body(a, b, c, d)
    return F.pandas_udf(four, "double")


def t_two_sided(t, df) -> Column:
    return _udf(t_two_sided_np, 2)(col(t).cast("double"), col(df).cast("double"))


def t_quantile_udf(p: float):
    return _udf(lambda df: t_quantile_np(p, df), 1)


def t_quantile(p: float, df) -> Column:
    return t_quantile_udf(p)(col(df).cast("double"))


def normal_upper(z) -> Column:
    """P(Z >= z)."""
    return _udf(lambda v: 0.5 * _erfc(v / math.sqrt(2.0)), 1)(col(z).cast("double"))


def normal_two_sided(z) -> Column:
    return _udf(lambda v: _erfc(np.abs(v) / math.sqrt(2.0)), 1)(col(z).cast("double"))


def binom_two_sided(k, n) -> Column:
    return _udf(binom_two_sided_np, 2)(col(k).cast("double"), col(n).cast("double"))


def fisher_two_sided(a, b, c, d) -> Column:
    return _udf(fisher_two_sided_np, 4)(*[col(v).cast("double") for v in (a, b, c, d)])


def spearman_p(rho, n) -> Column:
    """Two-sided t approximation for a rank correlation of n pairs; zero at |rho| = 1."""
    rho, n = col(rho), col(n)
    t = F.try_divide(rho * F.sqrt(n - 2.0), F.sqrt(1 - rho * rho))
    return F.when(F.abs(rho) >= 1.0, F.lit(0.0)).otherwise(t_two_sided(t, n - 2))

"""Upper tails of the Student t and F distributions.

Spark has no built-in for either. Both reduce to the regularised incomplete beta
function, evaluated here in its survival form, so that tiny p-values keep their
relative accuracy instead of vanishing in ``1 - cdf``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_STIRLING_FROM = 1.0e4


def _stirling_correction(x):
    return 1.0 / (12.0 * x) - 1.0 / (360.0 * x**3)


def _log_beta_one(a: float, b: float) -> float:
    big, small = max(a, b), min(a, b)
    if big < _STIRLING_FROM:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # lgamma(big) - lgamma(big + small) without cancelling two huge numbers
    total = big + small
    diff = (
        -(big - 0.5) * math.log1p(small / big)
        - small * math.log(total)
        + small
        + _stirling_correction(big)
        - _stirling_correction(total)
    )
    return math.lgamma(small) + diff


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs, inverse = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    values = np.array([_log_beta_one(p, q) for p, q in pairs.T])
    return values[inverse.reshape(-1)]


def _fraction(a, b, x):
    """Continued fraction of the incomplete beta function, Lentz's method."""
    tiny = 1e-300
    limit = int(300 + 12 * math.sqrt(max(float(a.max()), float(b.max()))))
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, limit):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x, x_complement):
    """Regularised I_x(a, b). ``x_complement`` is 1 - x, passed in to keep its digits."""
    a, b, x, xc = (np.array(v, dtype=float).ravel() for v in np.broadcast_arrays(a, b, x, x_complement))
    out = np.full(x.shape, np.nan)
    out[x <= 0] = 0.0
    out[xc <= 0] = 1.0
    todo = (x > 0) & (xc > 0) & (a > 0) & (b > 0)
    if todo.any():
        a, b, x, xc = a[todo], b[todo], x[todo], xc[todo]
        front = a * np.log(x) + b * np.log(xc) - _log_beta(a, b)
        direct = x < (a + 1.0) / (a + b + 2.0)
        res = np.empty_like(x)
        if direct.any():
            k = direct
            res[k] = np.exp(front[k]) * _fraction(a[k], b[k], x[k]) / a[k]
        if (~direct).any():
            k = ~direct
            res[k] = 1.0 - np.exp(front[k]) * _fraction(b[k], a[k], xc[k]) / b[k]
        out[todo] = np.clip(res, 0.0, 1.0)
    return out


def t_tail(t, df):
    """Two-tailed p-value of a t statistic (numpy arrays or scalars)."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    shape = t.shape
    t, df = t.ravel(), df.ravel()
    df = np.where(df > 0, df, np.nan)
    t2 = t * t
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(np.isinf(t2), 0.0, df / (df + t2))
        xc = np.where(np.isinf(t2), 1.0, t2 / (df + t2))
    return incomplete_beta(df / 2.0, 0.5, x, xc).reshape(shape)


def f_tail(f, df1, df2):
    """Upper-tail p-value of an F statistic (numpy arrays or scalars)."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, df1, df2)))
    shape = f.shape
    f, d1, d2 = f.ravel(), d1.ravel(), d2.ravel()
    d1, d2 = np.where(d1 > 0, d1, np.nan), np.where(d2 > 0, d2, np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * f))
        xc = np.where(np.isinf(f), 1.0, d1 * f / (d2 + d1 * f))
    return incomplete_beta(d2 / 2.0, d1 / 2.0, x, xc).reshape(shape)


@F.pandas_udf(DoubleType())
def _t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tail(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def _f_pvalue(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(
        f_tail(f.to_numpy(dtype=float), df1.to_numpy(dtype=float), df2.to_numpy(dtype=float))
    )


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-tailed p-value column; null where ``t`` is null or df is not positive."""
    p = _t_pvalue(t.cast("double"), df.cast("double"))
    return F.when(t.isNotNull() & (df > 0), p)


def f_pvalue(f: Column, df1: Column, df2: Column) -> Column:
    """Upper-tail p-value column; null where ``f`` is null or a df is not positive."""
    p = _f_pvalue(f.cast("double"), df1.cast("double"), df2.cast("double"))
    return F.when(f.isNotNull() & (df1 > 0) & (df2 > 0), p)

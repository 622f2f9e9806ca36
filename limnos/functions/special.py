"""t-distribution tail and quantile as Arrow functions (numpy has no incomplete beta)."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a, b, x):
    """Lentz's continued fraction for the incomplete beta function, on arrays."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-14):
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        gamma = np.vectorize(lgamma, otypes=[float])
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        value = np.where(z <= 0, 0.0, front * _beta_fraction(p, q, z))
    return np.where(swap, 1 - value, value)


def t_two_sided(t, df):
    """P(|T| >= |t|) with df degrees of freedom; missing in, missing out."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    safe_t, safe_df = np.where(ok, t, 1.0), np.where(ok, df, 1.0)
    return np.where(ok, beta_inc(safe_df / 2, 0.5, safe_df / (safe_df + safe_t ** 2)), np.nan)


def t_quantile(p, df):
    """Quantile for p above one half: Newton steps on the tail from a bracketed start."""
    df = np.asarray(df, float)
    v = np.where(np.isfinite(df) & (df > 0), df, 1.0)
    gamma = np.vectorize(lgamma, otypes=[float])
    scale = np.exp(gamma((v + 1) / 2) - gamma(v / 2)) / np.sqrt(v * np.pi)
    lo, hi = np.zeros_like(v), np.full_like(v, 1e4)
    t = np.full_like(v, 2.0)
    for _ in range(60):
        tail = 1 - t_two_sided(t, v) / 2 - p
        lo, hi = np.where(tail < 0, t, lo), np.where(tail < 0, hi, t)
        step = t - tail / (scale * (1 + t * t / v) ** (-(v + 1) / 2))
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        if np.all(np.abs(new - t) <= 1e-12 * np.abs(t)):
            break
        t = new
    return np.where(np.isfinite(df) & (df > 0), t, np.nan)


def _nullable(values) -> pd.Series:
    return pd.Series(values).astype("float64")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_two_sided(t, df))


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """97.5 % quantile, for 95 % intervals."""
    return _nullable(t_quantile(0.975, df))

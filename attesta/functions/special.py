"""Tail probabilities without SciPy, vectorised over numpy arrays, and their pandas UDFs.

The incomplete beta and gamma functions come from continued fractions and series; the noncentral t from
Gauss-Legendre quadrature over the chi distribution. Arguments outside a function's domain give nan.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, rounds):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out = np.full(x.shape, np.nan)
    a, b, x = a[ok], b[ok], x[ok]
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)) if len(x) else x
    low = x < (a + 1) / (a + b + 2)
    r = np.empty_like(x)
    if low.any():
        r[low] = front[low] * _beta_fraction(a[low], b[low], x[low]) / a[low]
    if (~low).any():
        r[~low] = 1 - front[~low] * _beta_fraction(b[~low], a[~low], 1 - x[~low]) / b[~low]
    out[ok] = np.where(x == 0, 0.0, np.where(x == 1, 1.0, r))
    return out


def gamma_tail(s, x) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    ok = (s > 0) & (x >= 0) & np.isfinite(x)
    out = np.full(x.shape, np.nan)
    s, x = s[ok], x[ok]
    with np.errstate(divide="ignore"):
        front = np.exp(s * np.log(x) - x - _lgamma(s)) if len(x) else x
    term, total = 1 / s, 1 / s
    for n in range(1, 1000):
        term = term * x / (s + n)
        total = total + term
    series = 1 - front * total
    b = x + 1 - s
    c, d = np.full_like(x, 1 / _TINY), 1 / np.where(b == 0, _TINY, b)
    h = d.copy()
    for n in range(1, 1000):
        top = -n * (n - s)
        b = b + 2
        d = top * d + b
        c = b + top / c
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
    out[ok] = np.where(x == 0, 1.0, np.where(x < s + 1, series, front * h))
    return out


def normal_p(z) -> np.ndarray:
    """Two-sided tail of the standard normal."""
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def t_p(t, df) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(df > 0, beta_inc(df / 2, 0.5, df / (df + t * t)), np.nan)


def f_p(f, df1, df2) -> np.ndarray:
    """Right tail of F."""
    f, df1, df2 = np.broadcast_arrays(np.asarray(f, float), np.asarray(df1, float), np.asarray(df2, float))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(f >= 0, beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)), np.nan)


def chi2_p(x, df) -> np.ndarray:
    """Right tail of chi-squared."""
    return gamma_tail(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


@lru_cache(1 << 14)
def t_quantile(p: float, df: float) -> float:
    """Value that Student's t exceeds with probability p < 1/2."""
    low, high = 0.0, 1e3
    for _ in range(64):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p(mid, df) / 2 > p else (low, mid)
    return (low + high) / 2


def power_t(d: float, n1: float, n2: float, alpha: float = 0.05) -> float:
    """Power of the two-sided two-sample t test at standardised difference d."""
    if not (n1 >= 2 and n2 >= 2 and 0 < alpha < 1 and math.isfinite(d)):
        return math.nan
    df, shift = n1 + n2 - 2, abs(d) * math.sqrt(n1 * n2 / (n1 + n2))
    limit = t_quantile(alpha / 2, df)
    # T > c where Z + shift > c sqrt(V / df): integrate over s = sqrt(V / df), which lies near 1
    spread = 12 / math.sqrt(2 * df)
    low, high = max(0.0, 1 - spread), 1 + spread + 1 / df
    x, w = np.polynomial.legendre.leggauss(200)
    s = (high - low) / 2 * x + (high + low) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(np.maximum(s, 1e-300)) - df * s * s / 2
    upper, lower = _erfc((limit * s - shift) / math.sqrt(2)) / 2, _erfc((limit * s + shift) / math.sqrt(2)) / 2
    return float(((upper + lower) * np.exp(log_density) * w).sum() * (high - low) / 2)


def required_n(d: float, power: float = 0.8, alpha: float = 0.05, ratio: float = 1.0) -> float:
    """Least size of the first group (the second is ratio times it, rounded up) that reaches the power."""
    if not (0 < power < 1 and d and math.isfinite(d) and ratio > 0):
        return math.nan
    low, high = 1, 2
    reach = lambda n: power_t(d, n, max(2, math.ceil(n * ratio)), alpha) >= power
    while not reach(high):
        low, high = high, high * 2
        if high > 1 << 30:
            return math.nan
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if reach(mid) else (mid, high)
    return float(high)


@F.pandas_udf(DoubleType())
def p_from_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_p(t, df))


@F.pandas_udf(DoubleType())
def p_from_f(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_p(f, df1, df2))


@F.pandas_udf(DoubleType())
def p_from_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_p(x, df))


@F.pandas_udf(DoubleType())
def p_from_z(z: pd.Series) -> pd.Series:
    return pd.Series(normal_p(z))


@F.pandas_udf(DoubleType())
def achieved_power(d: pd.Series, n1: pd.Series, n2: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([power_t(*x) for x in zip(d, n1, n2, alpha, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def needed_n(d: pd.Series, power: pd.Series, alpha: pd.Series, ratio: pd.Series) -> pd.Series:
    return pd.Series([required_n(*x) for x in zip(d, power, alpha, ratio, strict=True)], dtype=float)

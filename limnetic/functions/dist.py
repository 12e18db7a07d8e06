"""Tail probabilities for the few rows a statistic leaves over (vectorised, numpy)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Student t, 97.5 % point for 1 to 30 degrees of freedom.
T975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836,
    2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852,
    2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546,
    2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447,
    2.079613845, 2.073873068, 2.068657610, 2.063898562, 2.059538553,
    2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
)
Z975 = 1.959963984540054


def t975(df: Column) -> Column:
    """97.5 % point of Student's t: table up to 30, Cornish-Fisher above, NULL below 1."""
    z = Z975
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
    )
    v = df.cast("double")
    far = F.lit(z)
    for power, term in enumerate(terms, start=1):
        far = far + F.try_divide(F.lit(term), F.pow(v, F.lit(float(power))))
    table = F.array(*[F.lit(t) for t in T975])
    return F.when(df.between(1, 30), F.try_element_at(table, df.cast("int"))).when(df > 30, far)


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def f_tail(f: float, df1: float, df2: float) -> float:
    if not f > 0:
        return 1.0
    return _beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
_MANY, _MANY_WEIGHTS = np.polynomial.legendre.leggauss(256)
_erf = np.vectorize(math.erf)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(x / math.sqrt(2)))


def _range_cdf(w: np.ndarray, k: float) -> np.ndarray:
    """P(range of k standard normals <= w) for an array of w."""
    z = 8.5 * _NODES
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = np.clip(_normal_cdf(z) - _normal_cdf(z[None, :] - w[:, None]), 0, 1) ** (k - 1)
    return k * (inner * density * _WEIGHTS * 8.5).sum(axis=1)


def tukey_tail(q: float, k: float, df: float) -> float:
    """P(studentised range of k means with df degrees of freedom > q)."""
    if not q > 0 or df < 1 or k < 2:
        return float("nan") if df < 1 or k < 2 else 1.0
    # A chi variable lies within 8.5 of the root of its degrees; nodes crowd at the low end,
    # which decides at few degrees of freedom.
    low, high = max(0.0, 1 - 8.5 / math.sqrt(df)), 1 + 8.5 / math.sqrt(df)
    s = (high - low) / 2 * _MANY + (high + low) / 2
    log_density = (
        df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
        + (df - 1) * np.log(s) - df * s * s / 2
    )
    cdf = (np.exp(log_density) * _MANY_WEIGHTS * (high - low) / 2 * _range_cdf(q * s, k)).sum()
    return float(min(1.0, max(0.0, 1 - cdf)))


def tukey_critical(p: float, k: float, df: float) -> float:
    """The q whose upper tail is ``p`` (bisection)."""
    if df < 1 or k < 2:
        return float("nan")
    low, high = 0.0, 16.0
    while tukey_tail(high, k, df) > p:
        low, high = high, 2 * high
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if tukey_tail(mid, k, df) > p else (low, mid)
    return (low + high) / 2


def _each(fn, *series: pd.Series) -> pd.Series:
    """``fn`` once for each distinct row of numbers; NULL where one is missing."""
    frame = pd.concat(series, axis=1).astype(float)
    frame.columns = range(frame.shape[1])
    known = {row: fn(*row) for row in set(frame.dropna().itertuples(index=False, name=None))}
    return pd.Series([known.get(row) for row in frame.itertuples(index=False, name=None)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_from_f(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _each(f_tail, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def p_from_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda t, v: f_tail(t * t, 1.0, v), t, df)


@F.pandas_udf(T.DoubleType())
def p_from_q(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _each(tukey_tail, q, k, df)


@F.pandas_udf(T.DoubleType())
def q_critical(k: pd.Series, df: pd.Series) -> pd.Series:
    """95 % point of the studentised range."""
    return _each(lambda k, v: tukey_critical(0.05, k, v), k, df)


def stars(p: Column) -> Column:
    """Significance marks."""
    return (
        F.when(p <= 0.0001, "****")
        .when(p <= 0.001, "***")
        .when(p <= 0.01, "**")
        .when(p <= 0.05, "*")
        .when(p > 0.05, "ns")
    )

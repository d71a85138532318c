"""Upper tail of Student's t, which Spark lacks: the regularised incomplete beta by continued fractions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a, b, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Lentz's evaluation of the continued fraction."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def survival(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) with df degrees of freedom; nan where df is not positive."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    good = df > 0
    x = df[good] / (df[good] + t[good] ** 2)
    a, b = df[good] / 2, 0.5
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    direct = x < (a + 1) / (a + b + 2)
    # Beyond the mean the fraction of the complement converges faster.
    lower = np.where(direct, front * _beta_fraction(a, b, x) / a, 0.0)
    other = 1 - front * _beta_fraction(b, a, 1 - x) / b
    tail = 0.5 * np.where(direct, lower, other)
    out[good] = np.where(t[good] >= 0, tail, 1 - tail)
    return out


def upper_tail(t: Column, df: Column) -> Column:
    """``survival`` as a column."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(survival(a.to_numpy(float), b.to_numpy(float)))

    return tail(t, df)

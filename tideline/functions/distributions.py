"""Tails of the normal, t and chi-square distributions and the exact signed-rank law, vectorised for pandas UDFs."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - (_lgamma(a) + _lgamma(b) - _lgamma(a + b))) / a
        c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
        f = d.copy()
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
        out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * f))
    return np.where(flip, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def chi2_tail(x: np.ndarray, df: int) -> np.ndarray:
    """Upper tail for whole degrees of freedom, by the closed recurrences."""
    x = np.asarray(x, float)
    h = x / 2
    total, term = (np.exp(-h), np.exp(-h)) if df % 2 == 0 else (_erfc(np.sqrt(h)), np.sqrt(h) * np.exp(-h) / math.gamma(1.5))
    k = 1.0 if df % 2 == 0 else 1.5
    for i in range((df - 1) // 2):
        if df % 2 == 0:
            term = term * h / k
            total, k = total + term, k + 1
        else:
            total = total + term
            term, k = term * h / k, k + 1
    return total


@lru_cache(maxsize=64)
def _rank_sums(n: int) -> tuple[int, ...]:
    counts = [1]
    for r in range(1, n + 1):
        longer = counts + [0] * r
        for i, c in enumerate(counts):
            longer[i + r] += c
        counts = longer
    return tuple(counts)


def signed_rank_p(w: float, n: int, ties: float, exact: bool) -> float:
    """Two-sided p of the smaller rank sum: exact up to n = 50 without ties, else by the normal law."""
    if exact and n <= 50:
        return min(1.0, 2 * sum(_rank_sums(n)[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(normal_two_sided(np.array((w - n * (n + 1) / 4) / math.sqrt(var)))) if var > 0 else 1.0


def t_p(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def f(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(t, df)).where(t.notna().to_numpy() & (df > 0).to_numpy())

    return f(t.cast("double"), df.cast("double"))


def chi2_p(x: Column, df: int) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series(chi2_tail(x.fillna(0), df)).where(x.notna().to_numpy())

    return f(x.cast("double"))


def wilcoxon_p(w: Column, n: Column, ties: Column) -> Column:
    @F.pandas_udf("double")
    def f(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else signed_rank_p(a, int(b), c, c == 0) for a, b, c in zip(w, n, ties, strict=True)], dtype=float)

    return f(w.cast("double"), n.cast("long"), ties.cast("double"))
